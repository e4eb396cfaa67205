import random

import numpy as np

from palimpsest.llm import graph, jaccard
from tests.llm.conftest import SCHEMA, prose, words_of


def brute(rows, percent, k):
    sets = {}
    for i, t, *_ in rows:
        w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def families(seed=5):
    """Copies of copies: links that chain, fans around an original, and unrelated texts with a shared line."""
    r, out = random.Random(seed), []
    for f in range(6):
        base = prose(r.choice([12, 60, 150]), f"{seed}/{f}").split(" ")
        for _ in range(14):
            w = base.copy()
            for _ in range(r.randint(0, max(1, len(w) // 50))):
                w[r.randrange(len(w))] = prose(1, r.random())
            if r.random() < 0.4:
                base = w
            out.append(" ".join(w))
    line = prose(12, "line")
    out += [f"{prose(r.randint(3, 40), r.random())}\n{line}" for _ in range(40)]
    r.shuffle(out)
    return [(i, t, None, None, None) for i, t in enumerate(out)]


def test_equals_brute_force(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(docs).filter("doc_id IS NOT NULL").collect()}
    assert got == brute([r for r in rows if r[0] is not None], 85, 4) and got[13] == (297, 12) and got[7][1] == 6 and got[4] == (0, 4)


def test_chains_and_fans(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 5)
    monkeypatch.setattr(jaccard, "QUERIES", 4)
    monkeypatch.setattr(jaccard, "WEIGHT", 300)
    rows = families()
    d = spark.createDataFrame(rows, SCHEMA)
    assert {r[0]: (r[1], r[2]) for r in jaccard.components(d, 80, 5).collect()} == brute(rows, 80, 5)


def test_first_of_each_keeps_columns_and_one_of_a_group(docs, clashing, empty):
    kept = jaccard.first_of_each(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {1, 3, 4, 5, 6, 12, 20, None} <= ids and not {2, 7, 13, 21, 22} & ids
    assert jaccard.first_of_each(clashing).columns == clashing.columns and jaccard.components(empty).count() == 0


def test_bounds_admit_every_link():
    """Two linked sets share a prefix token, whatever the table, and as many as an opened group must."""
    r = random.Random(1)
    for _ in range(300):
        a = {r.randrange(2**64) for _ in range(r.randint(1, 90))}
        b = set(list(a)[: r.randint(1, len(a))]) | {r.randrange(2**64) for _ in range(r.randint(0, 8))}
        x, y = sorted((np.array(sorted(s), np.uint64) for s in (a, b)), key=len)
        levels = np.zeros(jaccard.CELLS, np.uint8)
        levels[(np.concatenate([x, y]) >> np.uint64(40)).astype(np.int64)[:: r.randint(1, 5)]] = r.randint(1, 9)
        both, n, m = len(a & b), len(x), len(y)
        if jaccard.linked(both, n, m, 85):
            common = len(np.intersect1d(*(jaccard.prefix(v, levels, 85) for v in (x, y))))
            assert common >= max(1, (n + m) * 85 / 185 - 0.85 * m - 1e-6)


def test_verified_pairs_equal_sets():
    r = random.Random(4)
    base = [r.randrange(2**64) for _ in range(60)]
    sets = [np.array(sorted(set(r.sample(base, r.randint(50, 60)) + [r.randrange(2**64) for _ in range(r.randint(0, 4))])), np.uint64) for _ in range(30)]
    ids = np.arange(30)
    got = set(jaccard.verify(sets, ids, sets, ids, 80))
    want = {(i, j) for i in range(30) for j in range(30) if (len(sets[i]), i) < (len(sets[j]), j) and 100 * len(c := np.intersect1d(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - len(c))}
    assert got == want and len(want) > 20
    assert not list(jaccard.verify(sets[:1], ids[:1], [np.array([7], np.uint64)], ids[1:2], 80))


def test_counts_travel_as_gaps(spark, monkeypatch):
    cells = np.sort(np.random.default_rng(3).integers(0, 2**32, 500).astype(np.uint32))
    assert (jaccard.unpack(jaccard.pack(cells)) == cells).all()
    texts = [f"{prose(30, i)} {'a b c d e' if i % 2 else 'b c d e f'} {'x y z x' if i % 9 == 0 else ''}" for i in range(90)]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    levels = jaccard.spread(d)
    of = lambda text: int(levels[int(jaccard.token_set(text.encode(), jaccard._MEMO)[0]) >> 40])
    assert 5 <= of("b c d e") <= 6 and 4 <= of("a b c d") <= 5 and 2 <= of("x y z x") <= 3 and (levels > 0).sum() < 40
    monkeypatch.setattr(jaccard, "CHUNK", 40)
    again = jaccard.spread(d)
    assert again.max() > 3


def test_repeated_ids_and_long_texts(spark):
    long = prose(60_000, "long").split(" ")
    rows = [(1, "a b c d e f g", 0, 0, 0), (1, "a b c d e f g", 0, 0, 0), (1, "p q r s t u v", 0, 0, 0), (2, "A B c d e f g", 0, 0, 0), (3, "P q r s t u v", 0, 0, 0), (4, " ".join(long), 0, 0, 0), (5, " ".join([*long[:500], "new", *long[500:]]), 0, 0, 0), (6, "w" * 1_000_000, 0, 0, 0)]
    d = spark.createDataFrame([(i, t, None, None, None) for i, t, *_ in rows], SCHEMA)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.linked_components(d).collect()}
    assert got == {(1, 4, 1), (2, 4, 1), (3, 4, 1), (4, len(set(zip(long, long[1:], long[2:], long[3:]))), 4), (5, len(set(zip(long, long[1:], long[2:], long[3:]))) + 1, 4), (6, 1, 6)}  # noqa: B905


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (7, 7)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_all_links_of_families(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PART", 5)
    monkeypatch.setattr(jaccard, "QUERIES", 4)
    rows = families()
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        s = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
        first.setdefault(s, i)
    sets = {i: s for s, i in first.items()}
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    d = spark.createDataFrame(rows, SCHEMA)
    got = [frozenset(r) for r in jaccard.links(d, 80, 5).collect()]
    assert len(want) > len(sets) - len({c for i, (_, c) in brute(rows, 80, 5).items() if i in sets})  # more than a spanning forest
    assert len(got) == len(set(got)) and set(got) == want
    out = {r["doc_id"]: r for r in jaccard.linked_components(d, 80, 5).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == brute(rows, 80, 5)
    assert all(out[i]["n_links"] == sum(i in p for p in want) for i in sets)


def test_tally_needs_little_memory_beside_its_tokens():
    import tracemalloc

    r = np.random.default_rng(2)
    held = np.concatenate([r.integers(0, 1 << 64, 1_500_000, np.uint64), np.repeat(r.integers(0, 1 << 64, 100_000, np.uint64), 5)])
    tokens, times = np.unique(held, return_counts=True)
    got, size = {}, 0
    tracemalloc.start()
    try:
        for batch in jaccard.tally(held, 8):
            size += batch.nbytes
            for bucket, n, cells in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                assert (bucket, n) not in got
                got[bucket, n] = cells
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak - size < held.nbytes  # np.unique alone takes four times the tokens
    for (bucket, n), cells in got.items():
        mine = tokens[(tokens >> np.uint64(56) == bucket) & (np.log2(times).astype(int) == n.bit_length() - 1)]
        assert (jaccard.unpack(cells) == (mine >> np.uint64(24)).astype(np.uint32)).all()
    assert sum(len(c) // 4 for c in got.values()) == len(tokens)


def test_tokens_of_many_flushes_are_counted(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 50)
    monkeypatch.setattr(jaccard, "SOME", 7)
    rows = families()
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, *_ in rows], SCHEMA)
    want = brute(rows, 85, 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(docs).collect()} == want
