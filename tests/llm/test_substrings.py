import hashlib

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import substrings
from tests.llm.conftest import words_of


def brute(rows, n=50):
    first = {}
    texts = [(i, words_of(t)) for i, t, *_ in rows]
    for i, w in sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = {}
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1 if i is not None else 0):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_equals_brute_force(docs, rows):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["h"]) for r in substrings.dedupe(docs).withColumn("h", F.sha2("text", 256)).collect()}
    want = brute(rows)
    assert got == want and want[10][1] == 80 and want[2][1] == 200 and want[21][1] == 50 and want[19][1] == 0 and want[13][1] == 299


def test_factors_cover_what_goes(docs):
    for r in substrings.dedupe(docs).collect():
        covered = {i for f in r["factors"] for i in range(f["start"], f["start"] + f["length"])}
        assert len(covered) == r["n_removed"] and all(f["reference"] < r["doc_id"] and f["length"] >= 50 for f in r["factors"])


def test_factors_are_substrings_of_their_references(docs):
    out = {r["doc_id"]: r for r in substrings.dedupe(docs).collect()}
    texts = {r["doc_id"]: words_of(r["text"]) for r in docs.collect()}
    found = [(i, f) for i, r in out.items() for f in r["factors"]]
    assert found
    for i, f in found:
        assert texts[i][f["start"] : f["start"] + f["length"]] == texts[f["reference"]][f["position"] : f["position"] + f["length"]]


def test_parse_breaks_where_the_reference_does():
    a = np.array
    got = substrings.factors(a([3, 4, 5, 9, 10]), a([1, 1, 2, 2, 2]), a([7, 8, 9, 30, 40]), 50)
    assert [(f["start"], f["length"], f["reference"], f["position"]) for f in got] == [(3, 51, 1, 7), (5, 50, 2, 9), (9, 50, 2, 30), (10, 50, 2, 40)] and substrings.factors(a([]), a([]), a([]), 50) == []


def test_colliding_hashes_remove_nothing_unverified(docs, rows, monkeypatch):
    """With window hashes of a few bits the parse proposes much that is wrong: none of it goes."""
    got = {r["doc_id"]: r for r in substrings.dedupe(docs).collect()}
    monkeypatch.setattr(substrings, "_windows", lambda d, w, real=substrings._windows: real(d, w).withColumn("hashes", F.transform("hashes", lambda h: h % 5)))
    texts = {i: words_of(t) for i, t, *_ in rows}
    for r in substrings.dedupe(docs).collect():
        assert r["n_removed"] <= got[r["doc_id"]]["n_removed"]
        for f in r["factors"]:
            assert texts[r["doc_id"]][f["start"] : f["start"] + f["length"]] == texts[f["reference"]][f["position"] : f["position"] + f["length"]]


def test_clashing_names_empty_table_repeated_rows(clashing, empty, docs):
    out = substrings.dedupe(clashing)
    assert set(clashing.columns) <= set(out.columns) and out.filter("hits <> 'theirs'").isEmpty() and out.count() == clashing.count()
    assert substrings.dedupe(empty).count() == 0
    twice = substrings.dedupe(docs.unionAll(docs)).filter("doc_id = 1").collect()
    assert len(twice) == 2 and {r["n_removed"] for r in twice} == {0}
