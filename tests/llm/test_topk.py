import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import topk


def brute(rows, k=20):
    ok = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in ok if i % 20 == 0):
        s = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q)  # noqa: B905
        out += [(q, n, i, -x) for n, (x, i) in enumerate(s[:k], 1)]
    return out


def run(spark, rows, **kw):
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").filter(F.col("vec_id").isNotNull() & topk.usable(F.col("embedding")))
    r = e.select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("v"))
    return sorted(map(tuple, topk.topk(r, r.filter(F.col("id") % 20 == 0), **kw).collect()))


def test_exact_with_ties_nulls_and_odd_values(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 64)
    r = random.Random(3)
    rows = [(i, [float(r.randint(-32, 32)) / 64 for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, rows[5][1]) for i in range(60)]  # many equal vectors
    rows += [(900, None), (901, []), (902, [0.5, None] + [0.0] * 6), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (None, [1.0] * 8), (920, [0.25, -0.5])]
    rows = [(i, None if v is None else v) for i, v in rows]
    assert run(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(0, [0.5, 0.25]), (1, [0.1, -0.3]), (2, [-1.0, 1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(1, [0.5])]) == [] and run(spark, [(20, [0.5])]) == []


def test_reading_stops_early_on_the_embeddings():
    """Of the lists' entries, less is read than there are; and the frontier bounds what is left."""
    import numpy as np
    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    table = pq.read_table(path)
    x, ids = np.floor(64 * np.array(table["embedding"].to_pylist(), np.float64)), table["vec_id"].to_numpy()
    lists, shares = topk.Lists(x), []
    for i in np.flatnonzero(ids % 20 == 0):
        rows, scores, entries = topk.search(lists, ids, int(ids[i]), x[i], 20, -np.inf)
        shares.append(entries / x.size)
        full = x @ x[i]
        want = np.array([j for j in np.lexsort([ids, -full]) if ids[j] != ids[i]][:20])
        assert sorted(zip((-s for s in scores), ids[rows].tolist(), strict=True))[:20] == list(zip((-full[want]).tolist(), ids[want].tolist(), strict=True))
    assert max(shares) < 0.9 and np.median(shares) < 0.75


def test_frontiers_bound_unread_entries():
    import numpy as np

    r = np.random.default_rng(0)
    x = np.round(r.standard_normal((300, 3)) * 5)
    lists = topk.Lists(x)
    for i in range(3):
        for down in (True, False):
            for depth in (1, 7, 150, 299):
                rows, values = lists.read(i, down, 0, depth)
                rest, front = np.delete(x[:, i], rows), lists.frontier(i, down, depth)
                assert (x[rows, i] == values).all() and ((rest <= front).all() and (values >= front).all() if down else (rest >= front).all() and (values <= front).all())


@pytest.mark.parametrize("size", [1.0, 3e7, 1e14, 3e16])
def test_large_components(spark, size):
    """Products beyond 53, 63 and 64 bits: exact, at last the end of the range."""
    r = random.Random(3)
    rows = [(i, [float(np.float32(r.uniform(-1, 1) * (size if i in (0, 3, 40) else 1))) for _ in range(3)]) for i in range(230)]
    low, high = -(1 << 63), (1 << 63) - 1
    want = [(q, n, i, max(low, min(high, s))) for q, n, i, s in brute(rows)]
    got = run(spark, rows)
    assert sorted((q, s) for q, _, _, s in got) == sorted((q, s) for q, _, _, s in want) and (size > 1e14 or got == want)


@pytest.mark.parametrize("kind", [np.float32, np.float64, np.int64, object])
def test_queries_of_a_block_read_its_lists_together(monkeypatch, kind):
    """Reads do not grow with the queries; all of a query's best rows are found, behind the score carried over."""
    r, reads = np.random.default_rng(4), []
    x = np.round(r.standard_normal((1200, 32)) * 8).astype(np.int64)
    x[700:760] = x[20]
    ids = r.integers(0, 1100, 1200)  # some repeated
    asked = np.arange(0, 1200, 6)
    full = x[asked] @ x.T
    for_real = topk.Lists.read
    monkeypatch.setattr(topk.Lists, "read", lambda *a: reads.append(a[1:]) or for_real(*a))
    floors = np.full(len(asked), topk._least(np.dtype(kind))).astype(kind)
    for start in (0, 600):
        block = slice(start, start + 600)
        one = topk.Search(topk.Lists(x[block].astype(kind)), ids[block], ids[asked], x[asked].astype(kind), 20)
        parts = [one.run(slice(i, i + 64), floors[i : i + 64]) for i in range(0, len(asked), 64)]
        of, rows, scores = (np.concatenate(p) for p in zip(*parts, strict=True))
        found = sorted(zip(of.tolist(), rows.tolist(), map(int, scores), strict=True))
        for i in range(len(asked)):
            want = [(int(s), j) for j, s in enumerate(full[i, block]) if ids[block][j] != ids[asked[i]]]
            bound = max(int(floors[i]) if start else -(1 << 62), sorted(want, reverse=True)[19][0])
            assert {(j, s) for o, j, s in found if o == i} >= {(j, s) for s, j in want if s >= bound}
            floors[i] = bound
    assert len(reads) <= 2 * len(topk.ROUNDS) * 2 * 32


def test_tasks_are_not_joined(spark):
    """Work follows the pairs of blocks, not their bytes, so small partitions stay apart."""
    rows = spark.range(400).select("id", F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(64)) for i in range(4)]).alias("v"))
    out = topk.topk(rows, rows.filter(F.col("id") % 20 == 0))
    assert out.count() == 400
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "SortMergeJoin" not in plan
