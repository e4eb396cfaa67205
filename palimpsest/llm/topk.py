"""Exact top-k by inner product with sequential reads of sorted lists (no random access).

Vectors are integers. Rows are dealt into blocks; a block holds, for every dimension, the list of its
rows sorted by that component, read from the top where a query's weight is positive and from the
bottom where it is negative, so that contributions to the score only fall. Every list has its own
frontier, the component at which reading stopped: what a list has not shown of a row is at most
that, times the weight.

The queries of a block read the lists together, to depths after their common weights: lists of heavy weights
are read deeper than light ones, where an entry lowers the bounds less. What was read from the top, and from
the bottom, makes an image of the block, in which entries not read stand at the frontier. A query's
upper scores are the products of its positive weights with the one and of its negative weights with the other
image, so that one matrix product adds up what all queries have been shown.

Rows whose upper score does not reach the query's k-th score are out, seen or not. That score is
carried over from earlier blocks of a task; where it leaves many rows open, those of the highest upper scores are
resolved (read to the end) to lift it, and queries with many rows still open read on, deeper in every
round. Open rows of the others are resolved.

Queries and rows meet in blocks: every block of queries is dealt to every shard of row blocks, and each
meeting returns at most k rows a query, combined by rank.

Vectors that are null, empty, or hold null or non-finite components take no part. Shorter vectors
count as padded with zeros. Rows of the query's own id are no candidates; repeated rows are candidates
each, and repeated queries are asked once. Products are exact: in floating point (of 32 or 64 bits) where it
holds them, else in integers; a score beyond 64 bits is given as the end of their range.
"""

from __future__ import annotations

from math import erf, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import words

#: Rows of a block; queries of a block.
ROWS, QUERIES = 4096, 4096
#: Queries whose upper scores are in memory at once; blocks of queries whose k-th scores a task keeps.
SIDE, KEPT = 256, 64
#: How far a list is read in each round: to where the entries left, times what the next one lowers
#: the frontier by, falls below this share of the mean over lists (for normal components).
ROUNDS = (1.0, 0.6, 0.4, 0.2)
#: Open rows, as a multiple of k, that are resolved rather than read on in rounds.
FEW = 8

_Z = np.linspace(-4, 4, 161)
_SHARE = np.array([(1 + erf(z / sqrt(2))) / 2 for z in _Z])
_GAIN = _SHARE / (np.exp(-_Z * _Z / 2) / sqrt(2 * pi))


class Lists:
    """The sorted lists of one block of rows (rows, dimensions)."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.n, self.d = x.shape
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))
        self.values = np.ascontiguousarray(np.take_along_axis(x.T, self.order, 1))
        self.rank = np.empty(x.shape, np.int32)  # place of an entry in its list, to tell whether it has been read
        np.put_along_axis(self.rank, self.order.T, np.arange(self.n, dtype=np.int32)[:, None], 0)
        self.spread = np.array([float(v) for v in x.astype(np.float64).std(0)])

    def depths(self, q: np.ndarray, gain: float) -> np.ndarray:
        """Entries of each list that a query (or the queries of a matrix together) reads in a round."""
        weight = np.sqrt((np.atleast_2d(q).astype(np.float64) ** 2).mean(0)) * self.spread
        mean = sqrt(float((weight * weight).mean())) or 1.0
        z = np.interp(gain * mean / np.maximum(weight, 1e-300), _GAIN, _Z)
        read = np.ceil(self.n * (1 - np.interp(z, _Z, _SHARE))).astype(np.int64)
        return np.where(weight == 0, (np.atleast_2d(q) != 0).any(0), np.maximum(read, 1))

    def read(self, i: int, downwards: bool, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The next entries of a list: rows and components."""
        part = slice(self.n - end, self.n - start) if downwards else slice(start, end)
        return self.order[i, part], self.values[i, part]

    def frontier(self, i: int, downwards: bool, depth: int):
        """The component that an unread entry does not pass."""
        return self.values[i, max(0, self.n - 1 - depth) if downwards else min(depth, self.n - 1)]


    def image(self, depth: np.ndarray) -> np.ndarray:
        """What reading to these depths has shown (2 * dimensions, rows), from the top and from the bottom;
        entries that were not read stand at the frontier."""
        out = np.empty((2, self.d, self.n), self.x.dtype)
        for side, downwards in enumerate((True, False)):
            for i, end in enumerate(depth.tolist()):
                out[side, i] = self.frontier(i, downwards, end)
                rows, values = self.read(i, downwards, 0, end)
                out[side, i, rows] = values
        return out.reshape(2 * self.d, self.n)


def _least(kind: np.dtype):
    """Below every score."""
    return -(1 << 62) if kind.kind == "i" else -np.inf


class Search:
    """The search of one block of rows for the queries of one block (queries, dimensions)."""

    def __init__(self, lists: Lists, ids: np.ndarray, queries: np.ndarray, q: np.ndarray, k: int):
        self.lists, self.ids, self.queries, self.q, self.k = lists, ids, queries, q, k
        self.weights = np.concatenate([np.where(q > 0, q, 0), np.where(q < 0, q, 0)], 1)
        self.by_id = np.argsort(ids, kind="stable")
        self.images: list[tuple[np.ndarray, np.ndarray]] = []
        self.entries = np.zeros(len(q), np.int64)

    def _image(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        """The image of a round, made when the first query comes to it."""
        if step == len(self.images):
            depth = self.lists.depths(self.q, ROUNDS[step])
            self.images.append((depth, self.lists.image(depth)))
        return self.images[step]

    def _resolve(self, of: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores of rows for their queries."""
        self.entries += np.bincount(of, minlength=len(self.q)) * self.lists.d
        parts = [np.einsum("ij,ij->i", self.lists.x[rows[i : i + ROWS]], self.q[of[i : i + ROWS]]) for i in range(0, len(rows), ROWS)]
        return np.concatenate(parts) if parts else np.empty(0, self.q.dtype)

    def run(self, part: slice, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query (place), row (place) and score of all rows that may be in the top k of these queries.

        floors: scores that k rows of earlier blocks reach; rows below them are out.
        """
        n, k, kind = self.lists.n, self.k, self.q.dtype
        asked, kth, out = np.arange(len(self.q))[part], floors.copy(), []
        first = min(n, FEW * k // 2)
        shallow = np.zeros(self.lists.d, np.int64)
        for step in range(len(ROUNDS) + 1):
            if n <= FEW * k or not self.q.any() or step == len(ROUNDS):  # too few to read on, or to the end
                upper = None
            else:
                depth, image = self._image(step)
                upper = self.weights[asked] @ image
                self.entries[asked] += ((self.q[asked] != 0) * (depth - shallow)).sum(1)
                shallow = depth
            open_ = np.ones((len(asked), n), bool) if upper is None else upper >= kth[:, None]
            own = [self.by_id[slice(*np.searchsorted(self.ids, [x, x + 1], sorter=self.by_id))] for x in self.queries[asked].tolist()]
            for i, rows in enumerate(own):
                open_[i, rows] = False
            many = np.flatnonzero(np.count_nonzero(open_, axis=1) > FEW * k) if upper is not None else np.empty(0, np.int64)
            if len(many):  # lift the k-th score by the most promising rows
                top = np.where(open_[many], upper[many], _least(kind))
                top = np.argsort(-top, axis=1, kind="stable")[:, :first] if kind.kind == "O" else np.argpartition(top, n - first, axis=1)[:, n - first :]
                scores = self._resolve(np.repeat(asked[many], first), top.ravel()).reshape(-1, first)
                kth[many] = np.maximum(kth[many], np.sort(scores, axis=1)[:, -k] if first >= k else kth[many])
                open_[many] &= upper[many] >= kth[many, None]
                many = many[np.count_nonzero(open_[many], axis=1) > FEW * k]
            done = np.ones(len(asked), bool)
            done[many] = False
            of, rows = np.nonzero(open_ & done[:, None])
            scores = self._resolve(asked[of], rows)
            keep = scores >= kth[of]
            out.append((asked[of[keep]], rows[keep], scores[keep]))
            if not len(many):
                break
            asked, kth = asked[many], kth[many]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(lists: Lists, ids: np.ndarray, query: int, q: np.ndarray, k: int, floor):
    """Places and scores of the rows that may be in one query's top k, and how many entries were read."""
    one = Search(lists, ids, np.array([query]), q[None], k)
    _, rows, scores = one.run(slice(0, 1), np.array([max(floor, _least(q.dtype))], q.dtype))
    return rows, scores.tolist(), int(one.entries[0])


def best(of: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best: by query, falling score, rising id."""
    order = np.lexsort([ids, -scores, of]) if scores.dtype.kind != "O" else np.array(sorted(range(len(of)), key=lambda i: (of[i], -scores[i], ids[i])), np.int64)
    new = np.flatnonzero(np.diff(of[order], prepend=-1))
    return order[np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of)))) < k]


def _pack(rows: DataFrame, dims: int, size: int, name: str) -> DataFrame:
    """Rows (id, v) as blocks: ids and matrix as binary, at most ``size`` rows each."""

    def run(batches):
        for batch in batches:
            for part in words.small_batches([batch], size):
                lengths = pc.list_value_length(part.column("v")).to_numpy()
                x = np.zeros((part.num_rows, dims), np.int64)
                x[np.arange(dims) < lengths[:, None]] = part.column("v").flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=[f"{name}_ids", f"{name}_x"])

    return rows.mapInArrow(run, f"{name}_ids binary, {name}_x binary")


def usable(v: Column) -> Column:
    """Not null or empty, all components finite."""
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def quantised(v: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component, as long."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def topk(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows. Both: id (long), v (array of long)."""
    rows, queries = rows.select("id", "v"), queries.select("id", "v").distinct()
    facts = rows.agg(F.max(F.size("v")).alias("d"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("most")).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not facts["d"]:
        return rows.sparkSession.createDataFrame([], out)
    asked = queries.agg(F.max(F.size("v")).alias("d"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("most"), F.count("*").alias("n")).first()
    dims = max(facts["d"], asked["d"] or 0)
    bound = dims * facts["most"] * (asked["most"] or 0)
    # exact for integers of this size
    kind = np.float32 if bound < 1 << 23 else np.float64 if bound < 1 << 51 else np.int64 if bound < 1 << 62 else object
    blocks = max(1, -(-asked["n"] // QUERIES))
    q = queries.withColumn("b", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))).repartition(blocks, "b").sortWithinPartitions("b").select("id", "v")
    q = _pack(q, dims, QUERIES, "q")
    shards = max(8, 2 * rows.sparkSession.sparkContext.defaultParallelism)
    r = _pack(rows, dims, ROWS, "r").withColumn("shard", F.pmod(F.xxhash64("r_ids"), F.lit(shards)))
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def meet(batches):
        reached: dict[bytes, np.ndarray] = {}  # by block of queries: the k best scores so far in this task
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                ids, qids = np.frombuffer(get("r_ids"), np.int64), np.frombuffer(get("q_ids"), np.int64)
                lists = Lists(np.frombuffer(get("r_x"), np.int64).reshape(-1, dims).astype(kind))
                x = np.frombuffer(get("q_x"), np.int64).reshape(-1, dims).astype(kind)
                key = xxhash.xxh3_128_digest(get("q_ids") + get("q_x"))
                if key not in reached:
                    if len(reached) >= KEPT:
                        reached.clear()
                    reached[key] = np.full((len(qids), k), _least(x.dtype), kind)
                tops, one = reached[key], Search(lists, ids, qids, x, k)
                for start in range(0, len(qids), SIDE):
                    part = slice(start, start + SIDE)
                    of, rows, scores = one.run(part, tops[part, -1])
                    chosen = best(of, ids[rows], scores, k)
                    of, rows, scores = of[chosen], rows[chosen], scores[chosen]
                    new = np.flatnonzero(np.diff(of, prepend=-1))
                    found = np.full((len(tops[part]), k), _least(x.dtype), kind)
                    found[of - start, np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of))))] = scores
                    tops[part] = np.sort(np.concatenate([tops[part], found], 1), axis=1)[:, : k - 1 : -1]
                    scores = scores.astype(np.int64) if kind != object else [max(-(1 << 63), min((1 << 63) - 1, v)) for v in scores.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (qids[of], ids[rows], scores)], names=["query_id", "vec_id", "score"])

    # dealt by number, so that tasks are not joined: their work is not in proportion to their bytes
    pairs = r.repartition(shards, "shard").join(q.repartition(shards, "shard").hint("shuffle_hash"), "shard")
    found = pairs.mapInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = words.read(spark, sf_dir, "embeddings").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = e.select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("v"))
    return topk(rows, rows.filter(F.col("id") % 20 == 0))


SQL = """
WITH e AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, unnest(v) AS c, unnest(range(len(v))) AS i FROM e),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(sum(q.c * r.c) AS BIGINT) AS score FROM x q JOIN x r ON q.i = r.i AND q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) t WHERE rank <= 20
"""
