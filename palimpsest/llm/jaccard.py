"""Exact Jaccard self-join of documents by their n-gram sets, over a token-group matrix.

A document's set holds the 64-bit hashes of its distinct SHINGLE-word shingles (A-Z lower-cased).
Equal sets form one class, of which the smallest id is the representative that goes on.

Tokens are ordered from rare to widespread, equally widespread ones by hash. How widespread a token is
comes from a count over all documents: tokens travel as the leading bits of their hashes, sorted and
coded by their gaps, and the most widespread go, by powers of two, into a table of a fixed size
(``CELLS`` bytes) that every task reads. Collisions in it only move a token in the order, which any
order may be. A set's prefix is its first n - ceil(t n) + 1 tokens: two sets with the asked similarity
share one of it, and only prefixes are indexed. Tokens of a single prefix drop out.

The remaining sets are partitioned into groups of similar ones: those whose prefixes have the same token as
their most widespread (copies of one text share it), split by size classes of CLASS and into parts of at
most about PART members or WEIGHT tokens. The matrix holds each group's token union.

A query counts its prefix tokens in the unions of groups whose sizes fit, tokens of its own alone left out.
Of a pair, the smaller set (of equals the smaller node) asks. With n and m tokens (n <= m) a link needs
an overlap of t (n + m) / (1 + t), of which at most ceil(t m) - 1 lie beyond the prefixes. A group that
cannot reach the rest with its largest fitting member is not opened. The texts of an opened group and of its queries meet in one task,
where postings count all overlaps of a query at once: every pair that reaches the similarity is verified.

Texts that are null or without words have the empty set and stay alone. Rows with equal doc_id are
one node, with the links of each of its texts. A null doc_id has a null component unless its set has a document. Only the columns doc_id
and text are read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import graph, words

SHINGLE = 4
PERCENT = 85
#: Relative width of a size class of a group.
CLASS = 0.05
#: Entries of the table of widespread tokens (a power of two), of which at most an eighth is used;
#: count from which a token may enter it; tokens that a task counts at a time, and handles at a time.
CELLS, LEAST, CHUNK, SOME = 1 << 24, 4, 4_000_000, 250_000
#: Members of a group and queries of one task for it, at most about; tokens of either.
PART, QUERIES, WEIGHT = 256, 512, 1_000_000


#: Hashes of words, of all groups that a Python worker opens. It outlives the query, so it is small.
_MEMO = words.WordHashes(100_000)


def token_set(text: bytes, hashes: words.WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; of the whole sequence if it is shorter."""
    h = hashes.of(text.lower().split())
    if not len(h):
        return h
    return np.unique(words.window_hashes(h, k)) if len(h) >= k else words.window_hashes(h, len(h)) ^ np.uint64(len(h))


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n tokens with any set that is similar enough."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return n - needed(n, percent) + 1 if n else 0


def linked(both, n, m, percent: int):
    """Whether sets of n and m tokens with this overlap are similar enough."""
    return 100 * both >= percent * (n + m - both)


def prefix(tokens: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a sorted set in the common order."""
    order = np.argsort(levels[(tokens >> np.uint64(64 - (CELLS.bit_length() - 1))).astype(np.int64)], kind="stable")
    return tokens[order[: prefix_length(len(tokens), percent)]]


def pack(cells: np.ndarray) -> bytes:
    """Sorted 32-bit values as their gaps, byte plane by byte plane, so that compression finds the zeros."""
    return np.ascontiguousarray(np.diff(cells, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32)


def tally(held: np.ndarray, bits: int):
    """Batches (bucket, times, cells) of tokens by their leading bits and, in powers of two, by how often they
    occur. The tokens are sorted in place and taken in parts, so that little memory is needed beside them."""
    held.sort()
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    edges = np.append(np.searchsorted(held, starts), len(held))
    first = 0
    while first < len(starts):
        # buckets of about SOME tokens, at least one bucket
        past = max(first + 1, int(np.searchsorted(edges, edges[first] + SOME, side="right")) - 1)
        part = held[edges[first] : edges[past]]
        first = past
        if not len(part):
            continue
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        tokens, power = part[at], np.log2(np.diff(at, append=len(part))).astype(np.int8)
        rows: list[list] = [[], [], []]
        for p in np.unique(power).tolist():
            some = tokens[power == p]
            bucket = (some >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            pieces = np.split((some >> np.uint64(32 - bits)).astype(np.uint32), cuts)
            rows[0] += bucket[np.concatenate([[0], cuts])].tolist()
            rows[1] += [1 << p] * len(pieces)
            rows[2] += map(pack, pieces)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names=["bucket", "times", "cells"])


def _counted(key, table):
    """Places in the table of the widespread tokens of one bucket, by level (power of two of the count)."""
    bucket, shift = key[0].as_py(), key[1].as_py()
    cells = np.concatenate([unpack(x.as_py()) for x in table["cells"]])
    times = np.concatenate([np.full(len(x.as_py()) // 4, n, np.int64) for x, n in zip(table["cells"], table["times"].to_pylist(), strict=True)])
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    count = np.add.reduceat(times[order], first)
    wide = count >= LEAST
    at = (((np.uint64(bucket) << np.uint64(32)) | cells[first][wide].astype(np.uint64)) << np.uint64(shift)) >> np.uint64(64 - (CELLS.bit_length() - 1))
    level = np.log2(count[wide]).astype(np.int32)
    kinds = np.unique(level)
    places = [np.unique(at[level == x]).astype(np.uint32) for x in kinds]
    return pa.table({"level": pa.array(kinds, pa.int32()), "n": pa.array([len(p) for p in places], pa.int64()), "places": pa.array([p.tobytes() for p in places], pa.binary())})


def spread(docs: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """The table of widespread tokens: their levels by the leading bits of the token, 0 for all others."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    bits = max(6, (size // 2_000_000).bit_length())

    def run(batches):
        hashes, held, n, seen = words.WordHashes(), np.empty(CHUNK, np.uint64), 0, set()
        for batch in words.small_batches(batches):
            for t in words.texts(batch):
                s = token_set(t, hashes, k)
                name = xxhash.xxh3_64_intdigest(s.tobytes())
                if not len(s) or name in seen:  # copies close by need not count
                    continue
                if n and n + len(s) > CHUNK:
                    yield from tally(held[:n], bits)
                    n = 0
                    seen.clear()
                seen.add(name)
                if len(s) > len(held):
                    held = np.empty(len(s), np.uint64)
                held[n : n + len(s)] = s
                n += len(s)
        if n:
            yield from tally(held[:n], bits)

    cells = docs.select("text").mapInArrow(run, "bucket long, times long, cells binary").withColumn("shift", F.lit(32 - bits).cast("long"))
    found = words.store(cells.groupBy("bucket", "shift").applyInArrow(_counted, "level int, n long, places binary"))
    levels = np.zeros(CELLS, np.uint8)
    room, least = CELLS // 8, None
    for r in found.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():  # at most 63 rows
        if r["n"] > room:
            break
        room, least = room - r["n"], r["level"]
    if least is not None:  # at most an eighth of CELLS places
        for r in found.filter(F.col("level") >= least).select("level", "places").collect():
            at = np.frombuffer(r["places"], np.uint32)
            levels[at] = np.maximum(levels[at], np.uint8(r["level"]))
    words.release(found)
    return levels


def _sketch(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """doc_id, n, key (hash of the whole set) and prefix."""
    given = docs.sparkSession.sparkContext.broadcast(spread(docs, k))

    def run(batches):
        hashes, levels = words.WordHashes(), given.value
        for batch in words.small_batches(batches):
            sets = [token_set(t, hashes, k) for t in words.texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), words.long_lists([prefix(s, levels, percent) for s in sets])],
                names=["doc_id", "n", "key", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary, prefix array<long>")


def _index(docs: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n, key of all documents; token, node, n, c (count) of prefix tokens that several
    representatives have."""
    sketch = words.store(_sketch(docs, percent, k))
    ids = words.store(sketch.select("doc_id", "n", "key"))
    first = ids.filter(F.col("n") > 0).groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    mine = sketch.join(first, ["key", "doc_id"], "left_semi").groupBy("key", "doc_id").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    tokens = mine.select(F.col("doc_id").alias("node"), F.col("n").cast("int").alias("n"), F.explode("prefix").alias("token"))
    shared = words.store(tokens.withColumn("c", F.count("*").over(Window.partitionBy("token"))).filter(F.col("c") > 1))
    words.release(sketch)
    return ids, shared


def _groups(shared: DataFrame) -> DataFrame:
    """node, n, group, low and high (least and greatest n of the group), members."""
    widest = F.max(F.struct("c", "token"))["token"]
    level = F.floor(F.log(F.col("n").cast("double")) / float(np.log1p(CLASS)))
    chosen = words.store(shared.groupBy("node", "n").agg(widest.alias("common")).withColumn("level", level))
    parts = chosen.groupBy("common", "level").agg(F.ceil(F.greatest(F.count("*") / PART, F.sum("n") / WEIGHT)).alias("parts"))
    part = F.pmod(F.xxhash64("node"), "parts")
    dealt = words.store(chosen.join(parts, ["common", "level"]).select("node", "n", F.xxhash64("common", "level", part).alias("group")))
    sizes = dealt.groupBy("group").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("members"), F.sum("n").alias("weight"))
    out = words.store(dealt.join(sizes, "group"))
    words.release(chosen, dealt)
    return out


def _qualified(shared: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """node, n and group of every query with a group that can hold a partner of it."""
    rows = words.store(shared.select("token", "node", "n").join(groups.select("node", "n", "group", "low", "high"), ["node", "n"]))
    matrix = rows.groupBy("token", "group", "low", "high").agg(F.count("*").alias("holders"))
    asking = rows.select("token", "node", "n", F.col("group").alias("own"))
    fits = (F.col("high") >= F.col("n")) & (F.col("low") * percent <= F.col("n") * 100) & ((F.col("group") != F.col("own")) | (F.col("holders") > 1))
    hits = asking.join(matrix, "token").filter(fits).groupBy("node", "n", "group", "low", "high").agg(F.count("*").alias("hits"))
    largest = F.least(F.col("high"), F.floor(F.col("n") * 100 / percent))
    rest = (F.col("n") + largest) * percent / (100 + percent) - largest * percent / 100
    out = words.store(hits.filter(F.col("hits") >= rest - 1e-6).select("node", "n", "group"))
    words.release(rows)
    return out


def _places(groups: DataFrame, qualified: DataFrame) -> DataFrame:
    """Deal the queries of a group and its members out to tasks (group, salt): node, group, salt, member."""
    asked = qualified.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / QUERIES, F.sum("n") / WEIGHT)).alias("salts"))
    members = groups.select("node", "group").join(asked, "group").select("node", "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("member"))
    queries = qualified.select("node", "group").join(asked, "group").select("node", "group", F.pmod(F.xxhash64(F.lit(1), "node"), "salts").alias("salt"), F.lit(False).alias("member"))
    return members.unionByName(queries)


def verify(members: list[np.ndarray], member_ids: np.ndarray, queries: list[np.ndarray], query_ids: np.ndarray, percent: int):
    """Pairs (query, member: places) that are similar enough, a query with members no smaller (among
    equals, of greater id)."""
    sizes = np.array([len(s) for s in members])
    tokens = np.concatenate(members)
    order = np.argsort(tokens, kind="stable")
    tokens, holder = tokens[order], np.repeat(np.arange(len(members)), sizes)[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    known, many = tokens[first], np.diff(np.concatenate([first, [len(tokens)]]))
    for i, own in enumerate(queries):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        at = at[known[at] == own]
        n = many[at]
        ends = np.cumsum(n)
        posting = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[at] - (ends - n), n)
        both = np.bincount(holder[posting], minlength=len(members))
        larger = (sizes > len(own)) | ((sizes == len(own)) & (member_ids > query_ids[i]))
        for j in np.flatnonzero(larger & linked(both, len(own), sizes, percent)):
            yield i, int(j)


def _open(docs: DataFrame, places: DataFrame, percent: int, k: int, every: bool) -> DataFrame:
    """Links between the queries and members that meet in a task: u, v and n. With ``every`` each of
    them (n is 1); else the number of links of each node, as (node, node, n), and with n = 0 as many
    links as connect what is connected in the task.

    Texts travel to the tasks, where sets are made: a text packs to less than half of its set.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    # merged, not broadcast where places are few: disk and shuffle then follow the input alike at every size
    rows = texts.join(places.hint("merge"), "node").select("group", "salt", "member", "node", "text")

    def match(pdf):
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        m, q = (pdf[pdf["member"] == x].drop_duplicates(["node", "text"]) for x in (True, False))
        sets = lambda texts: [token_set((t or "").encode(), _MEMO, k) for t in texts]
        out, counts = [], Counter()
        m_ids, q_ids = m["node"].to_numpy(), q["node"].to_numpy()
        for i, j in verify(sets(m["text"]), m_ids, sets(q["text"]), q_ids, percent) if len(m) and len(q) else ():
            u, v = int(q_ids[i]), int(m_ids[j])
            if u == v:
                continue
            counts.update((u, v))
            if every:
                out.append((u, v, 1))
            elif root(u) != root(v):
                parent[root(u)] = root(v)
                out.append((u, v, 0))
        if not every:
            out += [(x, x, c) for x, c in counts.items()]
        return pd.DataFrame(out, columns=["u", "v", "n"], dtype="int64")

    return rows.groupBy("group", "salt").applyInPandas(match, "u long, v long, n long")


def _links(docs: DataFrame, percent: int, k: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """doc_id, n, key of all documents; links as ``_open`` gives them."""
    ids, shared = _index(docs, percent, k)
    groups = _groups(shared)
    qualified = _qualified(shared, groups, percent)
    places = words.store(_places(groups, qualified))
    found = words.store(_open(docs, places, percent, k, every))
    words.release(shared, groups, qualified, places)
    return ids, found


def links(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """Every pair u, v of representatives (smallest ids of equal sets) that reaches the similarity, once,
    the smaller set first."""
    return _links(docs, percent, k, True)[1].select("u", "v")


def linked_components(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, and n_links: to how many other sets the
    document's set is linked."""
    ids, found = _links(docs, percent, k, False)
    labels = graph.components(found.select("u", "v"))
    many = found.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n_links"))
    classes = ids.filter(F.col("n") > 0).groupBy("key").agg(F.min("doc_id").alias("node"))
    named = classes.join(labels, "node", "left").join(many, "node", "left").select("key", F.coalesce("component", "node").alias("component"), "n_links")
    return ids.join(named, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def components(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return linked_components(docs, percent, k).drop("n_links")


def first_of_each(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """The documents that are the smallest of their component, with the columns of ``docs``. Rows of one
    id stay or go together, those of a null id stay, and so do texts without words."""
    found = components(docs, percent, k)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(words.read(spark, sf_dir, "documents").select("doc_id", "text"))
