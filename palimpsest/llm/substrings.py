"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is the corpus: every document is parsed against what stands in documents of smaller
id. The index of reference blocks holds every WINDOW-word window with the document and the position of
its first start, dealt by window hash. A document is parsed from left to right: a factor opens at a
window that the index knows from an earlier document, and grows greedily, word by word, while the next
window continues it at the next position of the same reference, so a factor is a substring of its
reference and has at least WINDOW words. Windows that straddle the boundary of two factors
have been looked up like any other, so a span across it is found where any document has it.

Hashes only propose. Every factor is compared with its reference text by digests of 128 bits, at each
WINDOW words of the reference and at the factor's end, before its words count as duplicates; one that
differs is dropped, and its words stay unless another factor has them.

The index would hold every window of the corpus, so a lossless sieve comes first: the least 8-gram hash
of a window is its anchor; equal windows have equal anchors, and an anchor of one document alone rules
its windows out. Documents whose word sequences are equal are parsed once: all but the least id are a
single factor.

First starts are minima, combined before they are shuffled, so a passage that a third of the
documents share is one row a task; the joins that hand them and the digests back are split by adaptive
execution where a window is hot. A reference is asked for a position once, so what it is asked for is
bounded by its length. Texts travel three times: to their shared anchors, to what is
asked of them, and to their factors.

Null and empty texts have no words; fewer than WINDOW words have no window and stay whole. Rows with
a null doc_id are neither reference nor changed. Rows of equal doc_id do not count as earlier than
each other. Hashes of windows are 64 bits, of whole sequences and in the comparison 128.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import words

WINDOW = 50
ANCHOR = 8
FACTOR = T.StructType([T.StructField(n, t) for n, t in (("start", T.IntegerType()), ("length", T.IntegerType()), ("reference", T.LongType()), ("position", T.IntegerType()))])


def _anchors_of(h: np.ndarray, window: int) -> np.ndarray:
    """The anchor of every window."""
    k = min(ANCHOR, window)
    return words.sliding_min(words.window_hashes(h, k), window - k + 1)


def _sketch(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, x, key (hash of the word sequence), anchors, of texts that have a window."""

    def run(batches):
        hashes = words.WordHashes()
        for batch in words.small_batches(batches):
            hs = [hashes.of(t.split()) for t in words.texts(batch)]
            keep = [i for i, h in enumerate(hs) if len(h) >= window]
            hs, batch = [hs[i] for i in keep], batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("x"), pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in hs], pa.binary()), words.long_lists([np.unique(_anchors_of(h, window)) for h in hs])],
                names=["doc_id", "x", "key", "anchors"],
            )

    return rows.mapInArrow(run, "doc_id long, x long, key binary, anchors array<long>")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, x, starts and hashes of the windows whose anchor is in ``anchors``."""

    def run(batches):
        hashes = words.WordHashes()
        for batch in words.small_batches(batches):
            starts, found = [], []
            for t, a in zip(words.texts(batch), batch.column("anchors"), strict=True):
                h = hashes.of(t.split())
                shared = np.sort(a.values.to_numpy(zero_copy_only=False).view(np.uint64))
                own = _anchors_of(h, window)
                at = np.minimum(np.searchsorted(shared, own), len(shared) - 1)
                hit = np.flatnonzero(shared[at] == own)
                starts.append(hit.astype(np.int32))
                found.append(words.window_hashes(h, window)[hit])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in starts])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("x"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(starts))), words.long_lists(found)], names=["doc_id", "x", "starts", "hashes"])

    return rows.mapInArrow(run, "doc_id long, x long, starts array<int>, hashes array<long>")


def _index(rows: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, x, copy_of of whole copies; doc_id, x, hits: (start, reference, position) of the windows
    that an earlier document holds."""
    sketch = words.store(_sketch(rows, window))
    classes = words.store(sketch.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    copies = words.store(sketch.select("doc_id", "x", "key").join(classes.filter(F.col("rows") > 1), "key").filter(F.col("doc_id") > F.col("least")).groupBy("doc_id", "x").agg(F.min("least").alias("copy_of")))

    least = classes.select("key", F.col("least").alias("doc_id"))
    anchors = sketch.join(least, ["key", "doc_id"], "left_semi").select("doc_id", F.explode("anchors").alias("anchor")).distinct()
    shared = anchors.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("anchor")
    wanted = words.store(anchors.join(shared, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors")))
    words.release(sketch, classes)
    found = words.store(_windows(rows.join(wanted, "doc_id").select("doc_id", "x", "text", "anchors"), window))
    words.release(wanted)
    each = found.select("doc_id", "x", F.explode(F.arrays_zip("starts", "hashes")).alias("w")).select("doc_id", "x", F.col("w.starts").alias("start"), F.col("w.hashes").alias("hash"))
    first = each.groupBy("hash").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last"))
    index = words.store(first.filter(F.col("first.doc_id") < F.col("last")).select("hash", F.col("first.doc_id").alias("reference"), F.col("first.start").alias("position")))
    hits = words.store(each.join(index, "hash").filter(F.col("reference") < F.col("doc_id")).groupBy("doc_id", "x").agg(F.collect_list(F.struct("start", "reference", "position")).alias("hits")))
    words.release(found, index)
    return copies, hits


def factors(starts: np.ndarray, references: np.ndarray, positions: np.ndarray, window: int) -> list[dict]:
    """The greedy parse: factors of known windows (sorted by start)."""
    if not len(starts):
        return []
    new = np.flatnonzero((np.diff(starts) != 1) | (np.diff(references) != 0) | (np.diff(positions) != 1)) + 1
    begin = np.concatenate([[0], new])
    end = np.concatenate([new, [len(starts)]]) - 1
    return [{"start": int(starts[b]), "length": int(starts[e] - starts[b] + window), "reference": int(references[b]), "position": int(positions[b])} for b, e in zip(begin, end, strict=True)]


def _parsed(hits: DataFrame, window: int) -> DataFrame:
    """doc_id, x and a row for each factor."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.LongType()), T.StructField("factors", T.ArrayType(FACTOR))])
    kind = words.arrow_schema(schema).field("factors").type

    def run(batches):
        for batch in words.small_batches(batches):
            out = []
            for row in batch.column("hits"):
                at = row.values
                starts, references, positions = (at.field(c).to_numpy() for c in ("start", "reference", "position"))
                order = np.argsort(starts, kind="stable")
                out.append(factors(starts[order], references[order], positions[order], window))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("x"), pa.array(out, kind)], names=["doc_id", "x", "factors"])

    return hits.mapInArrow(run, schema).select("doc_id", "x", F.explode("factors").alias("f"))


def digest(ws: list[bytes], at: int, window: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(ws[at : at + window]))


def _answers(rows: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """reference, position, digests of the asked windows of reference texts."""

    def run(batches):
        for batch in words.small_batches(batches):
            for t, d, ps in zip(words.texts(batch), batch.column("doc_id").to_pylist(), batch.column("positions").to_pylist(), strict=True):
                ws = t.split()
                ps = [p for p in ps if p + window <= len(ws)]
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(ps), pa.int64()), pa.array(ps, pa.int32()), pa.array([digest(ws, p, window) for p in ps], pa.binary())], names=["reference", "position", "digest"])

    positions = asked.groupBy(F.col("reference").alias("doc_id")).agg(F.collect_list("position").alias("positions"))
    # merged, not broadcast where little is asked: disk and shuffle then follow the input alike at every size
    given = rows.select("doc_id", "text").join(positions.hint("merge"), "doc_id")
    return given.mapInArrow(run, "reference long, position int, digest binary").groupBy("reference", "position").agg(F.collect_set("digest").alias("digests"))


def _decided(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, x, copy_of (of a whole copy) and factors, each with its checks (own position, digests)."""
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("x"))
    copies, hits = _index(rows, window)
    parsed = words.store(_parsed(hits, window))
    words.release(hits)
    last = F.col("f.position") + F.col("f.length") - window
    inner = F.when(F.floor(last / window) * window > F.col("f.position"), F.transform(F.sequence(F.floor(F.col("f.position") / window) + 1, F.floor(last / window)), lambda i: (i * window).cast("int"))).otherwise(F.array().cast("array<int>"))
    checks = parsed.select("doc_id", "x", "f", F.explode(F.array_distinct(F.concat(F.array("f.position", last), inner))).alias("at"))
    checks = checks.select("doc_id", "x", "f", F.col("f.reference").alias("reference"), F.col("at").alias("position"))
    answers = words.store(_answers(rows, checks.select("reference", "position").distinct(), window))
    own = F.struct((F.col("f.start") + F.col("position") - F.col("f.position")).alias("at"), F.coalesce("digests", F.array().cast("array<binary>")).alias("digests"))
    checked = checks.join(answers, ["reference", "position"], "left").groupBy("doc_id", "x", "f").agg(F.collect_list(own).alias("checks"))
    out = words.store(checked.groupBy("doc_id", "x").agg(F.collect_list(F.struct("f", "checks")).alias("found")).join(copies, ["doc_id", "x"], "full_outer"))
    words.release(parsed, answers, copies)
    return out


def dedupe(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Replace ``text`` by its words that are in no factor, joined by one space; add ``n_words``,
    ``n_removed`` and ``factors`` (start and length in words; reference document and position in it)."""
    new = ["n_words", "n_removed", "factors"]
    rest = [c for c in docs.columns if c not in ("text", *new)]
    decided = _decided(docs, window)
    mine = docs.select(*[F.col(c).alias(f"r_{i}") for i, c in enumerate(rest)], "doc_id" if "doc_id" not in rest else F.col("doc_id").alias("doc_id"), "text").withColumn("x", F.xxhash64("text"))
    joined = mine.join(decided, ["doc_id", "x"], "left").select(*[f"r_{i}" for i in range(len(rest))], "text", "copy_of", "found")
    schema = T.StructType([T.StructField(f"r_{i}", docs.schema[c].dataType) for i, c in enumerate(rest)] + [T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("factors", T.ArrayType(FACTOR))])
    out_schema = words.arrow_schema(schema)

    def run(batches):
        for batch in words.small_batches(batches):
            kept, counts, removed, parsed = [], [], [], []
            for t, copy, found in zip(words.texts(batch), batch.column("copy_of").to_pylist(), batch.column("found").to_pylist(), strict=True):
                ws = t.split()
                fs = sorted((x["f"] for x in found or [] if all(digest(ws, c["at"], window) in c["digests"] for c in x["checks"])), key=lambda f: f["start"])
                if copy is not None:
                    fs = [{"start": 0, "length": len(ws), "reference": copy, "position": 0}]
                gone = np.zeros(len(ws), bool)
                for f in fs:
                    gone[f["start"] : f["start"] + f["length"]] = True
                n = int(gone.sum())
                kept.append(b" ".join(ws) if not n else b" ".join([w for w, g in zip(ws, gone.tolist(), strict=True) if not g]))
                counts.append(len(ws))
                removed.append(n)
                parsed.append(fs)
            cols = [batch.column(f"r_{i}") for i in range(len(rest))] + [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(parsed, out_schema.field("factors").type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out_schema, strict=True)], schema=out_schema)

    out = joined.mapInArrow(run, schema)
    return out.select(*[F.col(f"r_{i}").alias(c) for i, c in enumerate(rest)], "text", *new)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(words.read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
