"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token in
one probe. Tier two: a miss starts as linked single bytes; a heap yields the adjacent
pair of lowest rank (leftmost on ties) until no pair is in the vocabulary. A bounded memo
stands before both, as texts repeat their words. The vocabulary is loaded, never trained; its path is a parameter.

Null texts count as empty; an empty text has no tokens and decodes to no bytes.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import words


def load_ranks(lines: list[str]) -> dict[bytes, int]:
    """Lines of ``base64 rank``."""
    return {base64.b64decode(a): int(b) for a, b in map(str.split, lines)}


def _slot(x: int, y: int, d: int, n: int) -> int:
    return ((((x + d * y) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 32) % n


class PerfectHash:
    """Minimal perfect hash by displacement: n keys, n slots, about 1/3 displacement a key.

    A key's bucket picks the displacement that sends its keys to free slots. Buckets
    are placed from the fullest down; those of one key take the remaining slots directly
    (stored as -1 - slot).
    """

    def __init__(self, ranks: dict[bytes, int], per_bucket: int = 3):
        n = self.n = max(1, len(ranks))
        m = self.m = max(1, n // per_bucket)
        buckets: list[list[tuple[int, int, bytes]]] = [[] for _ in range(m)]
        for key in ranks:
            h = xxhash.xxh3_128_intdigest(key)
            buckets[(h & 0xFFFFFFFF) % m].append(((h >> 32) & 0xFFFFFFFF, h >> 64, key))
        self.shift = [0] * m
        slots: list[bytes | None] = [None] * n
        for b in sorted(range(m), key=lambda b: -len(buckets[b])):
            keys = buckets[b]
            if len(keys) < 2:
                break
            d = 0
            while True:
                at = {_slot(x, y, d, n) for x, y, _ in keys}
                if len(at) == len(keys) and all(slots[s] is None for s in at):
                    break
                d += 1
            self.shift[b] = d
            for x, y, key in keys:
                slots[_slot(x, y, d, n)] = key
        free = iter([s for s in range(n) if slots[s] is None])
        for b, keys in enumerate(buckets):
            if len(keys) == 1:
                s = next(free)
                self.shift[b], slots[s] = -1 - s, keys[0][2]
        self.keys = slots
        self.ids = [ranks[k] if k is not None else -1 for k in slots]

    def get(self, key: bytes) -> int:
        """The key's id, or -1."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(h & 0xFFFFFFFF) % self.m]
        s = -1 - d if d < 0 else _slot((h >> 32) & 0xFFFFFFFF, h >> 64, d, self.n)
        return self.ids[s] if self.keys[s] == key else -1


def merge(piece: bytes, rank) -> list[int]:
    """Merge a pre-token's bytes, lowest rank and then leftmost pair first.

    ``rank`` gives the rank of a byte string, or None. Parts are linked by where they end
    (``end``) and where the part before starts (``before``). A heap entry packs rank, start and
    stop of a pair; it is stale once the pair that starts there stops elsewhere.
    """
    n = len(piece)
    bits = n.bit_length()
    mask = (1 << bits) - 1
    end = list(range(1, n + 1))
    before = list(range(-1, n))
    heap = []
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            heap.append((((r << bits) | i) << bits) | (i + 2))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        entry = pop(heap)
        stop, i = entry & mask, (entry >> bits) & mask
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        before[stop] = i
        if stop < n:
            far = end[stop]
            r = rank(piece[i:far])
            if r is not None:
                push(heap, (((r << bits) | i) << bits) | far)
        b = before[i]
        if b >= 0:
            r = rank(piece[b:stop])
            if r is not None:
                push(heap, (((r << bits) | b) << bits) | stop)
    out, i = [], 0
    while i < n:
        out.append(rank(piece[i : end[i]]))
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_limit: int = 600_000):
        self.hash = PerfectHash(ranks)
        self.rank = ranks.get
        self.pieces = regex.compile(pattern).findall
        self.bytes_of = {i: k for k, i in ranks.items()}
        codec = self

        class Memo(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= memo_limit:
                    self.clear()
                ids = self[piece] = np.array(codec.encode_piece(piece.encode()), "<u4").tobytes()
                return ids

        self.memo = Memo()

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.hash.get(piece)
        return [whole] if whole >= 0 else merge(piece, self.rank)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def _codec(lines: tuple[str, ...], pattern: str) -> Codec:
    return Codec(load_ranks(lines), pattern)


def _vocabulary(path: str) -> tuple[str, ...]:
    with open(path, encoding="ascii") as f:
        return tuple(line for line in f.read().splitlines() if line)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", decode_too: bool = False) -> DataFrame:
    """Add ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit), with
    ``decode_too`` also ``decoded`` (binary), instead of the text.

    The vocabulary file (under 1 MB, fixed) is read by the driver and broadcast; texts are
    encoded where they are, without a shuffle. Other columns pass through, except ones
    that have the names of the new columns, which are replaced.
    """
    new = ["n_tokens", "ids"] + ["decoded"] * decode_too
    rest = [c for c in df.columns if c not in (text, *new)]
    given = df.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.BinaryType())] * decode_too)
    out_schema = words.arrow_schema(schema)

    def run(batches):
        codec = _codec(given.value, pattern)
        for batch in words.small_batches(batches):
            ids = [codec.encode(t or "") for t in batch.column(text).to_pylist()]
            cols = [batch.column(c) for c in rest] + [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decode_too:
                cols.append(pa.array([codec.decode(i) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out_schema, strict=True)], schema=out_schema)

    return df.select(*rest, text).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Replace ``ids`` by the bytes they stand for, in ``decoded`` (binary)."""
    rest = [c for c in df.columns if c not in (ids, "decoded")]
    given = df.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField("decoded", T.BinaryType())])
    out_schema = words.arrow_schema(schema)

    def run(batches):
        codec = _codec(given.value, pattern)
        for batch in words.small_batches(batches):
            out = pa.array([codec.decode(i or b"") for i in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(c).cast(out_schema.field(c).type) for c in rest] + [out], schema=out_schema)

    return df.select(*rest, ids).mapInArrow(run, schema)


def tokenized(df: DataFrame) -> DataFrame:
    """Encode and decode ``documents`` with the production vocabulary."""
    import public_tokenizers

    return encode(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decode_too=True)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(words.read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
