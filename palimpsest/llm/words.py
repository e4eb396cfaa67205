"""Words, hashes and Arrow plumbing shared by the operators of this package.

A word is a maximal run of characters other than space and U+0009..U+000D.
``bytes.split()`` cuts UTF-8 at exactly those six bytes, so the Python operators
work on bytes and never decode a text they only have to count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.storage import cut, release, store

#: The word pattern, for Java's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"

#: Odd multiplier of the rolling hashes (modulo 2**64) and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def in_fold(doc_id, modulus: int, remainder: int):
    """True where crc32 of the id's text has this remainder. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


class WordHashes(dict):
    """Word bytes -> 64-bit hash, a memo that forgets all words at ``limit``."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**-i and BASE**i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for k, b in enumerate((BASE_INV, BASE)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit hash (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes; empty if there are fewer words."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    down, up = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * down, out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * up[: n - k + 1])


def sliding_min(h: np.ndarray, k: int) -> np.ndarray:
    """Minimum over every k consecutive values, by doubling."""
    if len(h) < k:
        return np.empty(0, h.dtype)
    width, m = 1, h
    while 2 * width <= k:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = k - width
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def texts(batch: pa.RecordBatch, column: str = "text"):
    """Texts of a batch as UTF-8 bytes; null is empty."""
    for value in batch.column(column).cast(pa.binary()):
        yield value.as_py() or b""


def small_batches(batches, rows: int = 512, size: int = 4 << 20):
    """Slices of at most ``rows`` rows and, but for a single text, ``size`` bytes of strings."""
    for batch in batches:
        strings = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
        each = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in strings), np.zeros(batch.num_rows, np.int64))
        ends, start = np.cumsum(each), 0
        while start < batch.num_rows:
            past = ends[start - 1] if start else 0
            end = min(batch.num_rows, start + rows, max(start + 1, int(np.searchsorted(ends, past + size, side="right"))))
            yield batch.slice(start, end - start)
            start = end


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def longs(values: np.ndarray) -> pa.Array:
    """uint64 hashes as Spark's signed longs, bit for bit."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def long_lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), longs(flat.astype(np.uint64, copy=False)))
