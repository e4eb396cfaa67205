"""Toxicity by a linear-chain conditional random field.

Two states (clean, toxic) over the words of a text. Training: a bounded sample of labelled
documents gives, for each word form and beginning, how often toxic and clean documents hold it; those
that lean to toxic documents far beyond chance label the tokens of toxic documents, and those labelled
tokens train the field (the word's form, beginnings, ending and shape, and its neighbours' forms; full
gradients from forward-backward). Scoring: forward-backward marginals of every word of every
text; a logistic curve over their document totals, fitted on the same sample, gives the document's
score, and words with a marginal of one half or more give the offending offsets.

A text is laid out in rows of ``PIECE`` words, so that a very long one is many rows of one matrix; messages
pass from row to row, and marginals are those of the whole text.
Labels, language, source and id are never inputs of a score.

Null and empty texts have no words: they get the curve's value for no evidence, and no spans.
Repeated documents are scored alike, an empty table stays empty. Without usable labels every score is 0. The
columns tox_score and tox_spans are replaced where the input has them; all others come back as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import words

#: Words of a row of the layout.
PIECE = 64
#: Bits of the hashed word identities.
BITS = 17
#: Labelled documents to learn from, at most (about; chosen by a hash of their id).
SAMPLE = 8_000
#: Documents of the sample whose tokens train the field, at most.
FIELD_SAMPLE = 2_000
#: Evidence of a text without words.
NONE = np.array([-9.0, -9.0, 0.0])

_STRIP = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>#$%&*|+-=/\\_~^`@"
_TOKEN = re.compile(words.WORD)


def form(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(_STRIP)


def shape(word: bytes) -> int:
    """Five bits: capital first, digit, symbol inside, non-ASCII, longer than ten bytes."""
    return (65 <= word[0] <= 90) | (bool(re.search(rb"\d", word)) << 1) | (bool(re.search(rb"[#$%&*@=|]", word)) << 2) | ((max(word) > 127) << 3) | ((len(word) > 10) << 4)


def keys(f: str) -> list[str]:
    """What the field knows a form by: itself, its first three to six letters, its last three."""
    return [f, *(f"{n}^{f[:n]}" if len(f) > n else "" for n in (3, 4, 5, 6)), f"3${f[-3:]}" if len(f) > 3 else ""]


N_KEYS = 6


class Features(dict):
    """Word bytes -> row of ``slots`` (hashed keys) and ``shapes``; a memo, trimmed between batches."""

    limit = 400_000

    def __init__(self):
        super().__init__()
        self.slots, self.shapes = np.zeros((4096, N_KEYS), np.int32), np.zeros(4096, np.int8)

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        if row >= len(self.shapes):
            self.slots = np.concatenate([self.slots, np.zeros_like(self.slots)])
            self.shapes = np.concatenate([self.shapes, np.zeros_like(self.shapes)])
        self.slots[row] = [xxhash.xxh3_64_intdigest(k) >> (64 - BITS) if k else 0 for k in keys(form(word))]
        self.shapes[row] = shape(word)
        return row

    def rows(self, split: list[list[bytes]], total: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots and shapes of all words laid end to end."""
        at = np.fromiter((i for s in split for i in map(self.__getitem__, s)), np.int64, total)
        return self.slots[at], self.shapes[at]


def layout(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Cell of each word in a (pieces, PIECE) matrix, document by document; number of pieces."""
    pieces = -(-lengths // PIECE)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]]) * PIECE
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.arange(lengths.sum()) + np.repeat(first - starts, lengths), int(pieces.sum())


def _first(lengths: np.ndarray) -> np.ndarray:
    """Whether each piece begins a document."""
    pieces = -(-lengths // PIECE)
    out = np.zeros(int(pieces.sum()), bool)
    out[(np.cumsum(pieces) - pieces)[pieces > 0]] = True
    return out


def forward_backward(e: np.ndarray, mask: np.ndarray, trans: np.ndarray, start: float, first: np.ndarray | None = None):
    """Marginals of the toxic state (log odds), and both messages of every word, each up to a factor.

    e: score of the toxic state against the clean one, a row for each piece; trans[a, b]: score of a
    step from a to b; first: which pieces begin a document (all, if None). The others go on
    from the piece above. What a piece does to a message is a matrix of two states by two;
    messages pass from piece to piece through these, so that marginals are those of the whole document.
    Messages are kept as shares, scaled word by word.
    """
    p, n = e.shape
    first = np.ones(p, bool) if first is None else first
    t_, w = np.exp(trans).astype(np.float32), np.exp(np.clip(e, -30, 30)).astype(np.float32).T
    # come[t, s, k]: behind word t in state k, having come to the piece's first word in state s
    come = np.zeros((n, 2, 2, p), np.float32)
    come[0, 0, 0], come[0, 1, 1] = 1, w[0]
    short = np.flatnonzero(~mask.all(1))
    for t in range(1, n):
        before, now = come[t - 1], come[t]
        now[:, 0] = before[:, 0] * t_[0, 0] + before[:, 1] * t_[1, 0]
        now[:, 1] = (before[:, 0] * t_[0, 1] + before[:, 1] * t_[1, 1]) * w[t]
        now /= now.sum((0, 1))
        past = short[~mask[short, t]]  # behind the end of a text nothing changes
        now[..., past] = before[..., past]
    whole = come[-1]  # (2, 2, pieces)
    into, out = np.ones((2, p), np.float32), np.ones((2, p), np.float32)
    into[1] = np.exp(start)
    starts = np.flatnonzero(first)
    counts = np.diff(np.append(starts, p))
    for r in range(1, int(counts.max(initial=0))):
        at = starts[counts > r] + r
        behind = into[0, at - 1] * whole[0][:, at - 1] + into[1, at - 1] * whole[1][:, at - 1]
        into[:, at] = t_.T @ behind
        into[:, at] /= into[:, at].sum(0)
    for r in range(int(counts.max(initial=0)) - 1, 0, -1):
        at = starts[counts > r] + r
        ahead = whole[:, 0, at] * out[0, at] + whole[:, 1, at] * out[1, at]
        out[:, at - 1] = t_ @ ahead
        out[:, at - 1] /= out[:, at - 1].sum(0)
    a = into[0] * come[:, 0] + into[1] * come[:, 1]
    b = np.ones((n, 2, p), np.float32)
    b[-1] = out
    for t in range(n - 2, -1, -1):
        toxic = b[t + 1, 1] * w[t + 1]
        b[t, 0] = b[t + 1, 0] * t_[0, 0] + toxic * t_[0, 1]
        b[t, 1] = b[t + 1, 0] * t_[1, 0] + toxic * t_[1, 1]
        b[t] /= b[t].sum(0)
        b[t][:, ~mask[:, t + 1]] = 1
    share = np.maximum(a * b, np.float32(1e-37))
    return np.log(share[:, 1] / share[:, 0]).T, a, b


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Field:
    """Weights: keys and shape of the word, identity of the one before and after, steps. Slot 0 is no key."""

    def __init__(self):
        size = 1 << BITS
        self.word, self.before, self.after = (np.zeros(size, np.float32) for _ in range(3))
        self.shape = np.full(32, -4.0, np.float32)
        self.trans = np.zeros((2, 2), np.float32)
        self.start = np.float32(0)

    def emissions(self, ids: tuple, lengths: np.ndarray) -> np.ndarray:
        e = self.word[ids[0]].sum(1) + self.shape[ids[1]]
        slots = ids[0][:, 0]
        if len(slots) > 1:
            same = np.repeat(np.arange(len(lengths)), lengths)
            joined = same[1:] == same[:-1]
            e[1:] += self.before[slots[:-1]] * joined
            e[:-1] += self.after[slots[1:]] * joined
        return e

    def log_odds(self, ids: tuple, lengths: np.ndarray) -> np.ndarray:
        """Of each word's toxic state, for documents laid end to end."""
        cells, pieces = layout(lengths)
        e = np.zeros(pieces * PIECE, np.float32)
        mask = np.zeros(pieces * PIECE, bool)
        e[cells] = self.emissions(ids, lengths)
        mask[cells] = True
        shape_ = (pieces, PIECE)
        return forward_backward(e.reshape(shape_), mask.reshape(shape_), self.trans, self.start, _first(lengths))[0].reshape(-1)[cells]

    def fit(self, ids: tuple, lengths: np.ndarray, y: np.ndarray, rounds: int = 30, rate: float = 0.5, l2: float = 1e-4) -> None:
        cells, pieces = layout(lengths)
        size, n = 1 << BITS, max(1, len(y))
        mask = np.zeros(pieces * PIECE, bool)
        gold = np.zeros(pieces * PIECE, np.float32)
        mask[cells], gold[cells] = True, y
        mask, gold = mask.reshape(pieces, PIECE), gold.reshape(pieces, PIECE)
        slots, shapes = ids[0][:, 0], ids[1]
        flat = ids[0].reshape(-1)
        same = np.repeat(np.arange(len(lengths)), lengths)
        joined = same[1:] == same[:-1]
        steps, first = mask[:, 1:], _first(lengths)
        on = np.flatnonzero(~first)  # pieces that go on from the one above
        gold_steps = np.array([[((1 - gold[:, :-1]) * (1 - gold[:, 1:]) * steps).sum(), ((1 - gold[:, :-1]) * gold[:, 1:] * steps).sum()], [(gold[:, :-1] * (1 - gold[:, 1:]) * steps).sum(), (gold[:, :-1] * gold[:, 1:] * steps).sum()]])
        for i in range(2):
            for j in range(2):
                gold_steps[i, j] += ((gold[on - 1, -1] == i) & (gold[on, 0] == j)).sum()
        squares: dict = {}

        def step(name: str, value, grad):
            s = squares[name] = squares.get(name, 1e-8) + grad * grad
            return (value - rate * grad / np.sqrt(s)).astype(np.float32)

        for _ in range(rounds):
            e = np.zeros(pieces * PIECE, np.float32)
            e[cells] = self.emissions(ids, lengths)
            e = e.reshape(pieces, PIECE)
            odds, a, b = forward_backward(e, mask, self.trans, self.start, first)
            miss = (sigmoid(odds).reshape(-1)[cells] - y).astype(np.float32)
            t_, w = np.exp(self.trans), np.exp(np.clip(e, -30, 30)).T
            inner = np.array([[a[:-1, i] * t_[i, j] * b[1:, j] * (w[1:] if j else 1) for j in range(2)] for i in range(2)])
            across = np.array([[a[-1, i, on - 1] * t_[i, j] * b[0, j, on] * (w[0, on] if j else 1) for j in range(2)] for i in range(2)])
            expected = (inner / np.maximum(inner.sum((0, 1)), 1e-37) * steps.T).sum((2, 3)) + (across / np.maximum(across.sum((0, 1)), 1e-37)).sum(2)
            self.word = step("word", self.word, np.bincount(flat, np.repeat(miss, N_KEYS), size) / n + l2 / n * self.word)
            self.word[0] = 0
            self.before = step("before", self.before, np.bincount(slots[:-1][joined], miss[1:][joined], size) / n + 20 * l2 / n * self.before)
            self.after = step("after", self.after, np.bincount(slots[1:][joined], miss[:-1][joined], size) / n + 20 * l2 / n * self.after)
            self.shape = step("shape", self.shape, np.bincount(shapes, miss, 32) / n)
            self.trans = step("trans", self.trans, (expected - gold_steps) / n)
            self.start = step("start", self.start, (sigmoid(odds[first, 0]) - gold[first, 0]).sum() / n)


def evidence(log_odds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each document: log of the expected number of toxic words, highest log odds, log length."""
    out = np.tile(NONE, (len(lengths), 1))
    has = lengths > 0
    if has.any():
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[has]
        p = sigmoid(log_odds.astype(np.float64))
        out[has, 0] = np.log(np.add.reduceat(p, starts) + 1e-4)
        out[has, 1] = np.clip(np.maximum.reduceat(log_odds, starts), -9, 9)
        out[has, 2] = np.log1p(lengths[has])
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method; columns are standardised. Returns weights (last: intercept), means, scales."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, z.T @ (p - y) + ridge * w)
    return w, mean, scale


class Tagger:
    """The field with its document curve."""

    def __init__(self, texts: list[bytes], toxic: np.ndarray):
        self.field, self.curve = Field(), None
        toxic = np.asarray(toxic, bool)
        if toxic.any() and not toxic.all():
            self._fit(texts, toxic)

    def _fit(self, texts: list[bytes], toxic: np.ndarray) -> None:
        from collections import Counter

        # Only keys that three toxic documents hold are counted in clean ones.
        of = lambda t: {k for f in {form(w) for w in set(t.split())} for k in keys(f)[:5] if k}
        held = Counter(k for t, y in zip(texts, toxic, strict=True) if y for k in of(t))
        held = Counter({k: a for k, a in held.items() if a >= 3})
        clean = Counter(k for t, y in zip(texts, toxic, strict=True) if not y for k in of(t) if k in held)
        share = toxic.mean()
        bad = {k for k, a in held.items() if a > 0.7 * (n := a + clean[k]) and (a - n * share) / np.sqrt(n * share * (1 - share)) > 5}
        del held, clean
        features = Features()
        by_hash = np.argsort([xxhash.xxh3_64_intdigest(t) for t in texts], kind="stable")
        order = np.concatenate([by_hash[toxic[by_hash] == y][: FIELD_SAMPLE // 2] for y in (True, False)])
        chosen = [texts[i].split() for i in order]
        lengths = np.array([len(c) for c in chosen], np.int64)
        ids = features.rows(chosen, lengths.sum())
        y = np.fromiter((bool(toxic[i]) and not bad.isdisjoint(keys(form(w))[:5]) for i, c in zip(order, chosen, strict=True) for w in c), np.float32, lengths.sum())
        del chosen
        self.field.fit(ids, lengths, y)
        x = np.concatenate([self.measure(texts[i : i + 256], features)[0] for i in range(0, len(texts), 256)])
        self.curve = logistic(x, toxic.astype(float))

    def measure(self, texts: list[bytes], features: Features | None = None):
        """Evidence, log odds of all words laid end to end, and words of each document."""
        features = Features() if features is None else features
        features.trim()
        split = [t.split() for t in texts]
        lengths = np.array([len(s) for s in split], np.int64)
        ids = features.rows(split, lengths.sum())
        odds = self.field.log_odds(ids, lengths) if len(ids[1]) else np.empty(0, np.float32)
        return evidence(odds, lengths), odds, lengths

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(x))
        w, mean, scale = self.curve
        return sigmoid(np.c_[(x - mean) / scale, np.ones(len(x))] @ w)


def spans(text: bytes, odds: np.ndarray) -> list[dict]:
    """Offsets (code points) of the words whose marginal is one half or more."""
    hits = set(np.flatnonzero(odds >= 0).tolist())
    if not hits:
        return []
    return [{"start": m.start(), "end": m.end(), "marginal": float(sigmoid(odds[i]))} for i, m in enumerate(_TOKEN.finditer(text.decode("utf-8", "replace"))) if i in hits]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Tagger:
    """Fit on at most about ``sample`` labelled documents outside the held-out fold.

    The sample is a hash range of the labelled ids, so that its size is bounded before any text is
    read; conflicting labels of one id count as toxic.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~words.in_fold(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    chosen = known.filter(F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "toxic").toArrow()
    rows = rows.take(np.lexsort([rows["doc_id"].to_numpy()])) if rows.num_rows else rows
    return Tagger(rows["text"].to_pylist(), rows["toxic"].to_numpy() > 0)


def score(docs: DataFrame, tagger: Tagger, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Add ``tox_score`` (double) and ``tox_spans`` (start, end, marginal of each offending word)."""
    rest = [c for c in docs.columns if c not in ("tox_score", "tox_spans") and (keep_text or c != text)]
    given = docs.sparkSession.sparkContext.broadcast(tagger)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("marginal", T.DoubleType())])
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("tox_score", T.DoubleType()), T.StructField("tox_spans", T.ArrayType(span))])
    out_schema = words.arrow_schema(schema)

    def run(batches):
        features, model = Features(), given.value
        for batch in words.small_batches(batches, 256):
            ts = list(words.texts(batch, text))
            x, odds, lengths = model.measure(ts, features)
            ends = np.cumsum(lengths)
            found = [spans(t, odds[e - n : e]) for t, e, n in zip(ts, ends, lengths, strict=True)]
            cols = [batch.column(c).cast(out_schema.field(c).type) for c in rest] + [pa.array(model.score(x)), pa.array(found, out_schema.field("tox_spans").type)]
            yield pa.RecordBatch.from_arrays(cols, schema=out_schema)

    return docs.select(*dict.fromkeys([*rest, text])).mapInArrow(run, schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = words.read(spark, sf_dir, "documents").select("doc_id", "text")
    tagger = train(docs, words.read(spark, sf_dir, "labels"))
    return score(docs, tagger).select("doc_id", words.in_fold(F.col("doc_id"), 5, 0).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"), F.size("tox_spans").alias("n_spans"))
