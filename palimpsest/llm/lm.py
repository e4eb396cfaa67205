"""Language-model scores by a gated recurrent network in numpy.

Counts cover all training documents. The SHORTLIST most frequent words, the end and one symbol for
every other word are what the network predicts; the other words share that symbol's probability in
proportion to their counts plus one, with one share for unseen words, so probabilities of a text sum
to one over texts. The softmax is factored: first a class, then the word within it; its biases start
at the counts of all training documents.

The network is trained by truncated backpropagation on every token of every training document. The
driver starts it on a bounded sample (``START_TOKENS``). Then documents are dealt by hash into ROUNDS
rounds and shards of about SHARD tokens; in a round every shard goes on from the same weights, and their
average, weighted by tokens, opens the next round. Weights are averaged by piece, so that no task and
not the driver gathers what grows with the input. In training and in scoring the state is carried from
one window of a document to the next, so every token of a text is scored behind its whole past.

The most frequent HEAD words are broadcast with their counts (a fixed size); rarer ones are
joined to the count table by hash, after combining those of a document. Words stand for their
64-bit hashes.

Null and empty texts consist of the end alone. Rows with a null doc_id belong to training. With no
training documents every count is 0 and the network is untrained. Repeated rows score alike.
"""

from __future__ import annotations

import heapq
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import words

HEAD = 1 << 16
CLASSES, PER_CLASS = 31, 33
SHORTLIST = CLASSES * PER_CLASS
HIDDEN = 24
#: Tokens and documents on which the driver starts the network, at most, and tokens of a document among them.
START_TOKENS, START_DOCS, START_EACH = 400_000, 3_000, 4_000
#: Rounds over the training documents, tokens of a shard of a round, pieces in which weights are averaged.
ROUNDS, SHARD, PIECES = 3, 1_500_000, 16
#: Step sizes of the first and the last window of the rounds.
RATES = 0.004, 0.0005
#: Steps of a window; documents scored side by side, and bytes of them.
STEPS, SIDE, SIDE_BYTES = 48, 4096, 16 << 20
#: Documents that are scored in step, and tokens whose softmax is in memory at once.
LANES, TOGETHER = 1024, 8192

OTHER, END, START = SHORTLIST, SHORTLIST + 1, SHORTLIST + 2
SYMBOLS = SHORTLIST + 3
_CLASS = np.concatenate([np.arange(SHORTLIST) // PER_CLASS, [CLASSES, CLASSES + 1]]).astype(np.int8)


def _softmax(logits: np.ndarray, pick: np.ndarray, spread: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of each row's pick; exponentials of the logits, in their place, and their sums by row.

    spread: how far a row's greatest logit may be from 0, beyond which rows are moved to it."""
    if not spread < 80:
        logits -= logits.max(1, keepdims=True)
    chosen = logits[np.arange(len(pick)), pick]
    e = np.exp(logits, out=logits)
    total = e @ np.ones(e.shape[1], e.dtype)
    return chosen - np.log(total), e, total


class Network:
    """GRU whose inputs are rows of a table of gate inputs, with a class-factored softmax."""

    def __init__(self, seed: int = 7):
        r, h = np.random.default_rng(seed), HIDDEN
        draw = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        self.w = {"x": draw(SYMBOLS, 3 * h), "u": draw(h, 3 * h), "c": draw(h, CLASSES + 2), "bc": np.zeros(CLASSES + 2, np.float32), "o": draw(SHORTLIST, h), "bo": np.zeros(SHORTLIST, np.float32)}

    def run(self, ids: np.ndarray, state: np.ndarray, keep: list | None = None, on: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States behind each step of ids (steps, rows), and the last; where ``on`` is 0 the state before is forgotten.

        ``keep`` takes the states before, gates (z, r), candidates and their recurrent inputs of all steps."""
        h, kind, (steps, rows) = HIDDEN, self.w["x"].dtype, ids.shape
        # by gate; of z and r negated, as the sigmoid needs them
        x, u = (np.ascontiguousarray(self.w[k].reshape(-1, 3, h).transpose(1, 0, 2)) * np.array([-1, -1, 1], kind)[:, None, None] for k in ("x", "u"))
        out = np.empty((steps, rows, h), kind)
        if keep is not None:
            keep += [np.empty((steps, rows, h), kind), np.empty((steps, 2, rows, h), kind), np.empty((steps, rows, h), kind), np.empty((steps, rows, h), kind)]
        g, a = np.empty((2, 3, rows, h), kind)
        with np.errstate(over="ignore"):  # 1 / inf is 0
            for t in range(steps):
                if on is not None:
                    state = state * on[t]
                np.take(x, ids[t], axis=1, out=g, mode="clip")
                np.matmul(state, u, out=a)
                zr = a[:2] if keep is None else keep[1][t]
                np.add(a[:2], g[:2], out=zr)
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                n = g[2]
                if keep is not None:
                    keep[0][t], keep[3][t] = state, a[2]
                a[2] *= zr[1]
                n += a[2]
                np.tanh(n, out=n)
                if keep is not None:
                    keep[2][t] = n
                new = np.subtract(state, n, out=out[t])
                new *= zr[0]
                new += n
                state = new
        return out, state

    def log_probs(self, h: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each target behind its state; with grads, the gradient of
        their negative sum by the state, and by the weights."""
        kind = self.w["o"].dtype
        # biases as weights of an input that is always 1, less the greatest of the softmax
        c = np.concatenate([self.w["c"], [self.w["bc"] - self.w["bc"].max()]]).astype(kind)
        bo = self.w["bo"].reshape(CLASSES, PER_CLASS)
        o = np.concatenate([self.w["o"], (bo - bo.max(1, keepdims=True)).reshape(-1, 1)], 1)
        spreads = [float(np.abs(w).sum(axis).max()) for w, axis in ((c[:-1], 0), (o[:, :-1], 1))]
        out, dh = np.empty(len(targets), kind), None if grads is None else np.empty(h.shape, kind)
        for at in range(0, len(targets), TOGETHER):
            part = slice(at, at + TOGETHER)
            cls = _CLASS[targets[part]]
            order = np.argsort(cls, kind="stable")
            cls, hs = cls[order], np.ones((len(order), HIDDEN + 1), kind)
            hs[:, :-1] = h[part][order]
            most = max(1.0, float(np.abs(hs).max()))
            edges = np.searchsorted(cls, np.arange(CLASSES + 1))
            spans = [(slice(edges[k], edges[k + 1]), slice(k * PER_CLASS, (k + 1) * PER_CLASS)) for k in range(CLASSES) if edges[k] < edges[k + 1]]
            lp, e, total = _softmax(hs @ c, cls, most * spreads[0])
            inner = np.empty((edges[-1], PER_CLASS), kind)
            for rows, span in spans:
                np.matmul(hs[rows], o[span].T, out=inner[rows])
            pick = targets[part][order[: edges[-1]]] - cls[: edges[-1]].astype(np.int64) * PER_CLASS
            within, f, within_total = _softmax(inner, pick, most * spreads[1])
            lp[: edges[-1]] += within
            back = np.empty_like(lp)
            back[order] = lp
            out[part] = back
            if grads is None:
                continue
            e /= total[:, None]
            e[np.arange(len(cls)), cls] -= 1
            by = hs.T @ e
            grads["c"] += by[:-1]
            grads["bc"] += by[-1]
            d = e @ c[:-1].T
            f /= within_total[:, None]
            f[np.arange(len(pick)), pick] -= 1
            for rows, span in spans:
                by = f[rows].T @ hs[rows]
                grads["o"][span] += by[:, :-1]
                grads["bo"][span] += by[:, -1]
                d[rows] += f[rows] @ o[span, :-1]
            dh[part][order] = d
        return out, dh

    def _window(self, ids, targets, mask, state, carry=None) -> tuple[dict, np.ndarray, float, int]:
        keep: list = []
        hs, last = self.run(ids, state, keep, carry)
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        on = mask.ravel()
        flat = hs.reshape(-1, HIDDEN)
        lp, dh = self.log_probs(flat[on], targets.ravel()[on], grads)
        up = np.zeros_like(flat)
        up[on] = dh
        up = up.reshape(hs.shape)
        h, back, (prev, zr, n, an) = HIDDEN, np.zeros(state.shape, hs.dtype), keep
        z, r = zr[:, 0], zr[:, 1]
        by_n = (1 - z) * (1 - n * n)
        by_z = (prev - n) * z * (1 - z)
        by_r = an * r * (1 - r)
        u = np.ascontiguousarray(self.w["u"].reshape(h, 3, h).transpose(1, 2, 0))
        dn, da, passed = np.empty_like(hs), np.empty((3, *hs.shape), hs.dtype), np.empty((3, *state.shape), hs.dtype)
        for t in range(len(ids) - 1, -1, -1):
            back += up[t]
            np.multiply(back, by_n[t], out=dn[t])
            np.multiply(back, by_z[t], out=da[0, t])
            np.multiply(dn[t], by_r[t], out=da[1, t])
            np.multiply(dn[t], r[t], out=da[2, t])
            np.matmul(da[:, t], u, out=passed)
            back *= z[t]
            for p in passed:
                back += p
            if carry is not None:
                back *= carry[t]
        before = prev.reshape(-1, h).T
        grads["u"] += np.concatenate([before @ d.reshape(-1, h) for d in da], 1)
        order = np.argsort(ids.ravel().astype(np.int16), kind="stable")
        seen, first = np.unique(ids.ravel()[order], return_index=True)
        for k, d in enumerate((da[0], da[1], dn)):
            grads["x"][seen, k * h : (k + 1) * h] = np.add.reduceat(d.reshape(-1, h)[order], first, axis=0)
        return grads, last, float(lp.sum()), int(on.sum())

    def train(self, docs: list[np.ndarray], side: int = 32, steps: int = 24, epochs: int = 3, rates: tuple[float, float] = (0.01, 0.001)) -> int:
        """docs: symbols of each, ending in END; every token counts once an epoch. Returns the tokens of an epoch.

        Documents follow one another in ``side`` lanes; the state is forgotten between them."""
        m, v = ({n: np.zeros_like(w) for n, w in self.w.items()} for _ in range(2))
        r, k, trained = np.random.default_rng(11), 0, 0
        for epoch in range(epochs):
            targets, ids, lengths = _lanes([docs[i] for i in r.permutation(len(docs))], side)
            state, trained = np.zeros((targets.shape[1], HIDDEN), np.float32), 0
            for at in range(0, len(targets), steps):
                live = int((lengths > at).sum())
                part = slice(at, at + steps), slice(0, live)
                mask = np.arange(at, at + len(targets[part]))[:, None] < lengths[:live]
                grads, state, _, n = self._window(ids[part], targets[part], mask, state[:live], (ids[part] != START)[..., None].astype(np.float32))
                k, trained = k + 1, trained + n
                done = (epoch + at / len(targets)) / epochs
                lr = np.float32((rates[0] + (rates[1] - rates[0]) * done) * n / (steps * targets.shape[1]))  # lanes that have ended count as none
                for name, g in grads.items():
                    g *= np.float32(steps / n)
                    np.clip(g, -5, 5, out=g)
                    m[name] *= np.float32(0.9)
                    m[name] += np.float32(0.1) * g
                    v[name] *= np.float32(0.99)
                    v[name] += np.float32(0.01) * np.square(g, out=g)
                    by = np.sqrt(v[name])
                    by *= np.float32(1 / (1 - 0.99**k) ** 0.5)
                    by += np.float32(1e-6)
                    np.divide(m[name], by, out=by)
                    by *= lr / np.float32(1 - 0.9**k)
                    self.w[name] -= by
        return trained

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.w.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name, w in self.w.items():
            self.w[name] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each document's symbols, whole."""
        out = np.zeros(len(docs))
        order = np.argsort([-len(d) for d in docs], kind="stable")
        for first in range(0, len(docs), LANES):
            places = order[first : first + LANES]
            flat = np.concatenate([docs[i] for i in places])
            lengths = np.array([len(docs[i]) for i in places])
            starts = np.cumsum(lengths) - lengths
            state, sums = np.zeros((len(places), HIDDEN), np.float32), np.zeros(len(places))
            for at in range(0, lengths[0], STEPS):
                live = int((lengths > at).sum())
                ids, targets, mask = _cut(flat, starts[:live], lengths[:live], at, STEPS)
                hs, state = self.run(ids, state[:live])
                on = mask.ravel()
                lp, _ = self.log_probs(hs.reshape(-1, HIDDEN)[on], targets.ravel()[on])
                sums[:live] += np.bincount(np.tile(np.arange(live), len(ids))[on], lp, live)
            out[places] = sums
        return out


def _lanes(docs: list[np.ndarray], side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets and inputs (steps, lanes) of documents one behind the other, and the lengths of the
    lanes, the longest first. A document goes to the lane that is shortest so far; documents longer
    than an even share go first."""
    lanes: list[list[np.ndarray]] = [[] for _ in range(min(side, len(docs)))]
    heap, even = [(0, i) for i in range(len(lanes))], sum(map(len, docs)) / max(1, side)
    for d in sorted(docs, key=lambda d: -len(d) if len(d) > even else 0):
        n, i = heap[0]
        lanes[i].append(d)
        heapq.heapreplace(heap, (n + len(d), i))
    rows = sorted((np.concatenate(x) for x in lanes), key=len, reverse=True)
    lengths = np.array([len(x) for x in rows], np.int64)
    shape = (int(lengths[0]) if len(rows) else 0, len(rows))
    targets, ids = np.full(shape, END, np.int64), np.full(shape, START, np.int64)
    for j, x in enumerate(rows):
        targets[: len(x), j] = x
        ids[1 : len(x), j] = np.where(x[:-1] == END, START, x[:-1])
    return targets, ids, lengths


def _lay(group: list[np.ndarray], at: int, steps: int):
    """Inputs, targets and mask (steps, rows) of a window from ``at``."""
    lengths = np.array([len(d) for d in group])
    return _cut(np.concatenate(group), np.cumsum(lengths) - lengths, lengths, at, steps)


def _cut(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: int, steps: int):
    """The same, of documents that lie end to end."""
    t = np.arange(at, at + min(steps, int(lengths.max()) - at))[:, None]
    mask = t < lengths
    place = np.where(mask, starts + t, 0)
    targets = np.where(mask, flat[place], END)
    ids = np.where(mask & (t > 0), flat[place - 1], START)
    return ids, targets, mask


def hashed(words_: list[bytes]) -> np.ndarray:
    """Hashes of words, without a memo: where most words are rare, looking one up takes longer."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words_), np.uint64, len(words_))


class Codes(dict):
    """Places of the words in a table of hashes; a memo of those of them that were met.

    Hashes are found by levels of slots, each for those whose slot in the level before is another's."""

    def __init__(self, rank: dict[int, int]):
        super().__init__()
        self.rank, self.levels = rank, []
        hashes, places = np.fromiter(rank.keys(), np.uint64, len(rank)), np.fromiter(rank.values(), np.uint64, len(rank))
        factor = words.BASE
        while len(hashes):
            odd, bits = np.uint64(factor), len(hashes).bit_length() + 2
            slot = (hashes * odd) >> np.uint64(64 - bits)
            _, first = np.unique(slot, return_index=True)
            table = np.full(1 << bits, first[0], np.int32)
            table[slot[first]] = first
            self.levels.append((odd, np.uint64(64 - bits), table, hashes, places))
            hashes, places = np.delete(hashes, first), np.delete(places, first)
            factor = (factor * words.BASE + 2) % (1 << 64)  # odd

    def of(self, words_: list[bytes]) -> np.ndarray:
        """Places, or hashes (moved to HEAD or above)."""
        h = hashed(words_)
        out = np.where(h < HEAD, h + np.uint64(HEAD), h)
        rest = np.arange(len(h))
        for odd, shift, table, hashes, places in self.levels:
            at = table[(h * odd) >> shift]
            found = hashes[at] == h
            out[rest[found]] = places[at[found]]
            h, rest = h[~found], rest[~found]
        return out

    def of_texts(self, texts, together: int = 256) -> list[np.ndarray]:
        """The same for each text, as many at once."""
        out, texts = [], iter(texts)
        while split := [t.lower().split() for t in islice(texts, together)]:
            codes = self.of(list(chain.from_iterable(split)))
            out += np.split(codes, np.cumsum([len(x) for x in split])[:-1])
        return out

    def among(self, words_: list[bytes], other: int) -> np.ndarray:
        """Places (16-bit), and ``other`` for words outside the table: once all of it was met, without their hashes."""
        if len(self) < len(self.rank):
            places = self.of(words_)
            self.update((words_[i], int(places[i])) for i in np.flatnonzero(places < HEAD).tolist())
            return np.where(places < HEAD, places, np.uint64(other)).astype(np.int16)
        return np.fromiter(map(self.get, words_, repeat(other)), np.int16, len(words_))


class Model:
    """Counts of the head and totals, and the network."""

    def __init__(self, head: list[tuple[int, int]], n_words: int, n_distinct: int, n_docs: int):
        self.rank = {h & 0xFFFFFFFFFFFFFFFF: i for i, (h, _) in enumerate(head)}
        counts = np.array([c for _, c in head], np.float64)
        self.total, self.n_docs = n_words + n_docs, n_docs
        distinct = n_distinct + (1 if n_docs else 0)
        #: Denominators of the base score and of a word within OTHER.
        self.base_total = self.total + distinct + 1
        short = counts[:SHORTLIST]
        self.other_total = n_words - short.sum() + n_distinct - len(short) + 1
        self.base = np.log10((counts + 1) / self.base_total)
        self.inside = np.where(np.arange(len(counts)) < SHORTLIST, 0.0, np.log10((counts + 1) / self.other_total))
        self.end_base = float(np.log10((n_docs + 1) / self.base_total))
        self.network = Network()
        if n_docs:
            w = np.ones(SHORTLIST)
            w[: len(short)] += short
            self.network.w["bo"] = np.log(w).astype(np.float32)
            self.network.w["bc"] = np.log([*w.reshape(CLASSES, PER_CLASS).sum(1), self.other_total, n_docs + 1]).astype(np.float32)

    def codes(self) -> Codes:
        """Words to their place in the head, or to their hash (never below HEAD)."""
        return Codes(self.rank)


def symbols(codes: np.ndarray) -> np.ndarray:
    """What the network reads: shortlist places, OTHER, and END last."""
    return np.append(np.minimum(codes, np.uint64(OTHER)).astype(np.int64), END)


def count_words(docs: DataFrame, chunk: int = 4_000_000) -> DataFrame:
    """hash and count of every word of the texts, combined by partition before the shuffle."""

    def run(batches):
        held, n = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([words.longs(h), pa.array(c.astype(np.int64))], names=["hash", "c"])

        for batch in words.small_batches(batches):
            for t in words.texts(batch):
                h = hashed(t.lower().split())
                held.append(h)
                n += len(h)
            if n >= chunk:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return docs.select("text").mapInArrow(run, "hash long, c long").groupBy("hash").agg(F.sum("c").alias("c"))


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of these documents, and their count table (hash, c)."""
    counts = words.store(count_words(docs))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_docs = docs.count()
    head = [(r["hash"], r["c"]) for r in counts.orderBy(F.desc("c"), "hash").limit(HEAD).collect()]
    model = Model(head, total["n"], total["v"], n_docs)
    if n_docs:
        start(docs, model, n_docs)
        train(docs, model)
    return model, counts


def start(docs: DataFrame, model: Model, n_docs: int) -> None:
    """Train the network on a bounded sample, from which the rounds go on."""
    share = min(1.0, START_DOCS / n_docs)
    text = F.substring(F.coalesce(F.col("text"), F.lit("")), 1, 16 * START_EACH)
    chosen = docs.filter(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).select("doc_id", text.cast("binary").alias("text")).toArrow()
    codes, sample, n = model.codes(), [], 0
    for i in np.lexsort([[xxhash.xxh3_64_intdigest(str(x)) for x in chosen["doc_id"].to_pylist()]]) if chosen.num_rows else []:
        sample.append(symbols(codes.of(chosen["text"][int(i)].as_py().lower().split()[:START_EACH])))
        n += len(sample[-1])
        if n >= START_TOKENS:
            break
    if sample:
        model.network.train(sample)


def encode(docs: DataFrame, model: Model) -> DataFrame:
    """symbols of every document (16-bit), its place in the deal, and n."""
    given = docs.sparkSession.sparkContext.broadcast([h for h, i in model.rank.items() if i < SHORTLIST])

    def run(batches):
        codes = Codes({h: i for i, h in enumerate(given.value)})
        for batch in words.small_batches(batches):
            rows = [np.append(codes.among(t.lower().split(), OTHER), np.int16(END)) for t in words.texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "n", "symbols"])

    ids = docs.select(F.xxhash64(F.col("doc_id").cast("string")).alias("doc_id"), "text")
    return ids.mapInArrow(run, "doc_id long, n long, symbols binary").select(F.xxhash64(F.lit(3), "doc_id", "symbols").alias("deal"), "n", "symbols")


def _shard(given, rates):
    def run(key, table):
        table = table.sort_by([("deal", "ascending"), ("n", "ascending")])
        net = Network()
        net.load(given.value)
        docs = [np.frombuffer(x.as_py(), np.int16) for x in table["symbols"]]
        n = net.train(docs, side=max(16, min(256, sum(map(len, docs)) // 4096)), epochs=1, rates=rates)
        pieces = [p.tobytes() for p in np.array_split(net.flat(), PIECES)]
        return pa.table({"piece": pa.array(range(PIECES), pa.int64()), "shard": pa.array([key[0].as_py()] * PIECES, pa.int64()), "n": pa.array([n] * PIECES, pa.int64()), "w": pa.array(pieces, pa.binary())})

    return run


def _average(key, table):
    """Mean of a piece of the weights over shards, by their tokens; in the order of shards, so that it repeats."""
    total, w = sum(table["n"].to_pylist()), 0.0
    for _, n, x in sorted(zip(table["shard"].to_pylist(), table["n"].to_pylist(), table["w"].to_pylist(), strict=True)):
        w = w + np.frombuffer(x, np.float32).astype(np.float64) * (n / total)
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([total], pa.int64()), "w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})


def train(docs: DataFrame, model: Model) -> int:
    """Train the network on all documents, each in one round; returns the tokens trained on."""
    spark = docs.sparkSession
    coded, trained = words.store(encode(docs, model)), 0
    shards = -(-model.total // (ROUNDS * SHARD))
    for k in range(ROUNDS):
        given, rates = spark.sparkContext.broadcast(model.network.flat()), [RATES[0] * (RATES[1] / RATES[0]) ** (i / ROUNDS) for i in (k, k + 1)]
        mine = coded.filter(F.pmod("deal", F.lit(ROUNDS)) == k).withColumn("shard", F.pmod(F.xxhash64("deal"), F.lit(shards)))
        learned = mine.groupBy("shard").applyInArrow(_shard(given, rates), "piece long, shard long, n long, w binary")
        pieces = learned.groupBy("piece").applyInArrow(_average, "piece long, n long, w binary").collect()
        if pieces:
            model.network.load(np.concatenate([np.frombuffer(r["w"], np.float32) for r in sorted(pieces, key=lambda r: r["piece"])]))
            trained += pieces[0]["n"]
        given.unpersist()
    return trained


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Add n_tokens, n_known (long), base_score and score (double) instead of the text."""
    new = ["n_tokens", "n_known", "base_score", "score"]
    rest = [c for c in docs.columns if c not in ("text", *new)]
    given = docs.sparkSession.sparkContext.broadcast(model)
    own = ", ".join(f"r{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest))
    schema = f"rid long, {own}, n_tokens long, known long, base double, lm double, tail array<long>, times array<long>"

    def run(batches):
        m = given.value
        codes = m.codes()
        for batch in words.small_batches(batches, SIDE, SIDE_BYTES):
            rows = codes.of_texts(words.texts(batch))
            lm = m.network.score([symbols(r) for r in rows]) / np.log(10)
            flat, lengths = np.concatenate(rows), np.array([len(r) for r in rows])
            of, head = np.repeat(np.arange(len(rows)), lengths), flat < HEAD
            at, mine = flat[head].astype(np.int64), of[head]
            known = np.bincount(mine, minlength=len(rows)) + (m.n_docs > 0)
            base = np.bincount(mine, m.base[at], len(rows)) + m.end_base
            lm += np.bincount(mine, m.inside[at], len(rows))
            tails, times = [], []
            for r in np.split(flat[~head], np.cumsum(lengths - np.bincount(mine, minlength=len(rows)))[:-1]):
                h, c = np.unique(r, return_counts=True) if len(r) > 1 else (r, np.ones(len(r), np.int64))
                tails.append(h)
                times.append(c.astype(np.uint64))
            cols = [batch.column("rid"), *(batch.column(f"r{i}") for i in range(len(rest))), pa.array([len(r) + 1 for r in rows], pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(lm), words.long_lists(tails), words.long_lists(times)]
            yield pa.RecordBatch.from_arrays(cols, names=["rid", *(f"r{i}" for i in range(len(rest))), "n_tokens", "known", "base", "lm", "tail", "times"])

    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), *[F.col(c).alias(f"r{i}") for i, c in enumerate(rest)], "text")
    scored = words.store(numbered.mapInArrow(run, schema))
    tail = scored.select("rid", F.explode(F.arrays_zip("tail", "times")).alias("w")).select("rid", F.col("w.tail").alias("hash"), F.col("w.times").alias("k"))
    c = F.coalesce("c", F.lit(0))
    found = tail.join(counts, "hash", "left").groupBy("rid").agg(
        F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("k_known"),
        F.sum(F.col("k") * F.log10((c + 1) / F.lit(float(model.base_total)))).alias("k_base"),
        F.sum(F.col("k") * F.log10((c + 1) / F.lit(float(model.other_total)))).alias("k_lm"),
    )
    zero = F.lit(0)
    return scored.drop("tail", "times").join(found, "rid", "left").select(
        *[F.col(f"r{i}").alias(c) for i, c in enumerate(rest)], "n_tokens", (F.col("known") + F.coalesce("k_known", zero)).alias("n_known"),
        (F.col("base") + F.coalesce("k_base", zero)).alias("base_score"), (F.col("lm") + F.coalesce("k_lm", zero)).alias("score"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = words.read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = words.in_fold(F.col("doc_id"), 7, 2)
    model, counts = fit(docs.filter(~held_out))
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, counts).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model.total)).cast("long").alias("train_tokens"), "base_score", "score")
