import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import lm, words
from tests.llm.conftest import words_of


def split(docs):
    return docs.filter(~words.in_fold(F.col("doc_id"), 7, 2))


def test_base_scores_equal_brute_force(docs, rows, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", lm.SHORTLIST + 50)  # most words take the joined way
    low = lambda t: words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    train = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    c = Counter(w for r in train for w in low(r[1]))
    n, v = sum(c.values()) + len(train), len(c) + 1
    model, counts = lm.fit(split(docs))
    assert model.total == n
    got = {r["doc_id"]: r for r in lm.score(docs.select("doc_id", "text"), model, counts).collect()}
    for i, t, *_ in rows:
        w = low(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        assert got[i]["n_tokens"] == len(w) + 1 and got[i]["n_known"] == sum(c[x] > 0 for x in w) + 1 and math.isclose(got[i]["base_score"], base, rel_tol=1e-9)
        assert got[i]["score"] < 0


def test_probabilities_sum_to_one():
    net, h = lm.Network(), np.random.default_rng(1).standard_normal((2, lm.HIDDEN)).astype(np.float32)
    every = np.arange(lm.SHORTLIST + 2)
    for row in h:
        lp, _ = net.log_probs(np.repeat(row[None], len(every), 0), every)
        assert abs(np.exp(lp.astype(np.float64)).sum() - 1) < 1e-4


def test_gradients_match_differences():
    net, r = lm.Network(), np.random.default_rng(2)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    ids, targets, mask = lm._lay([np.array([3, 40, lm.OTHER, 5, lm.END]), np.array([7, lm.END])], 0, 5)
    state = np.zeros((2, lm.HIDDEN))
    grads, *_ = net._window(ids, targets, mask, state)
    for name in net.w:
        flat = grads[name].ravel()
        for k in r.choice(np.flatnonzero(flat), 3):
            loss = []
            for d in (1e-3, -1e-3):
                net.w[name].ravel()[k] += d
                loss.append(-net._window(ids, targets, mask, state)[2])
                net.w[name].ravel()[k] -= d
            assert abs((loss[0] - loss[1]) / 2e-3 - flat[k]) < 2e-2 * max(1, abs(flat[k])), name


def test_state_is_carried_and_training_helps(monkeypatch):
    docs = [np.append(np.tile([1, 2, 3, 4], 30), lm.END) for _ in range(40)]
    net = lm.Network()
    before = net.score(docs[:1])[0]
    net.train(docs)
    after = net.score(docs[:1])[0]
    monkeypatch.setattr(lm, "STEPS", 7)  # other windows, the same state
    assert after > before + 50 and abs(net.score([docs[0], docs[0][:9]])[0] - after) < 1e-2


def test_score_equals_plain_steps():
    """Word by word, with whole softmaxes, as the model is defined."""
    r, net = np.random.default_rng(6), lm.Network()
    docs = [np.append(r.integers(0, lm.OTHER + 1, n), lm.END) for n in (0, 1, 130, 60, 49)]
    net.train(docs[2:], epochs=1)
    w, h_, sig = {k: v.astype(np.float64) for k, v in net.w.items()}, lm.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for doc, got in zip(docs, net.score(docs), strict=True):
        h, before, total = np.zeros(h_), lm.START, 0.0
        for s in doc:
            g, a = w["x"][before], h @ w["u"]
            z, reset = sig(g[:h_] + a[:h_]), sig(g[h_ : 2 * h_] + a[h_ : 2 * h_])
            n = np.tanh(g[2 * h_ :] + reset * a[2 * h_ :])
            h = (1 - z) * n + z * h
            classes = softmax(h @ w["c"] + w["bc"])
            if s >= lm.OTHER:
                total += np.log(classes[lm.CLASSES + (s == lm.END)])
            else:
                c, at = divmod(int(s), lm.PER_CLASS)
                part = slice(c * lm.PER_CLASS, (c + 1) * lm.PER_CLASS)
                total += np.log(classes[c]) + np.log(softmax(w["o"][part] @ h + w["bo"][part])[at])
            before = s
        assert abs(total - got) < 1e-3 * max(1, abs(total))


def test_batches_are_bounded_by_bytes():
    import pyarrow as pa

    texts = ["a" * 10, None, "b" * 100, "", "c" * 30, "d" * 30]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["i", "text"])
    parts = [b.column("text").to_pylist() for b in words.small_batches([batch], 3, 50)]
    assert parts == [["a" * 10, None], ["b" * 100], ["", "c" * 30], ["d" * 30]] and [x for p in parts for x in p] == texts
    assert list(words.small_batches([batch.slice(0, 0)])) == []


def test_odd_tables(clashing, empty, docs):
    model, counts = lm.fit(split(empty))
    assert lm.score(empty, model, counts).count() == 0 and model.total == 0
    model, counts = lm.fit(split(docs))
    out = lm.score(clashing, model, counts)
    assert out.count() == clashing.count() and dict(out.dtypes)["score"] == "double" and out.select("rid").first()[0] == "theirs"


def test_every_training_document_reaches_the_network(spark, monkeypatch):
    from tests.llm.conftest import SCHEMA

    for name, value in (("START_TOKENS", 1), ("START_DOCS", 1), ("SHARD", 8000)):
        monkeypatch.setattr(lm, name, value)
    texts = {i: "a b c d " * 40 if i % 2 else "d c b a " * 40 for i in range(600)} | {700: None, 701: "e " * 300}
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], SCHEMA)
    model, counts = lm.fit(table)
    assert model.total == sum(len(words_of(t)) + 1 for t in texts.values())
    again, _ = lm.fit(table.repartition(3))
    assert np.array_equal(model.network.flat(), again.network.flat())  # whatever the partitions
    got = {r["doc_id"]: r for r in lm.score(table.select("doc_id", "text"), model, counts).collect()}
    assert sum(got[i]["score"] for i in (0, 1)) > sum(got[i]["base_score"] for i in (0, 1)) + 20
    assert lm.train(table, model) == model.total  # each token of each document once


def test_lanes_hold_every_token_once():
    docs = [np.append(np.arange(n) % 7, lm.END) for n in (0, 3, 900, 5, 5, 60)]
    targets, ids, lengths = lm._lanes(docs, 3)
    on = np.arange(len(targets))[:, None] < lengths
    assert on.sum() == sum(map(len, docs)) and (ids[on] == lm.START).sum() == len(docs) == (targets[on] == lm.END).sum()


def test_softmax_of_far_logits():
    """Rows that exponentials of 32 bits cannot hold are moved to their greatest logit."""
    logits = np.array([[300.0, 299.0, -300.0], [-200.0, -201.0, -202.0]], np.float32)
    lp, e, total = lm._softmax(logits.copy(), np.array([1, 2]), 300.0)
    want = [logits[i].astype(float) - np.log(np.exp(logits[i].astype(float) - logits[i].max()).sum()) - logits[i].max() for i in (0, 1)]
    assert np.allclose(lp, [want[0][1], want[1][2]], atol=1e-4) and np.isfinite(e / total[:, None]).all()


def test_steps_and_softmax_take_few_calls(monkeypatch):
    """What a window costs beside its numbers: one batch of exponentials a step, and two of the softmax."""
    net, r, seen = lm.Network(), np.random.default_rng(3), []
    for_real = np.exp
    monkeypatch.setattr(lm.np, "exp", lambda *a, **k: seen.append(1) or for_real(*a, **k))
    ids = r.integers(0, lm.SHORTLIST, (24, 64))
    net._window(ids, ids, np.ones(ids.shape, bool), np.zeros((64, lm.HIDDEN), np.float32))
    assert len(seen) == 24 + 2


def test_scores_do_not_depend_on_what_is_scored_beside(monkeypatch):
    r, net = np.random.default_rng(8), lm.Network()
    docs = [np.append(r.integers(0, lm.OTHER + 1, n), lm.END) for n in (0, 7, 130, 60, 49, 1, 300)]
    whole = net.score(docs)
    monkeypatch.setattr(lm, "LANES", 2)
    monkeypatch.setattr(lm, "TOGETHER", 13)
    assert np.allclose(net.score(docs), whole, rtol=1e-5) and np.allclose([net.score([d])[0] for d in docs], whole, rtol=1e-5)


def test_codes_hold_only_words_of_the_table():
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    table, text = [b"b", b"a", b"c"], b"a b x a y x a z".split()
    codes = lm.Codes({digest(w): i for i, w in enumerate(table)})
    want = [table.index(w) if w in table else digest(w) for w in text]
    for _ in range(2):
        assert codes.of(text).tolist() == want
        assert codes.among(text, 1023).tolist() == [x if x < 3 else 1023 for x in want] and len(codes) == 2
    assert codes.among([b"c", b"q"], 1023).tolist() == [2, 1023] and len(codes) == 3
    assert codes.among(text, 1023).tolist() == [x if x < 3 else 1023 for x in want] and codes.of([]).tolist() == []
    many = [b"%d" % i for i in range(5000)]
    codes = lm.Codes({digest(w): i for i, w in enumerate(many[:3000])})
    assert codes.of(many).tolist() == [*range(3000), *map(digest, many[3000:])] and len(codes.levels) > 1
    assert lm.Codes({}).of(many[:2]).tolist() == [digest(w) for w in many[:2]]
    texts = [b"A b", b"", b"c\tx", b"b"]
    codes = lm.Codes({digest(w): i for i, w in enumerate(table)})
    assert [x.tolist() for x in codes.of_texts(texts, 3)] == [codes.of(t.lower().split()).tolist() for t in texts]
