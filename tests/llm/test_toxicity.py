import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import toxicity
from tests.llm.conftest import SCHEMA, prose


def corpus(n=400):
    r, rows, labels = random.Random(9), [], []
    for i in range(n):
        w, bad = prose(r.randint(20, 150), i).split(" "), r.random() < 0.25
        if bad:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["zzvile", "zzrotten", "zznasty" + prose(1, r.random())])
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(bad)))
    return rows, labels


def test_learns_from_the_other_folds(spark):
    rows, labels = corpus()
    d, y = spark.createDataFrame(rows, SCHEMA), dict(labels)
    out = toxicity.score(d, toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int")), keep_text=True).collect()
    assert np.mean([(r["tox_score"] >= 0.5) == y[r["doc_id"]] for r in out]) > 0.95
    spans = [r["text"][s["start"] : s["end"]] for r in out for s in r["tox_spans"]]
    assert spans and np.mean([s.startswith("zz") for s in spans]) > 0.95


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(4)
    e, trans, start = r.standard_normal((3, 6)).astype(np.float32), r.standard_normal((2, 2)).astype(np.float32), 0.3
    mask = np.array([[True] * 6, [True] * 4 + [False] * 2, [True] + [False] * 5])
    odds, *_ = toxicity.forward_backward(np.where(mask, e, 0), mask, trans, start)
    for i, n in enumerate(mask.sum(1)):
        weight = np.zeros((n, 2))
        for states in itertools.product((0, 1), repeat=int(n)):
            s = start * states[0] + sum(e[i, t] * states[t] for t in range(n)) + sum(trans[states[t], states[t + 1]] for t in range(n - 1))
            for t in range(n):
                weight[t, states[t]] += np.exp(s)
        assert np.allclose(np.log(weight[:, 1] / weight[:, 0]), odds[i, :n], atol=1e-4)


def test_messages_cross_the_rows_of_a_text(monkeypatch):
    """Marginals of texts of many rows are those of one chain."""
    r = np.random.default_rng(5)
    trans, start = r.standard_normal((2, 2)).astype(np.float32) * 2, 0.7
    lengths = np.array([200, 3, 0, 64, 65, 1])
    e = [r.standard_normal(n).astype(np.float32) * 2 for n in lengths]
    cells, pieces = toxicity.layout(lengths)
    flat, mask = np.zeros(pieces * toxicity.PIECE, np.float32), np.zeros(pieces * toxicity.PIECE, bool)
    flat[cells], mask[cells] = np.concatenate(e), True
    shape = (pieces, toxicity.PIECE)
    first = toxicity._first(lengths)
    assert first.sum() == 5
    odds = toxicity.forward_backward(flat.reshape(shape), mask.reshape(shape), trans, start, first)[0].reshape(-1)[cells]
    ends = np.cumsum(lengths)
    for x, n, end in zip(e, lengths, ends, strict=True):
        if n:
            whole = toxicity.forward_backward(x[None].astype(np.float64), np.ones((1, n), bool), trans, start)[0][0]
            assert np.allclose(whole, odds[end - n : end], atol=2e-3)


def test_odd_rows(docs, clashing, empty, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["tox_score"] for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}
    labels = spark.createDataFrame([(1, 0), (12, 1), (12, 0), (9, 0), (None, 1), (16, None), (77, 1)], "doc_id long, toxic int")
    tagger = toxicity.train(docs, labels)
    out = toxicity.score(clashing, tagger, keep_text=True)
    assert out.count() == clashing.count() and out.filter(~F.col("tox_score").between(0, 1)).isEmpty() and set(clashing.columns) <= set(out.columns)
    by = {r["doc_id"]: r["tox_score"] for r in out.collect()}
    assert by[3] == by[4] == by[5] and by[1] == by[2] and toxicity.score(empty, tagger).count() == 0
