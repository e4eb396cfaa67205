import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing
from tests.llm.conftest import SCHEMA


def frame(spark, counts):
    rows = [(i, "t", "en", s, 1) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    return spark.createDataFrame(rows, SCHEMA)


def test_every_prefix_is_within_one_block():
    r = random.Random(1)
    for _ in range(20):
        w = {f"s{i}": r.randint(1, 90) for i in range(r.randint(1, 12))}
        slots, q = mixing.period(w), sum(w.values())
        assert sorted(t for x in slots.values() for t in x) == list(range(q))
        for s, p in w.items():
            for t in range(q + 1):
                assert abs(sum(x < t for x in slots[s]) - t * p / q) < 1
            for k, t in enumerate(slots[s]):
                assert k * q // p <= t < -(-(k + 1) * q // p)


def test_all_documents_once_and_target_held(spark):
    counts = {"a": 330, "b": 90, "c": 48, "": 7}
    out = mixing.schedule(frame(spark, counts), {"a": 0.5, "b": 0.3, "c": 0.15, "": 0.05}, block=4).collect()
    assert len(out) == sum(counts.values()) and len({r["seq"] for r in out}) == len(out)
    slots = {}
    for r in out:
        assert slots.setdefault(r["slot"], r["source"]) == r["source"]
    order = [slots[t] for t in range(len(slots))]
    share, seen = {"a": 0.5, "b": 0.3, "c": 0.15, "": 0.05}, Counter()
    for t, s in enumerate(order, 1):
        seen[s] += 1
        if seen[""] == 2:
            break  # the smallest source has run out
        assert all(abs(seen[x] - t * share[x]) < 1.01 for x in share)


def test_hot_source_nulls_ties_and_empty(spark, docs, empty):
    one = mixing.schedule(frame(spark, {"only": 40}), block=8).collect()
    assert sorted(r["seq"] for r in one) == list(range(40))
    twice = mixing.schedule(docs.unionAll(docs)).collect()
    assert len(twice) == 2 * docs.count() == len({r["seq"] for r in twice})
    assert mixing.schedule(empty).count() == 0 and mixing.mixed(empty).columns == empty.columns
    with pytest.raises(KeyError):
        mixing.schedule(docs, {"s0": 1.0})


def test_columns_come_back_with_their_values(docs, clashing):
    names = ["_h", "_i", "_k", "_o", "_p", "_x", "row", "s", "h", "r", "i", "id", "k", "x", "p", "n", "offset", "phases", "block", "slot", "seq", "a.b"]
    d = docs.withColumns({n: F.concat(F.lit(f"{n}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for n in names})
    key = lambda rows: sorted(map(repr, rows))
    assert mixing.mixed(d).columns == d.columns and key(mixing.mixed(d).collect()) == key(d.collect())
    kept = [c for c in d.columns if c not in ("block", "slot", "seq")]
    quoted = [f"`{c}`" for c in kept]
    assert key(mixing.schedule(d).select(*quoted).collect()) == key(d.select(*quoted).collect())
    assert key(mixing.mixed(clashing).collect()) == key(clashing.collect())


def test_more_sources_than_schedules(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 4)
    counts = {"a": 90, "b": 60, "c": 30} | {f"x{i}": 5 for i in range(9)}
    for weights in (None, {s: n / 225 for s, n in counts.items()}):
        out = mixing.schedule(frame(spark, counts), weights, block=3).collect()
        assert sorted(r["seq"] for r in out) == list(range(225)) and Counter(r["source"] for r in out) == counts


def test_deviation_from_the_weights_asked_for(spark):
    """Weights are rounded to whole parts, of which the documents name the size."""
    asked = {"a": 0.6254, "b": 0.3741, "c": 0.0005}
    given = mixing.whole(asked)
    q = sum(given.values())
    assert all(abs(p / q - asked[s]) <= 1 / mixing.PARTS for s, p in given.items())
    slots = mixing.period(given)
    for s, p in given.items():
        for t in range(q + 1):
            assert abs(sum(x < t for x in slots[s]) - t * p / q) < 1


def plain(weights, blocks):
    """Slot of every block, slot by slot."""
    left, done, out, t, now = dict(blocks), Counter(), {}, 0, Counter()
    while any(left.values()):
        q = sum(weights[s] for s in left if left[s])
        s = min((-(-(now[s] + 1) * q // weights[s]), s) for s in left if left[s] and now[s] * q // weights[s] <= t)[1]
        out[s, done[s]] = len(out)
        done[s], now[s], left[s], t = done[s] + 1, now[s] + 1, left[s] - 1, t + 1
        if not left[s]:
            t, now = 0, Counter()
    return out


def test_phases_equal_the_plain_schedule():
    r = random.Random(5)
    for n in (1, 2, 3, 9, 40, 120):
        for top in (1, 2, 12, 60):
            w, b = ({f"s{i}": r.randint(1, x) for i in range(n)} for x in (top, r.choice([1, 3, 50])))
            got = {}
            for x in mixing.phases(w, b):
                for j in range(x["n_blocks"]):
                    got[x["source"], x["first_block"] + j] = x["base"] + x["q"] * (j // len(x["slots"])) + x["slots"][j % len(x["slots"])]
            assert got == plain(w, b)


@pytest.mark.parametrize("limit", [4, 500])
def test_every_source_has_a_schedule_of_its_own(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "WIDE", limit)
    counts = {"a": 900, "b": 60, "c": 30, "": 11} | {f"x{i}": 5 + i % 3 for i in range(9)}
    out = mixing.schedule(frame(spark, counts), block=3).collect()
    want = plain(mixing.default_weights(counts), {s: -(-n // 3) for s, n in counts.items()})
    assert {(r["source"], r["block"]): r["slot"] for r in out} == want
    assert sorted(Counter(r["slot"] for r in out).values())[-1] == 3 and len({r["seq"] for r in out}) == len(out) == sum(counts.values())


def test_many_sources_are_laid_out_in_proportion():
    """Twenty thousand sources of a few blocks: rows of the plan stay within the blocks."""
    r = random.Random(6)
    blocks = {f"s{i}": r.randint(1, 6) for i in range(20000)}
    plan = mixing.phases(dict.fromkeys(blocks, 1) | {"s0": 9, "s7": 4}, blocks)
    assert sum(x["n_blocks"] for x in plan) == sum(blocks.values()) and len(plan) <= sum(blocks.values())
    assert sum(len(x["slots"]) for x in plan) <= sum(blocks.values())


def test_more_than_five_hundred_sources(spark):
    counts = {f"x{i}": 1 + i % 5 for i in range(700)}
    out = mixing.schedule(frame(spark, counts), block=2).collect()
    want = plain(mixing.default_weights(counts), {s: -(-n // 2) for s, n in counts.items()})
    assert {(r["source"], r["block"]): r["slot"] for r in out} == want and len(out) == sum(counts.values())
