"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in the order of a hash of their id, form blocks of BLOCK documents. With
target weight p/q, its block k (from 0) is released at slot floor(k q / p) and due at slot
ceil((k + 1) q / p). Earliest-deadline-first over released blocks fills every slot and misses no
deadline, so that after any slot each source is less than one block from its target.

Weights are integers over their sum q, hence the schedule repeats every q slots: the driver lays
out one period (a few thousand slots, or one a source where there are more sources), and built-in expressions
place every document from its rank in its source. When a source runs out, its share goes to the
others in proportion and a new phase begins, of which no more is laid out than it lasts. Every document is
placed exactly once.

A null source is the source ''; null ids come first in theirs. Repeated rows get places of their
own. An empty table stays empty. Given weights are rounded to whole parts of about PARTS, of at least one. Every source
has a schedule of its own, however many there are: the driver holds their names and counts and lays out no more slots
than there are blocks. Beyond WIDE sources the schedule is not broadcast but joined by source and block. A caller may
set MAX_SOURCES: all but the largest MAX_SOURCES - 1 then share one schedule with their weights added up, in which
documents follow the hash of their id. No query does.
Documents and hot sources may be any number: ranks come from counts of hash ranges, never from
one task for a whole source. Columns of the table come back as they are, whatever their names, but for
those of the three new ones.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import words

#: Documents of a block.
BLOCK = 16
#: Parts into which the default weights divide one, about.
PARTS = 1000
#: Sources up to which the schedule is broadcast.
WIDE = 500
#: Schedules at most, where a caller wants the others to share one; None: every source has its own.
MAX_SOURCES: int | None = None
#: The sources that share a schedule.
SHARED = "\uffff"
#: Hex digits of the hash ranges in which ranks are taken.
RANGE_DIGITS = 3


class _Members:
    """Sources of one weight, in order; those that have run out are passed over."""

    def __init__(self, names: list[str]):
        self.names, self.next = names, list(range(len(names) + 1))

    def at(self, i: int) -> int:
        """The first place from i on that is still in, or the number of names."""
        end = i
        while self.next[end] != end:
            end = self.next[end]
        while self.next[i] != end:
            self.next[i], i = end, self.next[i]
        return end


def _lay_out(classes: dict[int, _Members], q: int, left: dict[str, int] | None = None):
    """Sources in the order of their slots: one period, or less where one of them runs out of its ``left`` blocks.

    Sources of equal weight have equal releases and deadlines and take turns by name, so that only the
    first of each weight competes for a slot.
    """
    ready, waiting, order = [], [(0, p, 0) for p in classes], []
    heapq.heapify(waiting)
    for t in range(q):
        while waiting and waiting[0][0] <= t:
            _, p, k = heapq.heappop(waiting)
            i = classes[p].at(0)
            heapq.heappush(ready, (-(-(k + 1) * q // p), classes[p].names[i], p, k, i))
        due, s, p, k, i = heapq.heappop(ready)
        order.append((s, p, i))
        if left is not None and k + 1 == left[s]:
            break
        j = classes[p].at(i + 1)
        if j < len(classes[p].names):
            heapq.heappush(ready, (due, classes[p].names[j], p, k, j))
        elif k + 1 < p:
            heapq.heappush(waiting, ((k + 1) * q // p, p, k + 1))
    return order


def _by_weight(weights: dict[str, int]) -> dict[int, _Members]:
    names: dict[int, list[str]] = {}
    for s in sorted(weights):
        names.setdefault(weights[s], []).append(s)
    return {p: _Members(x) for p, x in names.items()}


def _slots(order: list) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for t, (s, _, _) in enumerate(order):
        out.setdefault(s, []).append(t)
    return out


def period(weights: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period of sum(weights) slots."""
    return _slots(_lay_out(_by_weight(weights), sum(weights.values())))


def phases(weights: dict[str, int], blocks: dict[str, int]) -> list[dict]:
    """For every phase and source with slots in it: first block, blocks, first slot of the phase, q, slots in a period
    (of a phase that ends within its first, those until then)."""
    left, done, base, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    classes, many = _by_weight({s: weights[s] for s in left}), Counter(weights[s] for s in left)
    q = sum(weights[s] for s in left)
    while many:
        order = _lay_out(classes, q, left)
        slots = _slots(order)
        ends = len(order)
        last = order[-1]
        if len(slots[last[0]]) < left[last[0]]:  # a whole period and none has run out
            place = {s: (p, i) for s, p, i in order}
            ends, name = min((q * ((left[s] - 1) // weights[s]) + x[(left[s] - 1) % weights[s]] + 1, s) for s, x in slots.items())
            last = (name, *place[name])
        for s, x in slots.items():
            n = ends // q * len(x) + bisect_left(x, ends % q) if ends > len(order) else len(x)
            if n:
                out.append({"source": s, "first_block": done[s], "n_blocks": n, "base": base, "q": q, "slots": x})
            left[s] -= n
            done[s] += n
        name, p, i = last
        classes[p].next[i] = i + 1
        many[p] -= 1
        if not many[p]:
            del many[p], classes[p]
        q -= p
        base += ends
    return out


def default_weights(counts: dict[str, int]) -> dict[str, int]:
    """Target weights where none are given: in proportion to the square root of the documents."""
    roots = {s: n**0.5 for s, n in counts.items()}
    total = sum(roots.values())
    return {s: max(1, int(PARTS * r / total)) for s, r in roots.items()}


def whole(weights: dict[str, float]) -> dict[str, int]:
    """Given weights as integers with about PARTS parts."""
    total = sum(Fraction(w).limit_denominator(10**6) for w in weights.values())
    return {s: max(1, round(PARTS * Fraction(w).limit_denominator(10**6) / total)) for s, w in weights.items()}


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """Add ``block`` (within the source), ``slot`` and ``seq`` (order of the mixture), all long.

    weights: by source; sources without one are an error. Columns of those names are replaced.
    """
    rest = [c for c in docs.columns if c not in ("block", "slot", "seq")]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    md5 = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    base = docs.select(row.alias("row"), F.coalesce("source", F.lit("")).alias("s"), md5.alias("h"), F.col("doc_id").alias("id")).withColumn("r", F.substring("h", 1, RANGE_DIGITS))
    ranges = words.store(base.groupBy("s", "r").agg(F.count("*").alias("n")))
    # names and counts of the sources, on the driver
    counts = {r["s"]: r["n"] for r in ranges.groupBy("s").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s").collect()}
    if not counts:
        return docs.select(*[F.col(f"`{c}`") for c in rest], *[F.lit(None).cast("long").alias(c) for c in ("block", "slot", "seq")])
    given = None if weights is None else {s: weights[s] for s in counts}
    if MAX_SOURCES is not None and len(counts) > MAX_SOURCES:
        own = list(counts)[: MAX_SOURCES - 1]
        source = F.when(F.col("s").isin(own), F.col("s")).otherwise(SHARED)
        base, ranges = base.withColumn("s", source), ranges.withColumn("s", source).groupBy("s", "r").agg(F.sum("n").alias("n"))
        counts = {s: counts[s] for s in own} | {SHARED: sum(n for s, n in counts.items() if s not in own)}
        given = given and {s: given[s] for s in own} | {SHARED: sum(w for s, w in given.items() if s not in own)}
    target = default_weights(counts) if given is None else whole(given)
    plan = phases(target, {s: -(-n // block) for s, n in counts.items()})

    before = Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("s", "r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = base.withColumn("i", F.row_number().over(Window.partitionBy("s", "r").orderBy("h", "id")))
    rank = F.col("offset") + F.col("i") - 1
    ranked = ranked.join(offsets, ["s", "r"]).select("row", "s", F.floor(rank / block).alias("k"), (rank % block).alias("x"))

    fields = {"source": pa.string(), "first_block": pa.int64(), "n_blocks": pa.int64(), "base": pa.int64(), "q": pa.int64(), "slots": pa.list_(pa.int64())}
    table = docs.sparkSession.createDataFrame(pa.table({c: pa.array([r[c] for r in plan], t) for c, t in fields.items()}))

    def slot(p, j):
        """Of block j of a phase."""
        size = F.size(p("slots"))
        return p("base") + p("q") * F.floor(j / size) + F.get(p("slots"), (j % size).cast("int"))

    if len(counts) <= WIDE:
        by_source = table.groupBy(F.col("source").alias("s")).agg(F.array_sort(F.collect_list(F.struct("first_block", "n_blocks", "base", "q", "slots"))).alias("phases"))
        placed = ranked.join(F.broadcast(by_source), "s")  # at most WIDE rows
        placed = placed.withColumn("p", F.filter("phases", lambda p: (p["first_block"] <= F.col("k")) & (F.col("k") < p["first_block"] + p["n_blocks"]))[0])
        placed = placed.withColumn("slot", slot(lambda c: F.col(f"p.{c}"), F.col("k") - F.col("p.first_block")))
    else:
        each = table.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
        each = words.store(each.select(F.col("source").alias("s"), (F.col("first_block") + F.col("j")).alias("k"), slot(F.col, F.col("j")).alias("slot")))
        placed = ranked.join(each.hint("merge"), ["s", "k"])
    return placed.select("row.*", F.col("k").cast("long").alias("block"), F.col("slot").cast("long").alias("slot"), (F.col("slot") * block + F.col("x")).cast("long").alias("seq"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """The documents, in the order of the mixture."""
    (row,) = words.unused(docs, "row")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), "doc_id", "source")
    return schedule(held, weights, block).orderBy("seq").select(f"{row}.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = words.read(spark, sf_dir, "documents").select("doc_id", "source")
    return schedule(docs).select("doc_id", "source", "block", "slot", "seq")


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS s, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id) - 1 AS rn FROM d),
n AS (SELECT s, count(*) AS n FROM d GROUP BY s),
w AS (SELECT s, greatest(1, CAST(floor({PARTS} * sqrt(n) / (SELECT sum(sqrt(n)) FROM n)) AS BIGINT)) AS p, CAST(ceil(n / {BLOCK}) AS BIGINT) AS left_ FROM n),
run AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS t, CAST(NULL AS VARCHAR) AS pick, CAST(0 AS BIGINT) AS block,
    list({{'s': s, 'p': p, 'left_': left_, 'c': CAST(0 AS BIGINT), 'done': CAST(0 AS BIGINT)}}) AS st FROM w
  UNION ALL
  SELECT slot + 1, CASE WHEN ended THEN 0 ELSE t + 1 END, best.s, best.done,
    list_transform(st, lambda x: {{'s': x.s, 'p': x.p, 'left_': x.left_ - (CASE WHEN x.s = best.s THEN 1 ELSE 0 END),
      'c': CASE WHEN ended THEN 0 ELSE x.c + (CASE WHEN x.s = best.s THEN 1 ELSE 0 END) END, 'done': x.done + (CASE WHEN x.s = best.s THEN 1 ELSE 0 END)}})
  FROM (
    SELECT *, best.left_ = 1 AS ended FROM (
      SELECT *, list_sort(list_transform(list_filter(st, lambda x: x.left_ > 0 AND x.c * q // x.p <= t),
        lambda x: {{'due': -((-(x.c + 1) * q) // x.p), 's': x.s, 'left_': x.left_, 'done': x.done}}))[1] AS best
      FROM (SELECT *, list_sum(list_transform(list_filter(st, lambda x: x.left_ > 0), lambda x: x.p))::BIGINT AS q FROM run) a
      WHERE q > 0) b) c
)
SELECT k.doc_id, k.source, CAST(k.rn // {BLOCK} AS BIGINT) AS block, run.slot, CAST(run.slot * {BLOCK} + k.rn % {BLOCK} AS BIGINT) AS seq
FROM k JOIN run ON run.pick = k.s AND run.block = k.rn // {BLOCK}
"""
