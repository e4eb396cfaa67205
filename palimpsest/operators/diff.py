"""Structural and textual differences between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective_hash() -> Column:
    """What counts as a fragment's content: rows of a table chunk, items of a list chunk, else all."""
    return F.when(F.col("fragment_kind") == "table-chunk", F.col("row_content_hash")).when(F.col("fragment_kind") == "list-chunk", F.col("item_content_hash")).otherwise(F.col("content_hash"))


def keyed(current: DataFrame, previous: DataFrame, key: str, compared: dict[str, str]) -> DataFrame:
    """Full outer comparison in long form: change, key, before, after (strings).

    compared: change name -> column. Keys of one side are ``added`` or ``removed``. One shuffle of
    either side; every comparison reads the same join.
    """
    columns = list(dict.fromkeys(compared.values()))
    a = current.select(key, F.lit(True).alias("_a"), *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    b = previous.select(key, F.lit(True).alias("_b"), *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    both = a.join(b, key, "full_outer")
    entry = lambda name, before, after: F.struct(F.lit(name).alias("change"), before.alias("before"), after.alias("after"))
    none = F.lit(None).cast("string")
    kinds = F.when(F.col("_b").isNull(), F.array(entry("added", none, none))).when(F.col("_a").isNull(), F.array(entry("removed", none, none)))
    each = F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), entry(name, F.col(f"b_{c}"), F.col(f"a_{c}"))) for name, c in compared.items()])
    return both.select(key, F.explode(kinds.otherwise(F.filter(each, lambda x: x.isNotNull()))).alias("c")).select(key, "c.*")


def fragments(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Changes of fragments by id: added, removed, changed, heading, parent, source_order."""
    h = lambda d: d.withColumn("hash", effective_hash())
    return keyed(h(current), h(previous), "id", {"changed": "hash", "heading": "heading", "parent": "parent_id", "source_order": "source_order"})


def summary(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Counts by change, unchanged included."""
    both = current.select("id", effective_hash().alias("a")).join(previous.select("id", effective_hash().alias("b")), "id").filter(F.col("a").eqNullSafe(F.col("b")))
    return fragments(current, previous).groupBy("change").agg(F.count("*").alias("n")).unionByName(both.agg(F.lit("unchanged").alias("change"), F.count("*").alias("n")).select("change", "n"))


def maps(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Changes of map records by id: added, removed, moved, renamed, notes, changed (all but the original)."""
    whole = lambda d: d.withColumn("all", F.to_json(F.struct("kind", "type", "name", "coordinates", "notes", "source_path", "source", "extra"))).withColumn("_name", F.trim(F.coalesce("name", F.lit(""))))
    return keyed(whole(current), whole(previous), "id", {"moved": "coordinates", "renamed": "_name", "notes": "notes", "changed": "all"})


def singletons(current: DataFrame, previous: DataFrame, columns: list[str]) -> DataFrame:
    """Compare single rows column by column: field, before, after of what differs."""
    a, b = current.select(*[F.col(c).cast("string").alias(f"a_{c}") for c in columns]), previous.select(*[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"b_{c}").alias("before"), F.col(f"a_{c}").alias("after")) for c in columns])
    one = a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k", "full_outer")
    return one.select(F.explode(rows).alias("r")).select("r.*").filter(~F.col("before").eqNullSafe(F.col("after")))


def unified(before: Column, after: Column, before_name: str = "previous", after_name: str = "current", context: int = 3) -> Column:
    """One hunk: common first and last lines but ``context`` are left out, all between is removed and
    added. Empty for equal texts. Built-in array functions only."""
    lines = lambda s: F.split(F.regexp_replace(s, "\n\\z", ""), "\n")

    def hunk(x: Column) -> Column:
        a, b = x["a"], x["b"]
        common = lambda p, q: F.array_position(F.transform(F.arrays_zip(p.alias("p"), q.alias("q")), lambda z: z["p"].eqNullSafe(z["q"])), False)
        least = F.least(F.size(a), F.size(b))
        first = F.when(common(a, b) == 0, least).otherwise(F.least(common(a, b) - 1, least)).cast("int")
        rest = least - first
        back = common(F.reverse(a), F.reverse(b))
        last = F.least(F.when(back == 0, least).otherwise(back - 1), rest).cast("int")
        return F.struct(a.alias("a"), b.alias("b"), first.alias("first"), last.alias("last"))

    def render(x: Column) -> Column:
        a, b, first, last = x["a"], x["b"], x["first"], x["last"]
        start = F.greatest(F.lit(0), first - context)
        tail = F.least(F.lit(context), last)
        size = lambda s: F.size(s) - last + tail - start
        part = lambda s, frm, n, sign: F.transform(F.slice(s, frm + 1, n), lambda line: F.concat(F.lit(sign), line))
        head = F.array(F.lit(f"--- {before_name}"), F.lit(f"+++ {after_name}"), F.format_string("@@ -%d,%d +%d,%d @@", start + 1, size(a), start + 1, size(b)))
        body = F.concat(head, part(a, start, first - start, " "), part(a, first, F.size(a) - first - last, "-"), part(b, first, F.size(b) - first - last, "+"), part(a, F.size(a) - last, tail, " "))
        return F.concat(F.array_join(body, "\n"), F.lit("\n"))

    one = F.array(F.struct(lines(before).alias("a"), lines(after).alias("b")))
    return F.when(before == after, F.lit("")).otherwise(F.transform(F.transform(one, hunk), render)[0])


def flags(current: DataFrame, previous: DataFrame, key: str = "source") -> DataFrame:
    """Per source: whether raw bytes, text, structure, images and data changed; all true without a previous row.

    Both: key, and of raw_sha256, text_sha256, structure_sha256, images_sha256, data_sha256 those that apply;
    a hash that the previous row lacks counts as changed.
    """
    names = [n for n in ("raw", "text", "structure", "images", "data") if f"{n}_sha256" in current.columns]
    had = [F.col(f"{n}_sha256") if f"{n}_sha256" in previous.columns else F.lit(None).cast("string") for n in names]
    p = previous.select(key, F.lit(True).alias("_p"), *[c.alias(f"p_{n}") for n, c in zip(names, had, strict=True)])
    return current.join(p, key, "left").select(key, *[(F.col("_p").isNull() | ~F.col(f"{n}_sha256").eqNullSafe(F.col(f"p_{n}"))).alias(f"{n}_changed") for n in names], F.struct(F.col("p_raw").alias("before"), F.col("raw_sha256").alias("after")).alias("raw_hashes"))


def report(changes: DataFrame, key: str = "id") -> DataFrame:
    """The human summary: one Markdown line a kind of change, with its ids in order."""
    per = changes.groupBy("change").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(key)), ", ").alias("ids"))
    return per.select("change", F.format_string("- %s: %d (%s)", F.initcap("change"), "n", "ids").alias("line"))
