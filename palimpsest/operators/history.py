"""Captures over time: identity, validity, as-of lookup, and what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capture_identity(attempted_at: Column) -> Column:
    """Struct of attempted_at, capture_date and capture_id (to the second); an invalid time is an error."""
    ts = F.coalesce(F.try_to_timestamp(attempted_at), F.raise_error(F.concat(F.lit("invalid capture time: "), F.coalesce(attempted_at, F.lit("null")))).cast("timestamp"))
    return F.struct(ts.alias("attempted_at"), F.date_format(ts, "yyyy-MM-dd").alias("capture_date"), F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss'Z'").alias("capture_id"))


def valid_captures(manifests: DataFrame) -> DataFrame:
    """Complete manifests of version 2, in order of time and id.

    manifests: schema_version, capture_id, started_at (string), completed_at, map_sha256, codex_sha256.
    """
    filled = [F.coalesce(c, F.lit("")) != "" for c in ("capture_id", "completed_at", "map_sha256", "codex_sha256")]
    ok = F.col("schema_version") == 2
    for f in filled:
        ok = ok & f
    return manifests.filter(ok).withColumn("started", F.try_to_timestamp("started_at")).orderBy("started", "capture_id")


def previous_capture(captures: DataFrame, before: Column | str) -> DataFrame:
    """The last capture that started strictly before the time; captures without a time never are."""
    earlier = captures.filter(F.col("started").isNotNull() & (F.col("started") < F.to_timestamp(F.lit(before) if isinstance(before, str) else before)))
    return earlier.orderBy(F.desc("started"), F.desc("capture_id")).limit(1)


def with_previous(captures: DataFrame) -> DataFrame:
    """Every capture with the id of the last one that started strictly before it."""
    return as_of(captures, captures, "started", "capture_id", "previous_capture_id")


def as_of(rows: DataFrame, history: DataFrame, time: str, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Add the ``value`` of history's last row strictly before each row's ``time`` (per ``by``).

    One sort of the union by key and time instead of a range join: history rows of the same time come
    after, so they are not seen; ties in time go to the larger value.
    """
    by = by or []
    cols = rows.columns
    h = history.filter(F.col(time).isNotNull()).select(*by, F.col(time).alias("_t"), F.lit(1).alias("_h"), F.col(value).alias("_v"), *[F.lit(None).cast(rows.schema[c].dataType).alias(f"r_{c}") for c in cols])
    r = rows.select(*by, F.col(time).alias("_t"), F.lit(0).alias("_h"), F.lit(None).cast(history.schema[value].dataType).alias("_v"), *[F.col(c).alias(f"r_{c}") for c in cols])
    w = Window.partitionBy(*by).orderBy("_t", "_h", "_v") if by else Window.orderBy("_t", "_h", "_v")
    seen = h.unionByName(r).withColumn(name, F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return seen.filter("_h = 0").select(*[F.col(f"r_{c}").alias(c) for c in cols], F.when(F.col("_t").isNotNull(), F.col(name)).alias(name))


def image_digest(images: DataFrame, by: str = "capture_id") -> DataFrame:
    """Hash of a capture's image rows in source order: entries by NUL, rows by line end."""
    fields = ["url", "status", "sha256", "http_status", "content_type", "byte_length", "reason", "error"]
    row = F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), "\0")
    ordered = F.array_sort(F.collect_list(F.struct("source_order", row.alias("row"))))
    return images.groupBy(by).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["row"]), "\n"), 256).alias("image_digest"))


def unchanged(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """``key`` and ``unchanged``: a previous row exists and all hashes are known and equal.

    Both: key, map_sha256, codex_sha256, image_digest. A missing previous digest means changed.
    """
    hashes = ["map_sha256", "codex_sha256", "image_digest"]
    p = previous.select(key, *[F.col(h).alias(f"p_{h}") for h in hashes])
    same = F.lit(True)
    for h in hashes:
        same = same & F.coalesce(F.col(h) == F.col(f"p_{h}"), F.lit(False))
    return current.join(p, key, "left").select(key, same.alias("unchanged"))


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: surplus rows on either side, and whether the multisets are equal."""
    left = a.exceptAll(b).agg(F.count("*").alias("only_left"))
    right = b.exceptAll(a).agg(F.count("*").alias("only_right"))
    return left.join(right).select("only_left", "only_right", ((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("equal"))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
