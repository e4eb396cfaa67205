"""Projections of parsed pages (``parse_pages``): exploded rows, counts, images, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import MAP_WORDS


def _each(parsed: DataFrame, field: str, name: str = "item") -> DataFrame:
    """A row for each element of an array of the document, with its 0-based ``ord``."""
    return parsed.select("page_id", F.posexplode(f"doc.{field}").alias("ord", name))


def summary(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", "url", "doc.title", "doc.visible_text", F.size("doc.links").alias("n_links"), F.size("doc.tags").alias("n_elements"))


def headings(parsed: DataFrame) -> DataFrame:
    return _each(parsed, "headings").select("page_id", "ord", "item.level", "item.text", "item.id")


def paragraphs(parsed: DataFrame) -> DataFrame:
    return _each(parsed, "paragraphs", "text")


def list_items(parsed: DataFrame) -> DataFrame:
    """Items of top-level lists."""
    lists = _each(parsed, "lists").select("page_id", F.col("ord").alias("list_ord"), "item.ordered", F.posexplode("item.items").alias("ord", "text"))
    return lists


def table_cells(parsed: DataFrame) -> DataFrame:
    rows = _each(parsed, "tables").select("page_id", F.col("ord").alias("table_ord"), F.posexplode("item").alias("row_ord", "row"))
    return rows.select("page_id", "table_ord", "row_ord", F.posexplode("row").alias("cell_ord", "text"))


def links(parsed: DataFrame) -> DataFrame:
    return _each(parsed, "links").select("page_id", "ord", "item.text", "item.href", "item.original_href")


def images(parsed: DataFrame) -> DataFrame:
    return _each(parsed, "images").select("page_id", "ord", "item.*")


def svg(parsed: DataFrame) -> DataFrame:
    return _each(parsed, "svg").select("page_id", "item.*")


def scripts(parsed: DataFrame) -> DataFrame:
    """Inventory of scripts with size and hash of the source; sources are kept as they are."""
    s = _each(parsed, "scripts").select("page_id", "item.*")
    return s.withColumn("byte_length", F.octet_length("content").cast("long")).withColumn("sha256", F.sha2("content", 256)).withColumn("output_file", F.when(F.col("inline"), F.concat(numbered("source_order"), F.lit(".js")))).withColumn("formatted", F.lit(False))


def numbered(n) -> Column:
    """At least three digits."""
    s = F.col(n).cast("string") if isinstance(n, str) else n.cast("string")
    return F.lpad(s, F.greatest(F.lit(3), F.length(s)), F.lit("0"))


def element_counts(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", F.explode("doc.tags").alias("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def metadata(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", F.explode("doc.metadata").alias("key", "content"))


def image_urls(parsed: DataFrame) -> DataFrame:
    """Distinct absolute HTTP(S) image addresses of a page, numbered from 1 as first seen."""
    seen = images(parsed).filter(F.lower("src").rlike("^https?:")).filter(~F.lower("original_src").startswith("data:"))
    first = seen.groupBy("page_id", F.col("src").alias("url")).agg(F.min("ord").alias("ord"))
    return first.withColumn("source_order", F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))).drop("ord")


def rewritten_images(parsed: DataFrame, stored: DataFrame, prefix: str = "../images/") -> DataFrame:
    """Each image's address in an exported page: the stored file where there is one, else absolute.

    stored: page_id, url, output_file of materialised images.
    """
    files = stored.select("page_id", F.col("url").alias("src"), "output_file").filter(F.col("output_file").isNotNull())
    return images(parsed).join(files, ["page_id", "src"], "left").select("page_id", "ord", "original_src", F.coalesce(F.concat(F.lit(prefix), "output_file"), "src").alias("target"))


def rewritten_links(parsed: DataFrame, map_note: str = "../../map/map.md") -> DataFrame:
    """The link to the parent folder leads to the map note; others stay absolute."""
    return links(parsed).select("page_id", "ord", "text", F.when(F.col("original_href") == "../", F.lit(map_note)).otherwise(F.col("href")).alias("target"))


def identifiers(parsed: DataFrame, at_most: int = 500, longest: int = 500) -> DataFrame:
    """Attributes whose name or value suggests map data: distinct, first seen first, ``at_most`` a page."""
    a = _each(parsed, "attributes").select("page_id", "ord", "item.*").filter(~F.lower("value").startswith("data:") & (F.length("value") <= longest))
    a = a.filter(F.col("name").rlike(f"(?i){MAP_WORDS}") | F.col("value").rlike(f"(?i){MAP_WORDS}")).withColumn("identifier", F.concat_ws("=", "name", "value"))
    first = a.groupBy("page_id", "identifier").agg(F.min(F.struct("ord", "tag")).alias("f"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("f.ord")))
    return ranked.filter(F.col("n") <= at_most).select("page_id", "n", "identifier", F.concat("f.tag", F.lit(" attribute")).alias("source"))
