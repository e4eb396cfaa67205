"""Sinks: partitioned tables of a capture, the attempt log, the published current view.

A capture's tables are written first and its manifest row last; readers join through manifests, so
a capture without one does not exist.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FETCHES = "attempted_at string, capture_id string, status string, map_sha256 string, codex_sha256 string, image_digest string, previous_capture_id string, error string"


def inside(root: str, relative: str) -> str:
    """The path below the root; ValueError for one that is absolute or leads out of it."""
    if not relative or relative.startswith("/") or "\\" in relative or ":" in relative.split("/")[0]:
        raise ValueError(f"not a relative path: {relative!r}")
    whole = posixpath.normpath(posixpath.join("/", relative))[1:]
    if posixpath.normpath(relative) != whole or whole in ("", "."):
        raise ValueError(f"path leads out of {root}: {relative!r}")
    return f"{root.rstrip('/')}/{whole}"


def append_capture(df: DataFrame, root: str, table: str) -> None:
    """Append to a table partitioned by capture_date and capture_id."""
    df.write.mode("append").partitionBy("capture_date", "capture_id").parquet(inside(root, table))


def append_fetches(df: DataFrame, root: str) -> None:
    """Append attempts (unchanged, captured or failed) to the log; absent fields are null."""
    fields = [f.strip().split(" ") for f in FETCHES.split(",")]
    rows = df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])
    rows.write.mode("append").json(inside(root, "fetches"))


def read_fetches(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(FETCHES).json(inside(root, "fetches"))


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(root).getFileSystem(spark._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, root: str, name: str) -> list[str]:
    """Versions that have been published, the newest last. A pointer is a file whose name says all."""
    path, fs = _files(spark, root)
    folder = path(inside(root, f"{name}.pointers"))
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(n for n in names if n[0].isdigit())


def publish(df: DataFrame, root: str, name: str = "current") -> str:
    """Write a new version of the view, then point to it by one rename, so that readers see the old one
    or the new one at any time. A version whose write or pointer fails is taken back."""
    spark = df.sparkSession
    path, fs = _files(spark, root)
    version = f"{name}-{uuid.uuid4().hex}"
    data, staged = path(inside(root, version)), path(inside(root, f"{name}.pointers/.{version}"))
    try:
        df.write.parquet(data.toString())
        done = _pointers(spark, root, name)
        fs.create(staged, True).close()
        number = int(done[-1].split("-")[0]) + 1 if done else 1
        if not fs.rename(staged, path(inside(root, f"{name}.pointers/{number:012d}-{version}"))):
            raise OSError(f"cannot publish {version}")
    except Exception:
        fs.delete(staged, False)
        fs.delete(data, True)
        raise
    return version


def rollback(spark: SparkSession, root: str, name: str = "current") -> None:
    """Take back the newest version; readers see the one before."""
    path, fs = _files(spark, root)
    newest = _pointers(spark, root, name)[-1]
    fs.delete(path(inside(root, f"{name}.pointers/{newest}")), False)
    fs.delete(path(inside(root, newest.split("-", 1)[1])), True)


def current(spark: SparkSession, root: str, name: str = "current") -> DataFrame:
    return spark.read.parquet(inside(root, _pointers(spark, root, name)[-1].split("-", 1)[1]))


def pretty_json(df: DataFrame, root: str, name: str) -> None:
    """Rows as indented JSON, one text a row."""
    whole = F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"})
    df.select(whole.alias("value")).write.mode("overwrite").text(inside(root, name))


def inspection(parsed: DataFrame) -> DataFrame:
    """Markdown inspection of each parsed page: text, links, images, SVG, elements, scripts."""
    def section(title: str, items) -> Column:
        return F.concat(F.lit(f"## {title}\n\n"), F.when(F.size(items) > 0, F.array_join(items, "\n")).otherwise("None found."), F.lit("\n"))

    d = F.col("doc")
    n = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("(none)"))
    counts = F.transform(F.array_sort(F.array_distinct(d.tags)), lambda t: F.format_string("| %s | %d |", t, F.size(F.filter(d.tags, lambda x: x == t))))
    parts = [
        F.format_string("# Map inspection: %s\n\n- Source: %s\n- Visible text length: %d bytes\n", F.coalesce(F.nullif(d.title, F.lit("")), F.lit("Untitled page")), "url", F.octet_length(d.visible_text)),
        F.concat(F.lit("## Visible text and labels\n\n"), F.coalesce(F.nullif(d.visible_text, F.lit("")), F.lit("No visible text found.")), F.lit("\n")),
        section("Links", F.transform(d.links, lambda x: F.concat(F.lit("- ["), F.coalesce(F.nullif(x["text"], F.lit("")), x["href"]), F.lit("]("), x["href"], F.lit(")")))),
        section("Images", F.transform(d.images, lambda x, i: F.format_string("- Image %d: %s; alt: %s", i + 1, F.coalesce(x["src"], F.lit("no source")), F.coalesce(F.nullif(x["alt"], F.lit("")), F.lit("(empty)"))))),
        section("SVG inventory", F.transform(d.svg, lambda x: F.format_string("- SVG %d: id=%s, class=%s, viewBox=%s, descendants=%d", x["index"], n(x["id"]), n(x["classes"]), n(x["view_box"]), x["child_count"]))),
        F.concat(F.lit("## DOM element counts\n\n| Element | Count |\n| --- | ---: |\n"), F.array_join(counts, "\n"), F.lit("\n")),
        section("Script inventory", F.transform(d.scripts, lambda x: F.when(x["inline"], F.format_string("- %d: inline %s, %d bytes", x["source_order"], x["type"], F.octet_length(x["content"]))).otherwise(F.format_string("- %d: external %s, %s", x["source_order"], x["type"], x["src"])))),
    ]
    return parsed.select("page_id", F.concat_ws("\n", *parts).alias("markdown"))
