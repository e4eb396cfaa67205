"""Sparse, content-addressed storage of fragments, with a full current view.

A fragment is stored again only if its rendering changed: its own content, or where a child of
it is stored. Signatures are resolved level by level from the deepest fragments up, one join a level
(a few levels, whatever the number of documents), so all documents advance together.
"""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.storage import cut, release
from palimpsest.operators.diff import effective_hash

LOCATION = ["render_signature", "materialized_capture", "materialized_path"]


def dependency_hash(content: Column, image_digest: Column, map_hash: Column) -> Column:
    """Hash of what a content draws from beside itself: stored images, the map note."""
    images = F.when(content.contains("../images/"), image_digest)
    note = F.when(content.contains("map/map.md"), map_hash)
    return F.when(images.isNotNull() | note.isNotNull(), F.sha2(F.to_json(F.struct(images.alias("images"), note.alias("map"))), 256))


def signature(child_paths: Column) -> Column:
    fields = [F.col(c) for c in ("id", "kind", "fragment_kind", "heading", "heading_level", "parent_id", "part_of", "child_ids", "dependency_hash")]
    return F.sha2(F.to_json(F.struct(*fields, effective_hash().alias("hash"), child_paths.alias("child_paths"))), 256)


def with_levels(fragments: DataFrame, key: str) -> DataFrame:
    """Add ``level``: 0 for fragments without children, else one above the highest child's."""
    depth = F.size("heading_path")  # a child's path is longer than its parent's
    return fragments.withColumn("level", F.max(depth).over(Window.partitionBy(key)) - depth)  # fragments are made once


def materialize(fragments: DataFrame, previous: DataFrame, key: str = "page_id", capture_id: str = "", capture_date: str = "") -> DataFrame:
    """Add signature, capture and path of each fragment: the previous place where nothing changed,
    else one in this capture.

    previous: key, id and LOCATION of the capture before. Missing children are an error.
    """
    if "dependency_hash" not in fragments.columns:
        fragments = fragments.withColumn("dependency_hash", F.lit(None).cast("string"))
    leveled = cut(with_levels(fragments, key))  # every level reads it, and the one above
    old = previous.select(key, "id", *[F.col(c).alias(f"_{c}") for c in LOCATION])
    top = leveled.agg(F.max("level")).first()[0]  # one number
    done = None
    for level in range((top or 0) + 1):
        here = leveled.filter(F.col("level") == level)
        if done is None:
            paths = here.withColumn("_paths", F.array().cast("array<string>"))
        else:
            child = done.select(key, F.col("id").alias("child"), F.col("materialized_path").alias("path"))
            found = here.select(key, "id", F.posexplode("child_ids").alias("n", "child")).join(child, [key, "child"], "left")
            resolved = found.withColumn("path", F.coalesce("path", F.raise_error(F.concat(F.lit("fragment without a child: "), "child")).cast("string"))).groupBy(key, "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]).alias("_paths"))
            paths = here.join(resolved, [key, "id"], "left").withColumn("_paths", F.coalesce("_paths", F.array().cast("array<string>")))
        signed = paths.withColumn("render_signature", signature(F.col("_paths"))).join(old, [key, "id"], "left")
        same = F.coalesce(F.col("render_signature") == F.col("_render_signature"), F.lit(False))
        own = F.concat(F.lit(f"captures/{capture_date}/{capture_id}/codex/"), F.col(key).cast("string"), F.lit("/"), "file")
        placed = signed.withColumn("materialized_capture", F.when(same, F.col("_materialized_capture")).otherwise(F.lit(capture_id))).withColumn("materialized_path", F.when(same, F.col("_materialized_path")).otherwise(own)).drop("_paths", *[f"_{c}" for c in LOCATION])
        placed = cut(placed)
        done = placed if done is None else done.unionByName(placed)
    release(leveled)  # every level is stored
    return done.drop("level")


def written(materialized: DataFrame, bodies: DataFrame | None = None, key: str = "page_id", capture_id: str = "") -> DataFrame:
    """The rows to append to the store: path, body and hash of what this capture materialised. Without
    ``bodies``, the fragments have theirs beside them."""
    columns = [key, "id", "materialized_path", "materialized_capture"]
    mine = materialized.filter(F.col("materialized_capture") == capture_id)
    full = mine.select(*columns, "body") if bodies is None else mine.select(*columns).join(bodies.select(key, "id", "body"), [key, "id"])
    return full.withColumn("materialized_hash", F.sha2("body", 256))


def legacy(previous: DataFrame, capture_id: str, capture_date: str, key: str = "page_id") -> DataFrame:
    """Fill in places of records from before places were kept: the capture's own."""
    own = F.concat(F.lit(f"captures/{capture_date}/{capture_id}/codex/"), F.col(key).cast("string"), F.lit("/"), "file")
    have = set(previous.columns)
    of = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    return previous.withColumns({"materialized_path": F.coalesce(of("materialized_path"), own), "materialized_capture": F.coalesce(of("materialized_capture"), F.lit(capture_id)), "render_signature": of("render_signature")})


def current_view(materialized: DataFrame, store: DataFrame, key: str = "page_id") -> DataFrame:
    """Every fragment with its body from wherever it is stored; a missing or altered body is an error."""
    s = store.select(F.col("materialized_path"), "body", "materialized_hash")
    joined = materialized.drop("body", "materialized_hash").join(s, "materialized_path", "left")
    bad = F.raise_error(F.concat(F.lit("stored fragment is missing or altered: "), "materialized_path")).cast("string")
    ok = F.col("body").isNotNull() & (F.sha2("body", 256) == F.col("materialized_hash"))
    return joined.withColumn("body", F.when(ok, F.col("body")).otherwise(bad)).select(key, "id", "file", "source_order", "materialized_capture", "materialized_path", "materialized_hash", "body")


def composite(materialized: DataFrame, key: str = "page_id") -> DataFrame:
    """Pointers to the root fragments of each document, in order."""
    roots = materialized.filter("parent_id IS NULL AND part_of IS NULL")
    ordered = F.array_sort(F.collect_list(F.struct("source_order", "materialized_path")))
    return roots.groupBy(key).agg(F.transform(ordered, lambda x: F.concat(F.lit("![["), x["materialized_path"], F.lit("]]"))).alias("pointers"))


@F.pandas_udf(T.StringType())
def pointer(frm: pd.Series, to: pd.Series) -> pd.Series:
    """A relative transclusion from one stored file to another."""
    return pd.Series([None if f is None or t is None else f"![[{posixpath.relpath(t, posixpath.dirname(f))}]]" for f, t in zip(frm, to, strict=True)])


def violations(materialized: DataFrame, store: DataFrame, key: str = "page_id") -> DataFrame:
    """Errors of a capture: bodies missing or altered, children that do not exist, stored rows nobody refers to."""
    m = materialized.select(key, "id", "materialized_path", "child_ids")
    s = store.select("materialized_path", "body", "materialized_hash")
    row = lambda d, what: d.select(F.col(key).cast("string").alias("document"), F.col("id"), F.lit(what).alias("error"))
    missing = row(m.join(s, "materialized_path", "left_anti"), "missing body")
    altered = row(m.join(s.filter(F.sha2("body", 256) != F.col("materialized_hash")), "materialized_path"), "hash mismatch")
    orphan = row(m.select(key, "id", F.explode("child_ids").alias("child")).join(m.select(key, F.col("id").alias("child")), [key, "child"], "left_anti"), "missing child")
    unused = s.join(m, "materialized_path", "left_anti").select(F.lit(None).cast("string").alias("document"), F.col("materialized_path").alias("id"), F.lit("not referenced").alias("error"))
    return missing.unionByName(altered).unionByName(orphan).unionByName(unused)
