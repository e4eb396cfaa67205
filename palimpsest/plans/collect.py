"""The capture pipeline: one attempt over a page table, from hashes to fragments, records and log."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.parse import parse_pages
from palimpsest.operators import candidates, extract, fragments, history, maps, sparse
from palimpsest.sources import pages as sources
from palimpsest.sources import sinks


@dataclass(frozen=True)
class Options:
    output: str = "./artifacts"
    pages: str = ""
    budget: fragments.Budget = fragments.Budget()
    migrate: bool = False
    apply: bool = False


def parse_args(argv: list[str]) -> Options:
    """Options of a run; a wrong one is an error."""
    p = argparse.ArgumentParser(prog="palimpsest", allow_abbrev=False, exit_on_error=False)
    p.add_argument("--output", default="./artifacts")
    p.add_argument("--pages", default="")
    for name, default in (("target", 6000), ("max", 10000), ("min", 800)):
        p.add_argument(f"--fragment-{name}", type=int, default=default)
    p.add_argument("--migrate-codex-snapshots", action="store_true")
    p.add_argument("--apply", action="store_true")
    a, unknown = p.parse_known_args(argv)
    if unknown:
        raise ValueError(f"unknown argument: {unknown[0]}")
    if a.apply and not a.migrate_codex_snapshots:
        raise ValueError("--apply needs --migrate-codex-snapshots")
    return Options(a.output, a.pages, fragments.Budget(a.fragment_target, a.fragment_max, a.fragment_min), a.migrate_codex_snapshots, a.apply)


def capture(spark: SparkSession, pages: DataFrame, attempted_at: str, output: str, previous: DataFrame | None = None, store: DataFrame | None = None, budget: fragments.Budget = fragments.Budget(), images: DataFrame | None = None) -> dict[str, DataFrame]:
    """One attempt over all pages (page_id, url, html): returns the tables of the capture.

    previous: places of the capture before (page_id, id, sha256 of the page, LOCATION). Pages whose
    bytes are unchanged keep their places and are not parsed again. images: attempts to fetch the
    images of pages (page_id, url, source_order, http_status, content_type, body, error).
    """
    identity = spark.range(1).select(history.capture_identity(F.lit(attempted_at)).alias("c")).select("c.*").first()
    capture_id, capture_date = identity["capture_id"], identity["capture_date"]
    hashed = pages.withColumn("sha256", F.sha2("html", 256))
    if previous is not None:
        known = previous.select("page_id", F.col("page_sha256").alias("sha256")).distinct()
        fresh, same = hashed.join(known, ["page_id", "sha256"], "left_anti"), hashed.join(known, ["page_id", "sha256"], "left_semi")
    else:
        fresh, same = hashed, hashed.limit(0)
    parsed = parse_pages(fresh)
    parts = fragments.fragments(parsed, budget)
    old = previous if previous is not None else parts.limit(0).select("page_id", "id", *[F.lit(None).cast("string").alias(c) for c in sparse.LOCATION])
    places = sparse.materialize(parts, old, "page_id", capture_id, capture_date)
    found = candidates.candidates(extract.scripts(parsed))
    chosen = candidates.selected(found).select(F.col("page_id").alias("capture_id"), F.try_parse_json("raw").alias("value"))
    attempts = hashed.select(F.lit(attempted_at).alias("attempted_at"), F.lit(capture_id).alias("capture_id"), "page_id", "sha256").join(same.select("page_id", F.lit("unchanged").alias("status")), "page_id", "left").withColumn("status", F.coalesce("status", F.lit("captured")))
    tables = {"scripts": extract.scripts(parsed), "embedded": sources.embedded(extract.images(parsed)), "statistics": fragments.statistics(parsed, budget)}
    if images is not None:
        tables["images"] = sources.images(images)
        # a response that is no success, or none at all, has its status or error and nothing else in the digest
        got = ~F.coalesce(F.col("reason").isin("http-status", "fetch-error"), F.lit(False))
        kind = F.lower(F.trim(F.split_part("content_type", F.lit(";"), F.lit(1))))
        digest = history.image_digest(tables["images"].withColumns({"content_type": F.when(got, kind), "reason": F.when(got, F.col("reason"))}), "page_id")
        attempts = attempts.join(digest, "page_id", "left")
    return tables | {"documents": parsed, "fragments": places, "written": sparse.written(places, fragments.bodies(parts), "page_id", capture_id), "candidates": found, "records": maps.records(chosen), "fetches": attempts}


def save(tables: dict[str, DataFrame], root: str, capture_id: str, capture_date: str) -> None:
    """Write all tables of a capture, its log rows last."""
    for name, table in tables.items():
        if name == "fetches":
            continue
        t = table.drop("capture_id") if name == "records" else table.drop("value") if name == "candidates" else table
        sinks.append_capture(t.withColumn("capture_date", F.lit(capture_date)).withColumn("capture_id", F.lit(capture_id)), root, name)
    sinks.append_fetches(tables["fetches"], root)
