"""One-time migration of full captures to sparse storage: dry run unless told to apply."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators import fragments as G
from palimpsest.operators import sparse

_HEAD = re.compile(r"\A---\n.*?\n---\n\n?", re.S)
_LINK = re.compile(r"!\[\[[^\n]+\]\]")


def own_content(text: str, heading: str | None, children: int) -> str:
    """What a legacy file holds itself: without front matter, heading and its last ``children`` links."""
    lines = _HEAD.sub("", text, count=1).rstrip().split("\n")
    for _ in range(children):
        while lines and not lines[-1].strip():
            lines.pop()
        if not lines or not _LINK.fullmatch(lines[-1].strip()):
            break
        lines.pop()
    if heading and lines and re.fullmatch(rf"#{{1,6}} {re.escape(heading)}", lines[0]):
        lines = lines[1:]
    return "\n".join(lines).strip()


@F.pandas_udf(T.StringType())
def own_content_of(text: pd.Series, heading: pd.Series, children: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else own_content(t, h, int(n)) for t, h, n in zip(text, heading, children, strict=True)])


def is_migrated(records: DataFrame) -> bool:
    """All records have a place already."""
    if not set(sparse.LOCATION) <= set(records.columns):
        return False
    missing = F.lit(False)
    for c in sparse.LOCATION:
        missing = missing | F.col(c).isNull()
    return records.filter(missing).isEmpty()


def migrate(captures: list[tuple[str, str, DataFrame]], key: str = "page_id", apply=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fold captures (id, date, full fragments) in order of time through sparse storage.

    Returns the last capture's places, the store and the violations (of the last capture). ``apply``
    is called with places and store only if there are no violations. The list of captures is what the
    driver loops over; fragments stay distributed.
    """
    store = places = None
    for capture_id, capture_date, full in captures:
        before = full.limit(0).select(key, "id", *[F.lit(None).cast("string").alias(c) for c in sparse.LOCATION]) if places is None else places
        places = sparse.materialize(full, before, key, capture_id, capture_date)
        new = sparse.written(places, G.bodies(full, key), key, capture_id)
        store = new if store is None else store.unionByName(new)
    errors = sparse.violations(places, store.join(places.select("materialized_path"), "materialized_path", "left_semi"), key)
    if apply is not None and errors.isEmpty():
        apply(places, store)
    return places, store, errors


def accounting(full: DataFrame, store: DataFrame, key: str = "page_id") -> DataFrame:
    """Fragments and bytes in full and in sparse storage."""
    a = full.agg(F.count("*").alias("full_fragments"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("full_bytes"))
    b = store.agg(F.count("*").alias("stored_fragments"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("stored_bytes"))
    return a.join(b)
