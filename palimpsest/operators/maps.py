"""Map records out of loosely structured JSON: every known field named, every other one kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import name_key, trim

#: Collections of records, fields of the map itself, and known fields of a record (fixed values).
COLLECTIONS = ["settlements", "markers", "labels"]
META = ["img", "seat", "coordinateSystem", "source", "path", "captureId", "imageSha256"]
FIELDS = ["id", "name", "title", "label", "type", "kind", "x", "y", "lat", "lon", "lng", "coords", "coordinates", "position", "point", "notes", "note", "description", "source", "path", "collection"]
AXES = ["x", "y", "lat", "lon", "lng"]


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _known(v: Column) -> Column:
    """Null instead of a JSON null."""
    return F.when(~F.is_variant_null(v), v)


def _first(v: Column, *names: str) -> Column:
    return F.coalesce(*[_known(_get(v, f"$.{n}")) for n in names])


def _text(v: Column) -> Column:
    """A trimmed string, null if empty."""
    return F.nullif(trim(v.cast("string")), F.lit(""))


def text_of(v: Column) -> Column:
    """A value's text; null for none."""
    return _text(_known(v))


def _type(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _entries(v: Column) -> Column:
    return F.map_entries(_get(v, "$", "map<string,variant>"))


def coordinates(v: Column) -> Column:
    """Canonical JSON: of a pair as x and y, of other nested values as they are, else of the record's axes."""
    nested = _first(v, "coords", "coordinates", "position", "point")
    pair = F.try_parse_json(F.to_json(F.struct(_get(nested, "$[0]").alias("x"), _get(nested, "$[1]").alias("y"))))
    own = F.map_filter(_get(v, "$", "map<string,variant>"), lambda k, x: k.isin(AXES))
    axes = F.when(F.size(own) > 0, F.to_json(own))
    return F.when(_type(nested).startswith("ARRAY") & _get(nested, "$[1]").isNotNull(), F.to_json(pair)).when(_type(nested).rlike("^(ARRAY|OBJECT)"), F.to_json(nested)).otherwise(axes)


def _record(v: Column, candidate: Column, collection: Column, path: Column) -> list[Column]:
    own = F.when(_type(v).startswith("OBJECT"), v).otherwise(F.try_parse_json(F.concat(F.lit('{"value":'), F.to_json(v), F.lit("}"))))
    source = F.coalesce(_known(_get(own, "$.source")), _known(_get(candidate, "$.source")))
    as_map = F.when(_type(source).startswith("OBJECT"), _get(source, "$", "map<string,string>")).when(source.isNotNull(), F.create_map(F.lit("value"), source.cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    where = F.create_map(F.lit("path"), F.coalesce(_get(own, "$.path", "string"), path))
    of = F.when(F.map_contains_key(as_map, "collection"), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("collection"), F.coalesce(_get(own, "$.collection", "string"), collection)))
    plain = F.map_filter(as_map, lambda k, x: k != "path")
    return [
        F.when(collection.endswith("s"), F.left(collection, F.length(collection) - 1)).otherwise(collection).alias("kind"),
        _text(_first(own, "type", "kind")).alias("type"),
        _text(_first(own, "name", "title", "label")).alias("name"),
        coordinates(own).alias("coordinates"),
        F.to_json(_first(own, "notes", "note", "description")).alias("notes"),
        path.alias("source_path"),
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(plain, where, of))))).alias("source"),
        F.coalesce(F.to_json(F.map_filter(_get(own, "$", "map<string,variant>"), lambda k, x: ~k.isin(FIELDS))), F.lit("{}")).alias("extra"),
        F.to_json(v).alias("original"),
        _text(_known(_get(own, "$.id"))).alias("source_id"),
    ]


def records(candidates: DataFrame, key: str = "capture_id") -> DataFrame:
    """A row for each record of the known collections: key, collection, ord and the record's fields.

    candidates: key, value (variant). Open values (coordinates, notes, source, extra, original) are
    canonical JSON with sorted keys, so that they compare and group as strings.
    """
    lists = [candidates.select(key, "value", F.lit(c).alias("collection"), F.posexplode(_get(F.col("value"), f"$.{c}", "array<variant>")).alias("i", "v")) for c in COLLECTIONS]
    rows = lists[0]
    for more in lists[1:]:
        rows = rows.unionByName(more)
    path = F.format_string("$.%s[%d]", "collection", "i")
    out = rows.select(key, "collection", (F.col("i") + F.array_position(F.array(*map(F.lit, COLLECTIONS)), F.col("collection")) * F.lit(1 << 40)).alias("ord"), *_record(F.col("v"), F.col("value"), F.col("collection"), path))
    return assign_ids(out, key)


def seats(candidates: DataFrame, key: str = "capture_id") -> DataFrame:
    """The seat of each map that has one as an object."""
    seat = _get(F.col("value"), "$.seat")
    rows = candidates.filter(_type(seat).startswith("OBJECT")).select(key, F.lit("seat").alias("collection"), F.lit(0).cast("long").alias("ord"), *_record(seat, F.col("value"), F.lit("seat"), F.lit("$.seat")))
    return assign_ids(rows, key)


def assign_ids(rows: DataFrame, key: str, base: Column | None = None) -> DataFrame:
    """``id``: the source's id or kind and name; where several share it the coordinates are added, and
    the occurrence where those are equal too. ``base_id`` and ``duplicates`` show the shared ones."""
    named = F.concat_ws("__", F.coalesce(F.nullif(name_key("kind"), F.lit("")), F.lit("record")), F.coalesce(F.nullif(name_key("name"), F.lit("")), F.lit("unnamed")))
    b = rows.withColumn("base_id", base if base is not None else F.coalesce("source_id", named))
    w = Window.partitionBy(key, "base_id")
    b = b.withColumn("duplicates", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy("ord")))
    b = b.withColumn("_id", F.when(F.col("duplicates") == 1, F.col("base_id")).otherwise(F.concat_ws("__", "base_id", F.coalesce("coordinates", F.lit("no-coordinates")))))
    for _ in range(2):  # an id made here can meet another record's own
        b = b.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_id").orderBy("duplicates", "ord"))).withColumn("_id", F.when(F.col("_r") > 1, F.concat("_id", F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col("_id")))
    return b.withColumn("id", F.col("_id")).drop("_id", "_r", "_n", "source_id")


def unclassified(candidates: DataFrame, key: str = "capture_id") -> DataFrame:
    """Everything else at the top: other arrays as collections, other values as fields; the empty
    name's arrays are left out."""
    e = candidates.select(key, F.explode(_entries(F.col("value"))).alias("e")).select(key, F.col("e.key").alias("name"), F.col("e.value").alias("v"))
    is_array = _type(F.col("v")).startswith("ARRAY")
    keep = F.when(is_array, ~F.col("name").isin(COLLECTIONS) & (F.col("name") != "")).otherwise(~F.col("name").isin(META))
    n = F.when(is_array, F.greatest(F.lit(1), F.size(F.try_variant_get("v", "$", "array<variant>")))).otherwise(1)
    return e.filter(keep).select(key, "name", F.when(is_array, "collection").otherwise("field").alias("what"), F.to_json("v").alias("value"), n.cast("long").alias("records"))


def header(candidates: DataFrame, key: str = "capture_id") -> DataFrame:
    """Image and coordinate system of each map; pixels from the top left where none is given."""
    v = F.col("value")
    size = lambda *names: F.coalesce(*[_get(v, f"$.img.{n}", "double") for n in names])
    w, h = size("w", "width"), size("h", "height")
    given = _known(_get(v, "$.coordinateSystem"))
    return candidates.select(
        key, w.alias("width"), h.alias("height"), F.coalesce(_get(v, "$.imageSha256", "string"), _get(v, "$.img.sha256", "string")).alias("image_sha256"),
        F.coalesce(F.to_json(given), F.to_json(F.struct(h.alias("height"), F.lit("top-left").alias("origin"), F.lit("image-pixel").alias("type"), w.alias("width")), {"ignoreNullFields": "false"})).alias("coordinate_system"),
        F.coalesce(_get(given, "$.type", "string"), F.when(given.isNull(), "image-pixel")).alias("system"), F.coalesce(_get(given, "$.origin", "string"), F.when(given.isNull(), "top-left")).alias("origin"),
    )


def validation(candidates: DataFrame, key: str = "capture_id") -> DataFrame:
    """Counts of each map: records by collection, missing names and coordinates, unclassified, shared ids,
    and omitted records (source elements less records, measured)."""
    r = records(candidates, key)
    per = r.groupBy(key).agg(*[F.count_if(F.col("collection") == c).alias(c) for c in COLLECTIONS], F.count("*").alias("normalized_records"), F.count_if(F.col("name").isNull()).alias("missing_names"), F.count_if(F.col("coordinates").isNull()).alias("missing_coordinates"), F.sort_array(F.collect_set(F.when(F.col("duplicates") > 1, F.col("base_id")))).alias("duplicate_ids"))
    seat = seats(candidates, key).groupBy(key).agg(F.count("*").alias("seats"))
    other = unclassified(candidates, key).groupBy(key).agg(F.sum("records").alias("unclassified_records"))
    v = F.col("value")
    elements = sum((F.coalesce(F.size(_get(v, f"$.{c}", "array<variant>")), F.lit(0)) for c in COLLECTIONS), F.lit(0))
    out = candidates.select(key, _type(v).rlike("^(OBJECT|ARRAY)").alias("parsed"), elements.alias("_n")).join(per, key, "left").join(seat, key, "left").join(other, key, "left")
    zero = F.lit(0)
    return out.select(
        key, "parsed", *[F.coalesce(c, zero).alias(c) for c in COLLECTIONS], (F.coalesce("normalized_records", zero) + F.coalesce("seats", zero)).alias("normalized_records"),
        *[F.coalesce(c, zero).alias(c) for c in ("missing_names", "missing_coordinates", "unclassified_records")], F.coalesce("duplicate_ids", F.array().cast("array<string>")).alias("duplicate_ids"),
        (F.col("_n") - F.coalesce("normalized_records", zero)).alias("omitted_records"),
    )


def note(records_: DataFrame, key: str = "capture_id") -> DataFrame:
    """Markdown table of each collection."""
    from palimpsest.functions.text import cell

    v = F.try_parse_json("coordinates")
    plain = F.coalesce(F.try_variant_get(F.try_parse_json("notes"), "$", "string"), F.col("notes"))
    cells = [F.col("id"), F.col("name"), F.coalesce("type", "kind"), _get(v, "$.x", "string"), _get(v, "$.y", "string"), F.col("coordinates"), plain, F.col("source_path")]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in cells]), F.lit(" |"))
    top = "\n| ID | Name | Type | X | Y | Coordinates | Notes | Source |\n| --- | --- | --- | ---: | ---: | --- | --- | --- |\n"
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", row.alias("row")))), lambda x: x["row"])
    return records_.groupBy(key, "collection").agg(F.concat(F.lit("## "), F.first("collection"), F.lit("\n" + top), F.array_join(rows, "\n"), F.lit("\n")).alias("markdown"))


def underdark(candidates: DataFrame, key: str = "capture_id") -> DataFrame:
    """The nested second layer as a map of its own: its dots are the markers."""
    layer = _get(F.col("value"), "$.underdark")
    dots = F.coalesce(F.to_json(_get(layer, "$.dots")), F.lit("[]"))
    return candidates.filter(_type(layer).startswith("OBJECT")).select(key, F.try_parse_json(F.concat(F.lit('{"markers":'), dots, F.lit("}"))).alias("value"), _get(layer, "$.img", "string").alias("image"))
