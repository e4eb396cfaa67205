import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import annotate, candidates, diff, maps

MAP = {
    "img": {"w": 800, "h": 600, "palette": "x"}, "seat": {"name": "Keep", "kind": "fort", "x": 5, "y": 6},
    "settlements": [{"name": " North Village ", "kind": "village", "x": 420, "y": 240, "notes": ["a", "b"], "unknownFlag": True}, {"name": "South", "coords": [10, 20], "notes": "one"}],
    "markers": [{"id": "m1", "title": "Gate", "x": "12", "y": 3}, {"name": "Twin", "x": 1, "y": 1}, {"name": "Twin", "x": 1, "y": 1}, 7],
    "labels": [{"name": "L", "x": 900, "y": 10, "rotation": 3}], "routes": [{"from": 1}], "renderVersion": 4, "": [1, 2],
}


def frame(spark, *values):
    return spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "capture_id long, text string").select("capture_id", F.parse_json("text").alias("value"))


@pytest.fixture(scope="module")
def records(spark):
    return {r["id"]: r for r in maps.records(frame(spark, MAP)).orderBy("ord").collect()}


def test_records(records):
    assert list(records) == ["settlement__north-village", "settlement__south", "m1", 'marker__twin__{"x":1,"y":1}', 'marker__twin__{"x":1,"y":1}#2', "marker__unnamed", "label__l"]
    n = records["settlement__north-village"]
    assert n["name"] == "North Village" and n["type"] == "village" and json.loads(n["notes"]) == ["a", "b"] and json.loads(n["extra"]) == {"unknownFlag": True}
    assert json.loads(n["coordinates"]) == {"x": 420, "y": 240} and n["source_path"] == "$.settlements[0]" and json.loads(n["original"]) == MAP["settlements"][0]
    assert json.loads(records["settlement__south"]["coordinates"]) == {"x": 10, "y": 20} and json.loads(records["m1"]["coordinates"]) == {"x": "12", "y": 3}
    assert json.loads(n["source"]) == {"collection": "settlements", "path": "$.settlements[0]"} and records["m1"]["name"] == "Gate"


def test_validation_and_rest(spark):
    c = frame(spark, MAP, {"settlements": 5, "seat": "no"}, [1])
    v = {r["capture_id"]: r for r in maps.validation(c).collect()}
    assert (v[0]["settlements"], v[0]["markers"], v[0]["labels"], v[0]["normalized_records"]) == (2, 4, 1, 8) and v[0]["duplicate_ids"] == ["marker__twin"] and v[0]["omitted_records"] == 0
    assert v[0]["missing_names"] == 1 and v[0]["missing_coordinates"] == 1 and v[0]["unclassified_records"] == 2 and v[1]["unclassified_records"] == 1
    rest = {(r["capture_id"], r["name"]): r["what"] for r in maps.unclassified(c).collect()}
    assert rest == {(0, "routes"): "collection", (0, "renderVersion"): "field", (1, "settlements"): "field"}
    h = maps.header(c).filter("capture_id = 0").first()
    assert (h["width"], h["height"], h["system"], h["origin"]) == (800.0, 600.0, "image-pixel", "top-left")
    assert [r["id"] for r in maps.seats(c).collect()] == ["seat__keep"]
    assert "| settlement__south | South | settlement | 10 | 20 |" in maps.note(maps.records(c)).filter("collection = 'settlements'").first()["markdown"]


def test_movement_keeps_the_id(spark):
    moved = json.loads(json.dumps(MAP))
    moved["settlements"][0] |= {"x": 440, "y": 244}
    a, b = (maps.records(frame(spark, m)) for m in (moved, MAP))
    changes = {(r["id"], r["change"]) for r in diff.maps(a, b).collect()}
    assert changes == {("settlement__north-village", "moved"), ("settlement__north-village", "changed")}
    one = diff.singletons(maps.header(frame(spark, MAP | {"img": {"w": 1, "h": 600}})), maps.header(frame(spark, MAP)), ["width", "height"])
    assert [tuple(r) for r in one.collect()] == [("width", "800.0", "1.0")]


def test_annotation(spark):
    c = frame(spark, MAP)
    out = {r["id"]: r for r in annotate.annotate(maps.records(c), maps.header(c).withColumn("image_available", F.lit(True))).collect()}
    assert out["m1"]["status"] == "invalid" and out["marker__unnamed"]["status"] == "missing" and out["label__l"]["status"] == "outside" and out["settlement__south"]["status"] == "rendered"
    twins = [out['marker__twin__{"x":1,"y":1}'], out['marker__twin__{"x":1,"y":1}#2']]
    assert [t["overlap"] for t in twins] == [1, 2] and twins[1]["label_offset"] and abs(twins[0]["label_y"] - twins[1]["label_y"]) >= 13
    shown = spark.createDataFrame([tuple(r) for r in out.values() if r["status"] == "rendered"], annotate.annotate(maps.records(c), maps.header(c).withColumn("image_available", F.lit(True))).schema)
    svg = annotate.svg(shown.withColumn("name", F.when(F.col("id") == "settlement__south", "<&>").otherwise(F.col("name")))).first()["svg"]
    import xml.dom.minidom

    xml.dom.minidom.parseString(svg)
    assert "&lt;&amp;&gt;" in svg and svg.count("data-record-id") == 4
    assert annotate.duplicate_coordinates(shown).first()["duplicate_coordinates"] == 1
    v = annotate.validation(annotate.classify(annotate.points(maps.records(c)), maps.header(c).withColumn("image_available", F.lit(False)))).first()
    assert v["rendered"] == 0 and v["outside_bounds"] == 1 and v["skipped"] == 7


def test_json_candidates(spark):
    large = "other = " + json.dumps(["x" * 600]) + "; small = [1]; map_x = {bad};"
    rows = [
        (1, 1, "text/javascript", True, 'window.mapData = {"regions":["}"]}; var t = JSON.parse("[1,\\"a\\"]"), u = JSON.parse(\'{"k":"it\\\'s"}\');'),
        (1, 2, "application/json", True, ' {"locations":[]} '), (1, 3, "text/javascript", False, "mapData = [1]"), (2, 1, "text/javascript", True, large), (3, 1, "text/javascript", True, "   "),
    ]
    d = spark.createDataFrame(rows, "page_id long, source_order int, type string, inline boolean, content string")
    got = [(r["page_id"], r["ord"], r["method"], r["name"], r["parsed"], r["output_file"]) for r in candidates.candidates(d).drop("value").orderBy("page_id", "ord").collect()]
    assert [g[2] for g in got] == ["JSON.parse argument", "JSON.parse argument", "named assignment", "JSON script block", "large object or array assignment", "named assignment"]
    assert [g[4] for g in got] == [True] * 5 + [False] and got[2][3] == "mapData" and got[2][5] == "003-mapData.json" and got[5][5] == "002-map_x.txt"
    assert {r["page_id"]: r["name"] for r in candidates.selected(candidates.candidates(d)).collect()} == {1: got[0][3], 2: "other"}
