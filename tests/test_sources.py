import hashlib
import os

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.parse import parse_pages
from palimpsest.operators import extract
from palimpsest.plans import collect
from palimpsest.sources import pages, sinks
from palimpsest.streaming import log


def test_images(spark):
    s = "capture_id string, url string, source_order int, http_status int, content_type string, body binary, error string"
    rows = [("c", "a", 1, 200, "image/png", b"x", None), ("c", "b", 2, 404, "image/png", b"x", None), ("c", "c", 3, 200, "text/html", b"x", None), ("c", "d", 4, 200, "image/png", b"", None), ("c", "e", 5, None, None, None, "timeout")]
    got = {r["url"]: (r["status"], r["reason"], r["output_file"]) for r in pages.images(spark.createDataFrame(rows, s)).collect()}
    assert got == {"a": ("ok", None, "001.png"), "b": ("failed", "http-status", None), "c": ("failed", "non-image content-type", None), "d": ("failed", "empty body", None), "e": ("failed", "fetch-error", None)}


def test_embedded_and_rewritten(spark):
    html = '<img src="data:image/gif;base64,R0lG"><img src="data:,a+b%20c"><img src="data:text/plain;charset=x,no"><img src="p.png"><img src="p.png"><a href="../">up</a>'
    parsed = parse_pages(spark.createDataFrame([(1, "http://s/d/", html)], "page_id long, url string, html string"))
    got = [(r["ord"], r["mime_type"], bytes(r["body"]), r["output_file"]) for r in pages.embedded(extract.images(parsed)).orderBy("ord").collect()]
    assert got == [(0, "image/gif", b"GIF", "001.gif"), (1, "application/octet-stream", b"a+b c", "002.bin")]
    assert [(r["url"], r["source_order"]) for r in extract.image_urls(parsed).collect()] == [("http://s/d/p.png", 1)]
    stored = spark.createDataFrame([(1, "http://s/d/p.png", "001.png")], "page_id long, url string, output_file string")
    assert {r["target"] for r in extract.rewritten_images(parsed, stored).filter("original_src = 'p.png'").collect()} == {"../images/001.png"}
    assert extract.rewritten_links(parsed).first()["target"] == "../../map/map.md"


@pytest.mark.parametrize("bad", ["/etc/x", "../x", "a/../../x", "", ".", "c:/x", "a\\b"])
def test_paths_stay_inside(bad):
    with pytest.raises(ValueError):
        sinks.inside("/root/out", bad)


def test_publish_log_and_manifests(spark, tmp_path):
    root = str(tmp_path)
    first, second = (spark.createDataFrame([(i,)], "v int") for i in (1, 2))
    sinks.publish(first, root)
    sinks.publish(second, root)
    assert sinks.current(spark, root).first()["v"] == 2
    with pytest.raises(Exception):  # noqa: B017  a failed write leaves the old version and no traces
        sinks.publish(first.select(F.raise_error(F.lit("broken")).alias("v")), root)
    assert sinks.current(spark, root).first()["v"] == 2 and len([n for n in os.listdir(root) if n.startswith("current-")]) == 2
    sinks.rollback(spark, root)
    assert sinks.current(spark, root).first()["v"] == 1
    sinks.append_fetches(spark.createDataFrame([("t", "c", "failed", "boom")], "attempted_at string, capture_id string, status string, error string"), root)
    sinks.append_fetches(spark.createDataFrame([("t", "c", "captured", "m")], "attempted_at string, capture_id string, status string, map_sha256 string"), root)
    assert {(r["status"], r["error"], r["map_sha256"]) for r in sinks.read_fetches(spark, root).collect()} == {("failed", "boom", None), ("captured", None, "m")}
    for name, text in (("a", '{"schema_version":2,"capture_id":"a"}'), ("b", "{broken")):
        os.makedirs(f"{root}/captures/2025-01-01/{name}")
        with open(f"{root}/captures/2025-01-01/{name}/manifest.json", "w") as f:
            f.write(text)
    assert {r["capture_id"] for r in pages.manifests(spark, root).collect()} == {"a", None}
    assert [r[0] for r in spark.createDataFrame([("{",), ("[1]",)], "t string").select(F.to_json(pages.lenient_json(F.col("t")))).collect()] == ["{}", "[1]"]


def test_arguments():
    assert collect.parse_args(["--fragment-max", "900", "--fragment-target", "800", "--fragment-min", "100"]).budget.maximum == 900
    for bad in (["--apply"], ["--nope"], ["--fragment-min", "0"], ["--fragment-min", "11000"]):
        with pytest.raises(ValueError):
            collect.parse_args(bad)


def test_capture_twice(spark, tmp_path):
    p = spark.createDataFrame([(1, "http://a/", '<h1>A</h1><p>x</p><script>mapData={"settlements":[{"name":"N","x":1,"y":2}]}</script>'), (2, "http://b/", "<p>y</p>")], "page_id long, url string, html string")
    one = collect.capture(spark, p, "2025-07-25T00:00:00Z", str(tmp_path))
    assert {r["status"] for r in one["fetches"].collect()} == {"captured"} and one["records"].first()["name"] == "N"
    collect.save(one, str(tmp_path), "2025-07-25T00-00-00Z", "2025-07-25")
    assert spark.read.parquet(f"{tmp_path}/fragments").filter("capture_date = '2025-07-25'").count() == 2
    saved = {n: spark.read.parquet(f"{tmp_path}/{n}").count() for n in ("documents", "written", "records", "scripts", "candidates", "statistics")}
    assert saved == {"documents": 2, "written": 2, "records": 1, "scripts": 1, "candidates": 1, "statistics": 2}
    before = one["fragments"].join(p.select("page_id", F.sha2("html", 256).alias("page_sha256")), "page_id")
    changed = p.withColumn("html", F.when(F.col("page_id") == 2, F.lit("<p>z</p>")).otherwise(F.col("html")))
    body = bytearray(b"PNG")
    attempts = spark.createDataFrame([(1, "http://a/i", 1, 200, "image/PNG; q", body, None), (1, "http://a/j", 2, 404, "image/png", body, None)], "page_id long, url string, source_order int, http_status int, content_type string, body binary, error string")
    two = collect.capture(spark, changed, "2025-07-26T00:00:00Z", str(tmp_path), before, images=attempts)
    sha = hashlib.sha256(b"PNG").hexdigest()
    rows = [("http://a/i", "ok", sha, "200", "image/png", "3", "", ""), ("http://a/j", "failed", "", "404", "", "", "", "")]
    assert {r["page_id"]: r["image_digest"] for r in two["fetches"].collect()} == {1: hashlib.sha256("\n".join(map("\0".join, rows)).encode()).hexdigest(), 2: None}
    assert {r["page_id"]: r["status"] for r in two["fetches"].collect()} == {1: "unchanged", 2: "captured"} and {r["page_id"] for r in two["written"].collect()} == {2}


def test_stream(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "log")
    page = lambda n, h: spark.createDataFrame([(n, "http://a/", h)], log.PAGES).coalesce(1).write.mode("append").parquet(folder)
    for n, h in enumerate(("x", "x", "y")):
        page(n, h)
        log.follow(log.landed(spark, folder), out, str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(out).orderBy("batch").collect()
    assert [r["status"] for r in rows] == ["captured", "unchanged", "captured"]
