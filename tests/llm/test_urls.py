from palimpsest.llm import urls

URLS = [
    (1, "http://a.example.net/en/1"), (2, "https://EXAMPLE.net/en/x?q=://z"), (3, "ftp://deep.a.net/"), (4, "http://net/x"), (5, "http://example.com/de/1"), (6, "http://notexample.com/de/1"), (7, "http://x.org/fr/2"),
    (8, "http://x.org/de/2#top"), (9, None), (10, "no scheme"), (11, "http://x.net"), (12, "http://x.net?p"), (13, "http://myexample.net/en/"), (14, ""), (None, "http://x.org/fr/"), (7, "http://x.org/fr/2"), (15, "a://b://c/d"), (16, "http://é.org/fr/ü"),
]


def frame(spark, rows=URLS):
    return spark.createDataFrame(rows, "page_id long, url string")


def test_rules(spark):
    out = {r["page_id"]: r for r in urls.judge(frame(spark)).collect()}
    rule = {i: r["rule"] for i, r in out.items()}
    assert rule[1] == rule[2] == "example.net/en/" and rule[3] == rule[4] == "net/" and rule[5] == "example.com/de/" and rule[7] == rule[16] == "org/fr/" and rule[13] == "net/"
    assert all(rule[i] is None for i in (6, 8, 9, 10, 11, 12, 14, 15))
    assert (out[2]["host"], out[2]["path"]) == ("example.net", "/en/x") and (out[12]["host"], out[12]["path"]) == ("x.net", "") and (out[9]["host"], out[10]["host"]) == ("", "") and out[15]["host"] == "b:"
    assert all(r["verdict"] in ("allow", "block") for r in out.values()) and len(urls.judge(frame(spark)).collect()) == len(URLS)


def test_model_tells_the_classes_apart(spark):
    rows = [(i, f"http://h{i}.org/fr/news{i}") for i in range(200)] + [(1000 + i, f"http://h{i}.net/casino{i}") for i in range(200)]
    rows += [(3000 + i, f"http://q{i}.com/fr/news{i}") for i in range(20)] + [(4000 + i, f"http://q{i}.com/casino{i}") for i in range(20)]
    out = {r["page_id"]: r["verdict"] for r in urls.judge(frame(spark, rows)).collect()}
    assert sum(out[3000 + i] == "allow" for i in range(20)) >= 18 and sum(out[4000 + i] == "block" for i in range(20)) >= 18


def test_native_plan_names_and_empty(spark):
    from pyspark.sql import functions as F

    d = frame(spark).withColumns({c: F.lit("theirs") for c in ("host", "s", "gram", "salt", "n")})
    out = urls.judge(d)
    assert {(r["s"], r["gram"], r["salt"], r["n"]) for r in out.collect()} == {("theirs",) * 4}
    assert out.count() == len(URLS) and "theirs" not in {r["host"] for r in out.collect()}
    assert "Python" not in out._jdf.queryExecution().toString() and urls.judge(frame(spark, [])).count() == 0
