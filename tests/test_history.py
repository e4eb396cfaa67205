import pytest
from pyspark.sql import functions as F

from palimpsest.functions.parse import parse_pages
from palimpsest.operators import diff, fragments, history, migrate, sparse


def test_identity(spark):
    r = spark.range(1).select(history.capture_identity(F.lit("2025-07-26T10:11:12.345Z")).alias("c")).select("c.*").first()
    assert (r["capture_date"], r["capture_id"]) == ("2025-07-26", "2025-07-26T10-11-12Z")
    with pytest.raises(Exception, match="invalid capture time"):
        spark.range(1).select(history.capture_identity(F.lit("soon")).alias("c")).collect()


def test_captures_as_of(spark):
    rows = [(2, "c1", "2025-07-25T00:00:00Z", "x", "h", "h"), (2, "c2", "2025-07-26T00:00:00Z", "x", "h", "h"), (2, "c3", "2025-07-27T00:00:00Z", "", "h", "h"), (1, "old", "2025-07-28T00:00:00Z", "x", "h", "h"), (2, "bad", "never", "x", "h", "h"), (2, None, "2025-07-26T00:00:00Z", "x", "h", "h")]
    m = spark.createDataFrame(rows, "schema_version int, capture_id string, started_at string, completed_at string, map_sha256 string, codex_sha256 string")
    v = history.valid_captures(m)
    assert {r["capture_id"] for r in v.collect()} == {"c1", "c2", "bad"}
    assert history.previous_capture(v, "2025-07-26T00:00:00Z").first()["capture_id"] == "c1" and history.previous_capture(v, "2025-07-25T00:00:00Z").isEmpty()
    assert {r["capture_id"]: r["previous_capture_id"] for r in history.with_previous(v).collect()} == {"c1": None, "c2": "c1", "bad": None}


def test_unchanged_needs_known_hashes(spark):
    s = "k int, map_sha256 string, codex_sha256 string, image_digest string"
    cur = spark.createDataFrame([(1, "a", "b", "c"), (2, "a", "b", None), (3, "a", "b", "c"), (4, "a", "x", "c")], s)
    old = spark.createDataFrame([(1, "a", "b", "c"), (2, "a", "b", None), (4, "a", "b", "c")], s)
    assert {r["k"]: r["unchanged"] for r in history.unchanged(cur, old, "k").collect()} == {1: True, 2: False, 3: False, 4: False}


def plain(a, b):
    """Unified diff by the definition, for comparison."""
    if a == b:
        return ""
    x, y = (s.removesuffix("\n").split("\n") for s in (a, b))
    p = next((i for i, (m, n) in enumerate(zip(x, y, strict=False)) if m != n), min(len(x), len(y)))
    s = next((i for i, (m, n) in enumerate(zip(x[p:][::-1], y[p:][::-1], strict=False)) if m != n), min(len(x), len(y)) - p)
    lo, t = max(0, p - 3), min(3, s)
    cx, cy = len(x) - s + t - lo, len(y) - s + t - lo
    body = [" " + i for i in x[lo:p]] + ["-" + i for i in x[p : len(x) - s]] + ["+" + i for i in y[p : len(y) - s]] + [" " + i for i in x[len(x) - s : len(x) - s + t]]
    return "\n".join(["--- previous", "+++ current", f"@@ -{lo + 1},{cx} +{lo + 1},{cy} @@", *body]) + "\n"


def test_unified_diff(spark):
    texts = ["", "a", "a\nb\nc\nd\ne\nf\ng\nh", "a\nb\nc\nd\nX\nf\ng\nh", "a\nb\nc\nd\ne\nf\ng\nh\n", "h", "a\na\na", "a\na", "q\nb\nc\nd\ne\nf\ng\nz"]
    pairs = [(a, b) for a in texts for b in texts]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", diff.unified(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r["d"] == plain(r["a"], r["b"]) for r in got)


PAGES = {"c1": "<h1>A</h1><p>one</p><h2>B</h2><p>two</p><h2>C</h2><p>three</p>", "c2": "<h1>A</h1><p>one</p><h2>B</h2><p>TWO</p><h2>C</h2><p>three</p>", "c3": "<h1>A</h1><p>one</p><h2>B</h2><p>TWO</p><h2>C</h2><p>three</p><h1>New</h1>"}


def tree(spark, html):
    return fragments.fragments(parse_pages(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")))


def test_sparse_storage_over_captures(spark):
    captures = [(c, f"2025-07-0{i}", tree(spark, h)) for i, (c, h) in enumerate(PAGES.items(), 1)]
    applied = []
    places, store, errors = migrate.migrate(captures, apply=lambda p, s: applied.append(1))
    assert errors.isEmpty() and applied
    at = {r["id"]: r["materialized_capture"] for r in places.collect()}
    assert at == {"a": "c2", "a__b": "c2", "a__c": "c1", "new": "c3"}  # a changed child moves its parents only
    view = {r["id"]: r["body"] for r in sparse.current_view(places, store).collect()}
    assert view["a__b"] == "## B\n\nTWO" and set(view) == set(at)
    assert migrate.accounting(captures[-1][2], store).first()["stored_fragments"] == 3 + 2 + 1
    assert [len(r["pointers"]) for r in sparse.composite(places).collect()] == [2] and migrate.is_migrated(places) and not migrate.is_migrated(captures[0][2])


def test_integrity(spark):
    full = tree(spark, PAGES["c1"])
    none = full.limit(0).select("page_id", "id", *[F.lit(None).cast("string").alias(c) for c in sparse.LOCATION])
    places = sparse.materialize(full, none, "page_id", "c1", "2025-07-01")
    store = sparse.written(places, fragments.bodies(full), "page_id", "c1")
    assert sparse.violations(places, store).isEmpty()
    broken = store.withColumn("body", F.when(F.col("id") == "a__b", "altered").otherwise(F.col("body"))).filter("id <> 'a__c'")
    assert {(r["id"], r["error"]) for r in sparse.violations(places, broken).collect()} == {("a__b", "hash mismatch"), ("a__c", "missing body")}
    with pytest.raises(Exception, match="missing or altered"):
        sparse.current_view(places, broken).collect()
    assert sparse.legacy(full, "c0", "2025-06-30").first()["materialized_capture"] == "c0"


def test_structural_diff(spark):
    changes = {(r["id"], r["change"]) for r in diff.fragments(tree(spark, PAGES["c3"]), tree(spark, PAGES["c1"])).collect()}
    assert changes == {("new", "added"), ("a__b", "changed")}
    flags = diff.flags(spark.createDataFrame([("map", "1", "2", "3"), ("new", "1", "1", "1")], "source string, raw_sha256 string, text_sha256 string, structure_sha256 string"), spark.createDataFrame([("map", "1", "9", "3")], "source string, raw_sha256 string, text_sha256 string, structure_sha256 string"))
    assert {r["source"]: (r["raw_changed"], r["text_changed"], r["structure_changed"]) for r in flags.collect()} == {"map": (False, True, False), "new": (True, True, True)}


def test_legacy_files():
    text = '---\na: 1\n---\n\n## B\n\nown ![[kept]]\n\n![[kept.md]]\n\n![[001-x.md]]\n'
    assert migrate.own_content(text, "B", 1) == "own ![[kept]]\n\n![[kept.md]]" and migrate.own_content("plain", None, 0) == "plain"
