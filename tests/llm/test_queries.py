"""Registered queries against their SQL and the pipeline against its stages, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op1_quality", "op2_topk", "op9_mixing", "op10_urls"])
def test_equals_sql(spark, db, name):
    from palimpsest.llm import queries

    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    rows = Counter(tuple(r[names.index(c)] for c in columns) for r in want.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == rows


def test_pipeline_equals_its_parts(spark):
    import corpus_pipeline as p
    from palimpsest.llm import jaccard, toxicity, words

    docs = words.read(spark, SF, "documents")
    tagger = toxicity.train(docs, words.read(spark, SF, "labels"))
    clean = {r["doc_id"] for r in toxicity.score(docs, tagger).collect() if r["tox_score"] < 0.5}
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect() if r["doc_id"] in clean]
    from tests.llm.test_jaccard import brute

    first = {i for i, (_, c) in brute(texts, 80, 5).items() if i == c}
    out = p.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == first and len(out) == len(first)

    # What is encoded is the text with its personal data replaced, in the order of the mixture.
    import hashlib

    from pyspark.sql import functions as F

    from palimpsest.llm import mixing, pii

    kept = docs.filter(F.col("doc_id").isin(*first))
    new = {r["doc_id"]: r["text"] for r in pii.pseudonymise(kept.select("doc_id", "text")).collect()}
    places = {r["doc_id"]: r["seq"] for r in mixing.schedule(kept.select("doc_id", "source")).collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256((new[r["doc_id"]] or "").encode()).hexdigest() and r["position"] == places[r["doc_id"]] for r in out)
    assert any(new[r["doc_id"]] != r["text"] for r in kept.collect()) and sorted(places.values()) != [places[i] for i in sorted(places)]


def test_position_survives_files(spark, docs, tmp_path):
    import corpus_pipeline as p

    path = f"{tmp_path}/mixed"
    p.mix_sources(spark, docs, SF).repartition(3).write.parquet(path)
    out = p.tokenize(spark, spark.read.parquet(path), SF).collect()
    assert len({r["position"] for r in out}) == len(out) == docs.count()
    again = p.tokenize(spark, docs, SF).collect()
    place = lambda rows: {r["doc_id"]: r["position"] for r in rows}
    assert place(out) == place(again)


def test_stages_keep_columns_and_take_empty_tables(spark, empty, clashing):
    import corpus_pipeline as p

    for _, stage in p.STAGES[:-1]:
        assert stage(spark, empty, SF).columns == empty.columns and stage(spark, empty, SF).count() == 0
        assert stage(spark, clashing, SF).columns == clashing.columns
    assert p.STAGES[-1][1](spark, empty, SF).count() == 0


def test_shingle_width_of_the_stage(spark):
    import inspect

    import corpus_pipeline as p

    assert "percent=80, k=5" in inspect.getsource(p.drop_near_duplicates)
