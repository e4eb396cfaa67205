import os

import duckdb
import pytest

from palimpsest.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = db.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    key = lambda r: str(r)
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=key)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    catalogue.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
