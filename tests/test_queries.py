"""Every query that SQL can express, against DuckDB on the small driver tables."""

import os

import pytest

from quarryline.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def comparable(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: f"{v:.6g}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = comparable(QUERIES[name](spark, SF).toPandas()), comparable(duck.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want), got.compare(want) if got.shape == want.shape else (got.shape, want.shape)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_results_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    one = comparable(QUERIES["rrf_hybrid"](spark, SF).toPandas())
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert comparable(QUERIES["rrf_hybrid"](spark, SF).toPandas()).equals(one)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry_has_all_queries():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
