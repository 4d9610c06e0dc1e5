import math

import duckdb
import pytest

import __spark_entry__
from latentrank.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(round(float(v), 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalog.SQL[name]})").fetchall()
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(plain(v) for v in r) for r in want)
    assert rows


def test_entry_gives_scores(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["doc_id", "score", "lower", "upper"] and got.count() > 0


def test_planted_order_is_found(spark):
    from pyspark.sql import functions as F

    got = catalog.scaling_run(spark, "/root/testdata/sf0.01")
    truth = catalog._emb(spark, "/root/testdata/sf0.01").select("doc_id", catalog.S.dot(F.col("embedding"), catalog.S.literal(catalog.V)).alias("truth"))
    assert got.join(truth, "doc_id").select(F.corr("score", "truth")).first()[0] > 0.95


def test_sql_has_a_query_each():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
