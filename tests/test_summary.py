import numpy as np
import pytest
from pyspark.sql import functions as F

from latentrank.operators.summary import added_moments, co_moments, correlation, group_quantiles
from latentrank.operators.validate import quantiles


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in rng.choice([0.0, 1.0, 1.0, 1.0, 2.5], 4000)]
    rows += [("wide", float(v)) for v in 10.0 ** rng.uniform(-9, 9, 3000)] + [(None, float(v)) for v in rng.standard_normal(77)]
    return rows + [("one", 4.0), ("none", None), ("nan", float("nan")), ("two", -1.0), ("two", 1.0), ("two", None)]


def test_quantiles_of_many_groups(spark, values):
    at = [0.0, 0.03, 0.25, 0.5, 0.975, 1.0]
    df = spark.createDataFrame(values, "g string, v double")
    for cuts in (256, 3):
        got = {r.g: (r.n, r.quantiles) for r in group_quantiles(df, ["g"], "v", at, cuts).collect()}
        assert set(got) == {"hot", "wide", None, "one", "two"}
        for g, (n, q) in got.items():
            own = [v for k, v in values if k == g and v is not None]
            assert n == len(own) and np.allclose(q, np.quantile(own, at), rtol=1e-12, atol=1e-12)
    own = [v for _, v in values if v is not None and v == v]
    assert np.allclose(quantiles(df, "v", at), np.quantile(own, at), rtol=1e-12)
    assert quantiles(df.where("false"), "v", at) == []


def test_a_common_value_is_one_row_of_the_shuffle(spark):
    df = spark.range(0, 200_000, 1, 4).selectExpr("'all' AS g", "CASE WHEN id % 3 = 0 THEN 7.0 ELSE CAST(id AS double) END AS v")
    want = np.quantile(np.array([7.0 if i % 3 == 0 else float(i) for i in range(200_000)]), [0.2, 0.9])
    assert np.allclose(group_quantiles(df, ["g"], "v", [0.2, 0.9]).first().quantiles, want)


def test_moments_add_up_over_parts_groups_and_nulls(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(900) + 1e6
    y = 0.5 * (x - 1e6) + rng.standard_normal(900) - 1e6
    rows = [(["a", "b", None][i % 3], i % 7, None if i % 5 == 0 else float(x[i]), None if i % 11 == 0 else float(y[i])) for i in range(900)] + [("empty", 0, None, 1.0), ("single", 0, 1.0, 1.0), ("flat", 0, 1.0, 2.0), ("flat", 1, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, part int, x double, y double")
    whole = {r.g: r for r in correlation(co_moments(df, "x", "y", ["g"])).collect()}
    added = {r.g: r for r in correlation(added_moments(co_moments(df, "x", "y", ["g", "part"]), ["g"])).collect()}
    for g in ("a", "b", None):
        both = np.array([(r[2], r[3]) for r in rows if r[0] == g and r[2] is not None and r[3] is not None])
        for got in (whole[g], added[g]):
            assert got.n == len(both) and abs(got.correlation - np.corrcoef(both.T)[0, 1]) < 1e-9
    assert whole["empty"].n == 0 and "empty" not in added
    assert [whole[g].correlation for g in ("empty", "single", "flat")] == [None] * 3 and added["flat"].correlation is None
    total = correlation(added_moments(co_moments(df, "x", "y", ["part"]))).first()
    both = np.array([r[2:] for r in rows if r[2] is not None and r[3] is not None])
    assert total.n == len(both) and abs(total.correlation - np.corrcoef(both.T)[0, 1]) < 1e-9


def test_rounding_is_that_of_sql(spark):
    import duckdb

    from latentrank.functions.scalars import rounded

    values = [(2 * k + 1) / 2e6 + 0.5 for k in range(2000)] + [-1.0000005, 0.0, 1e-9]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r.y for r in rows.select("i", rounded(F.col("x"), 6).alias("y")).orderBy("i").collect()]
    assert got == [r[0] for r in duckdb.execute("SELECT round(unnest($1::DOUBLE[]), 6)", [values]).fetchall()]
    assert got != [r.y for r in rows.select("i", F.round("x", 6).alias("y")).orderBy("i").collect()]
