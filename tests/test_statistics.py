"""Group statistics reach their rows without a shuffle of the rows, and nothing is crossed."""

import pytest
from pyspark.sql import functions as F

from rillstone.functions.quantiles import exact_quantiles
from rillstone.functions.statistics import join_statistics
from rillstone.operators import evaluate, relational, timeseries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def small_threshold(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def readings(spark):
    return spark.range(3000).select("id", (F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(997)).cast("double").alias("v"))


def test_rows_stay_where_they_are(spark, small_threshold):
    df = readings(spark)
    for out in (timeseries.robust_z(df, "v", ["g"]), relational.iqr_outliers(df, "v", ["g"])):
        assert "Exchange hashpartitioning" not in plan(out) and "CartesianProduct" not in plan(out)


def test_many_groups_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, k string")
    sizes = df.groupBy("k").agg(F.count("*").alias("n"))
    for most in (0, 10):
        assert {(r.id, r.n) for r in join_statistics(df, sizes, ["k"], most=most).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_brackets_without_keys_cross_nothing(spark, small_threshold):
    df = readings(spark)
    got = exact_quantiles(df, [], "v", [0.5], small_group=1, accuracy=100)
    assert "CartesianProduct" not in plan(got)
    assert got.first()[0] == exact_quantiles(df, [], "v", [0.5]).first()[0]


def test_equal_tickets_are_dealt_by_key(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "ticket", lambda key, seed: F.lit(7))
    df = readings(spark)
    for options in ({}, {"rows_per_chunk": 100}):
        got = evaluate.stratified_split(df, "id", "g", 0.8, **options).filter("split = 'train'")
        assert {r["id"] for r in got.collect()} == set(range(2400))
