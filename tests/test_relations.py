from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.operators import filters, least_squares, relational, shape, timeseries
from tests.conftest import rows


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "n")], "k int, l string")
    right = spark.createDataFrame([(2, "x"), (3, "y"), (None, "z")], "k int, r string")
    return left, right


@pytest.mark.parametrize(("how", "n"), [("inner", 2), ("left", 4), ("right", 4), ("full", 6)])
def test_joins(sides, how, n):
    assert relational.merge(*sides, "k", how).count() == n
    with pytest.raises(ValueError):
        relational.merge(*sides, "k", "cross")


def test_melt_and_pivot_are_inverse(spark):
    wide = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, None)], "k int, a double, b double")
    long = relational.melt(wide, ["k"], ["a", "b"])
    assert long.count() == 4
    assert rows(relational.pivot(long, ["k"], "variable", "value", ["a", "b"])) == rows(wide)


def test_units_and_histogram(spark):
    df = spark.createDataFrame([(2.0, "ft"), (1.0, "m"), (1.0, "?")], "v double, u string")
    got = rows(relational.convert_units(df, "v", "u", {"ft": 0.5, "m": 1.0}, "m"), F.col("u"))
    assert [r[2] for r in got] == [None, 1.0, 1.0]
    h = rows(relational.histogram(spark.range(11), "id", 5))
    assert [r[3] for r in h] == [2, 2, 2, 2, 3] and h[0][1] == 0 and h[-1][2] == 10
    one = rows(relational.histogram(spark.range(1), "id", 5))
    assert one == [(0, 0.0, 0.0, 1)]


def test_constant_column_scales_to_null(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    for kind in ("standard", "minmax"):
        assert {r["v_scaled"] for r in relational.scale_features(df, ["v"], kind).collect()} == {None}
    assert {r["robust_z"] for r in timeseries.robust_z(df.withColumn("g", F.lit(1)), "v", ["g"]).collect()} == {None}


def test_outliers_same_on_both_quantile_ways(spark):
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), F.pow((F.col("id") * 17 % 1999) / 100.0, 6).alias("v"))
    plain = rows(relational.iqr_outliers(df, "v", ["g"]))
    assert plain and rows(relational.iqr_outliers(df, "v", ["g"], small_group=1, accuracy=100)) == plain


def test_where_and_time_bounds(spark):
    df = spark.createDataFrame([(datetime(2025, 1, d), float(d)) for d in range(1, 6)], "time timestamp_ntz, v double")
    assert filters.time_range(df, start="2025-01-02", end="2025-01-04").count() == 3
    assert filters.time_range(df, start="2025-01-02T01:00:00+01:00").count() == 4
    assert filters.time_range(df).count() == 5
    with pytest.raises(ValueError):
        filters.time_range(df, start="yesterday")
    with pytest.raises(Exception):
        filters.where_expr(df, "nothing > 1").collect()
    assert filters.where_expr(df, "  ").count() == 5
    assert filters.trailing_window(df, 2).count() == 3
    assert filters.trailing_window(df, 2, end=datetime(2025, 1, 3)).count() == 5
    with pytest.raises(ValueError):
        filters.trailing_window(df, 0)
    text = "PushedFilters: [IsNotNull(time)"
    assert text not in df._jdf.queryExecution().toString()


def test_column_lists(spark):
    df = spark.range(1).selectExpr("id AS a", "id AS b")
    assert shape.select_columns(df, " b ,, a ").columns == ["b", "a"]
    assert shape.select_columns(df, " , ").columns == ["a", "b"]


def test_coerce_datetimes(spark):
    data = [("2024-01-01", "x", "2024-01-01", datetime(2024, 1, 1))] * 4 + [("oops", "y", None, None)]
    df = spark.createDataFrame(data, "a string, b string, c string, d timestamp")
    types = dict(shape.coerce_datetimes(df).dtypes)
    assert types == {"a": "timestamp_ntz", "b": "string", "c": "timestamp_ntz", "d": "timestamp_ntz"}
    assert dict(shape.coerce_datetimes(df.limit(0)).dtypes)["a"] == "string"
    assert shape.coerce_time_column(df, "nothing") is df
    got = [r["a"] for r in shape.coerce_time_column(df, "a").collect()]
    assert got.count(None) == 1


def test_chart_frame_is_bounded(spark):
    df = spark.range(1000).select(
        F.lit("A").alias("site_no"),
        F.timestamp_add("MINUTE", F.col("id").cast("int"), F.lit("2025-01-01").cast("timestamp_ntz")).alias("time"),
        F.col("id").cast("double").alias("discharge_cfs"),
    )
    got = rows(shape.chart_frame(df, bucket="hour"))
    assert len(got) == 17 and got[0][2:] == ("discharge_cfs", 0.0, 59.0, 29.5, 60)


def daily(spark, values):
    start = datetime(2025, 1, 1)
    return spark.createDataFrame(
        [("A", start + timedelta(days=i), float(v)) for i, v in enumerate(values)], "s string, date timestamp_ntz, x double"
    )


def test_decomposition_adds_up(spark):
    df = daily(spark, [10 + i + [0, 3, -3][i % 3] for i in range(30)])
    out = timeseries.seasonal_decompose(df, "x", ["s"], "date", 3).orderBy("date").collect()
    assert out[0]["trend"] is None and out[1]["trend"] == pytest.approx(11)
    for r in out[1:-1]:
        assert r["trend"] + r["seasonal"] + r["residual"] == pytest.approx(r["x"])
        assert r["residual"] == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        timeseries.seasonal_decompose(df, "x", ["s"], "date", 1)
    even = daily(spark, [10 + i + [0, 3, -3, 8][i % 4] for i in range(40)])
    out = timeseries.seasonal_decompose(even, "x", ["s"], "date", 4).orderBy("date").collect()
    assert [r["trend"] for r in out[:2]] == [None, None] and out[2]["trend"] == pytest.approx(12 + 2)
    assert all(r["residual"] == pytest.approx(0, abs=1e-9) for r in out[2:-2]) and out[-1]["residual"] is None
    two = daily(spark, [5 + [0, 3, -3][i % 3] + [1, 0, 0, -1][i % 4] for i in range(120)])
    out = timeseries.seasonal_decompose(two, "x", ["s"], "date", [4, 3]).orderBy("date").collect()
    for r in out[2:-2]:
        assert r["trend"] + r["seasonal_3"] + r["seasonal_4"] + r["residual"] == pytest.approx(r["x"])
        assert r["residual"] == pytest.approx(0, abs=0.1) and "phase" not in r


def test_forecast_of_an_exact_recurrence(spark):
    values = [1.0, 2.0]
    for _ in range(20):
        values.append(0.5 * values[-1] + 0.3 * values[-2] + 1.0)
    got = timeseries.ar_forecast(daily(spark, values), "x", ["s"], "date", lags=2, horizon=3).orderBy("step").collect()
    for r in got:
        values.append(0.5 * values[-1] + 0.3 * values[-2] + 1.0)
        assert r["forecast"] == pytest.approx(values[-1], rel=1e-6)
    assert got[0]["coef"] == pytest.approx([1.0, 0.5, 0.3], rel=1e-5)


def test_first_order_forecast_agrees(spark):
    rng = np.random.default_rng(1)
    df = daily(spark, rng.normal(size=60).cumsum())
    one = timeseries.ar1_fit(df, "x", ["s"], "date").first()
    many = timeseries.ar_forecast(df, "x", ["s"], "date", lags=1, horizon=1).first()
    assert many["coef"] == pytest.approx([one["intercept"], one["slope"]])
    assert many["forecast"] == pytest.approx(one["forecast"])


def test_unit_root_statistic(spark):
    rng = np.random.default_rng(2)
    noise = rng.normal(size=200)
    still = timeseries.dickey_fuller(daily(spark, noise), "x", ["s"], "date").first()["t_stat"]
    walk = timeseries.dickey_fuller(daily(spark, noise.cumsum()), "x", ["s"], "date").first()["t_stat"]
    assert still < -8 < walk


def test_lags_never_see_the_row_itself(spark):
    out = timeseries.lag_rolling_features(daily(spark, range(10)), "x", ["s"], "date", [1], [3]).orderBy("date").collect()
    assert out[5]["x_lag1"] == 4 and out[5]["x_mean3"] == 3 and out[0]["x_mean3"] is None


@pytest.mark.parametrize("kind", ["expanding", "rolling"])
def test_folds_train_before_test(spark, kind):
    out = timeseries.temporal_folds(daily(spark, range(50)), "date", 4, kind)
    ends = out.groupBy("fold").pivot("role", ["train", "test"]).agg(F.min("date").alias("a"), F.max("date").alias("z")).collect()
    assert len(ends) == 4 and all(r["train_z"] < r["test_a"] for r in ends)
    assert out.filter("role = 'test'").select("date").distinct().count() == 40


def test_regressions_of_many_groups(spark):
    rng = np.random.default_rng(4)
    data = []
    for g in range(5):
        x = rng.normal(size=(40, 2))
        if g == 3:
            x[:, 1] = 2 * x[:, 0] - 1
        if g == 4:
            x = x[:3]
        y = 1 + g * x[:, 0] - 2 * x[:, 1] + rng.normal(0, 0.1, len(x))
        data += [(g, *map(float, r), float(v)) for r, v in zip(x, y, strict=True)]
    df = spark.createDataFrame([*data, (0, None, 1.0, 1.0)], "g int, a double, b double, y double")
    got = {r["g"]: r for r in least_squares.grouped_least_squares(df, ["g"], "y", ["a", "b"]).collect()}
    for g in range(3):
        part = np.array([r[1:] for r in data if r[0] == g])
        m = np.column_stack([np.ones(40), part[:, :2]])
        coef, sse, *_ = np.linalg.lstsq(m, part[:, 2], rcond=None)
        assert got[g]["coef"] == pytest.approx(coef.tolist()) and got[g]["sse"] == pytest.approx(sse[0]) and got[g]["n"] == 40
        error = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * sse[0] / 37)
        assert got[g]["std_error"] == pytest.approx(error.tolist()) and not got[g]["collinear"]
    assert got[3]["collinear"] and got[3]["coef"] is None and got[3]["sse"] is None
    assert got[4]["coef"] is not None and got[4]["std_error"] is None
    ridge = {r["g"]: r for r in least_squares.grouped_least_squares(df, ["g"], "y", ["a", "b"], 10.0).collect()}
    assert ridge[3]["coef"] is not None and abs(ridge[1]["coef"][2]) < abs(got[1]["coef"][2])


def test_unit_root_with_lags(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=300).cumsum()
    got = timeseries.dickey_fuller(daily(spark, x), "x", ["s"], "date", lags=2).first()
    dx = np.diff(x)
    m = np.column_stack([np.ones(297), x[2:-1], dx[1:-1], dx[:-2]])
    coef, sse, *_ = np.linalg.lstsq(m, dx[2:], rcond=None)
    error = np.sqrt(np.linalg.inv(m.T @ m)[1, 1] * sse[0] / (297 - 4))
    assert (got["n"], got["slope"], got["std_error"]) == (297, pytest.approx(coef[1]), pytest.approx(error))
    flat = timeseries.dickey_fuller(daily(spark, [1.0] * 30), "x", ["s"], "date", lags=2).first()
    assert flat["slope"] is None and timeseries.ar_forecast(daily(spark, [1.0] * 30), "x", ["s"], "date").count() == 0
