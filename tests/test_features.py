"""Daily features, rolling statistics and scores on hand-made series."""

from __future__ import annotations

from datetime import datetime, timedelta
from math import sqrt

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from rillstone.operators import features
from tests.conftest import rows

START = datetime(2025, 1, 1)
WIDE = "site_no string, time timestamp_ntz, discharge_cfs double"


def quarter_hours(spark, value=lambda i: 1000.0 + i % 10, n=96, schema=WIDE):
    return spark.createDataFrame([("A", START + timedelta(minutes=15 * i), value(i)) for i in range(n)], schema)


def days(spark, values, extra=False):
    data = [("A", START + timedelta(days=i), None if v is None else float(v), i) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "site_no string, date timestamp_ntz, x double, n int")


def test_one_day(spark):
    got = features.daily_features(quarter_hours(spark))
    assert got.columns == ["site_no", "date", "discharge_cfs_mean", "discharge_cfs_max", "discharge_cfs_min"]
    assert rows(got) == [("A", START, 1004.375, 1009.0, 1000.0)]


def test_all_missing_day(spark):
    assert rows(features.daily_features(quarter_hours(spark, lambda i: None))) == [("A", START, None, None, None)]


def test_no_rows_and_no_variable(spark):
    assert features.daily_features(quarter_hours(spark, n=0)).count() == 0
    with pytest.raises(ValueError):
        features.daily_features(quarter_hours(spark).drop("discharge_cfs"))


def test_both_variables_in_order(spark):
    got = features.daily_features(quarter_hours(spark).withColumn("stage_ft", F.lit(2.0)))
    assert got.columns[2:] == [f"{v}_{s}" for v in ("discharge_cfs", "stage_ft") for s in ("mean", "max", "min")]


def test_hole_is_filled_per_series(spark):
    at = [("A", 1), ("A", 5), ("B", 3)]
    df = spark.createDataFrame([(s, datetime(2025, 1, d, 12), 1.0) for s, d in at], WIDE)
    got = [(r[0], r[1].day, r[2]) for r in rows(features.daily_features(df))]
    assert got == [("A", 1, 1.0), ("A", 2, None), ("A", 3, None), ("A", 4, None), ("A", 5, 1.0), ("B", 3, 1.0)]


def test_short_series_has_no_score(spark):
    out = features.rolling_anomaly_z(days(spark, [1.0, 2, 3, 4, 5, 6]))
    assert out.columns == ["site_no", "date", "x", "n", "x_z"]
    assert {r["x_z"] for r in out.collect()} == {None}


def test_constant_and_integer_columns(spark):
    out = features.rolling_anomaly_z(days(spark, [5.0] * 40))
    assert "n_z" not in out.columns and {r["x_z"] for r in out.collect()} == {None}


def test_missing_rows_hold_a_place_but_do_not_count(spark):
    values = [1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0, 9.0] + [None] * 30 + [8.0] * 7
    out = rows(features.rolling_mean_std(days(spark, values), ["x"]), "date")
    means = [r[4] for r in out]
    assert means[6] is None and means[7] == pytest.approx(5.0)
    assert means[29] == pytest.approx(5.0) and means[31] is None
    assert means[-1] == 8.0 and out[-1][5] == 0.0


def test_window_too_small(spark):
    with pytest.raises(ValueError):
        features.rolling_anomaly_z(days(spark, [1.0]), window=6)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_score_bound(spark, values):
    """|z| is at most (n - 1) / sqrt(n) for n values in the window."""
    out = features.rolling_anomaly_z(days(spark, values))
    for i, r in enumerate(sorted(out.collect(), key=lambda r: r["date"])):
        n = sum(v is not None for v in values[max(0, i - 29) : i + 1])
        if r["x_z"] is not None:
            assert n >= 7 and abs(r["x_z"]) <= (n - 1) / sqrt(n) + 1e-6


def test_partitioning_does_not_matter(spark):
    df = quarter_hours(spark, lambda i: float(i * 37 % 101), 96 * 40)
    one = rows(features.rolling_anomaly_z(features.daily_features(df.coalesce(1))))
    many = rows(features.rolling_anomaly_z(features.daily_features(df.repartition(13))))
    assert len(one) == 40 and one == many
