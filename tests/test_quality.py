from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from rillstone.functions import ordered
from rillstone.functions.columns import epoch_micros
from rillstone.operators import quality
from tests.conftest import rows


def readings(spark, times, site="A"):
    return spark.createDataFrame([(site, t) for t in times], "site_no string, time timestamp_ntz")


def every(start, n, minutes=15):
    return [start + timedelta(minutes=minutes * i) for i in range(n)]


def test_perfect_day(spark):
    got = quality.gap_summary(readings(spark, every(datetime(2025, 1, 1), 96))).first()
    assert got["count"] == 96.0 and got["median_step_sec"] == 900.0 and got["max_gap_sec"] == 900.0
    assert got["pct_missing_vs_15min"] == pytest.approx(-1 / 95)
    assert got["start"] == datetime(2025, 1, 1) and got["end"] == datetime(2025, 1, 1, 23, 45)


def test_one_row_and_none(spark):
    got = quality.gap_summary(readings(spark, [datetime(2025, 1, 1)])).first()
    assert tuple(got)[4:] == (None, None, None) and got["count"] == 1.0
    assert quality.gap_summary(readings(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("around", "step"), [(datetime(2025, 3, 9, 9), 75 * 60), (datetime(2025, 11, 2, 8), -45 * 60)]
)
def test_clock_change_shows_on_local_time_only(spark, around, step):
    df = readings(spark, every(around - timedelta(hours=2), 17))
    assert quality.gap_summary(df).first()["max_gap_sec"] == 900.0
    local = quality.gap_summary_local(df).first()
    assert local["max_gap_sec"] == max(900.0, step)
    from rillstone.functions.columns import wall_clock

    steps = quality.step_delta(df.withColumn("w", wall_clock("time", "America/Denver")), clock="w")
    assert step in {r["step_us"] // 1_000_000 for r in steps.collect()}


@pytest.fixture(scope="module")
def uneven(spark):
    """One series holds most rows; another is short; some chunks of a series are empty."""
    big = [datetime(2025, 1, 1) + timedelta(seconds=i * i % 7919 + 40 * i) for i in range(900)]
    small = every(datetime(2025, 1, 1, 5), 5, 200)
    return readings(spark, big).unionByName(readings(spark, small, "B")).unionByName(
        readings(spark, every(datetime(2025, 1, 1), 3), None)
    )


def test_chunked_steps_equal_plain_ones(uneven):
    plain = rows(quality.step_delta(uneven))
    assert rows(quality.step_delta(uneven, rows_per_chunk=50)) == plain
    assert len(plain) == 900 + 5 + 3 - 3


def test_chunked_gap_summary_equals_plain(uneven):
    plain = rows(quality.gap_summary(uneven))
    assert rows(quality.gap_summary(uneven, rows_per_chunk=50, small_group=20)) == plain
    assert len(plain) == 3


def test_buckets_keep_order(spark, uneven):
    inner = ordered.cut_points(uneven, epoch_micros("time"), 10)
    placed = ordered.add_bucket(uneven, epoch_micros("time"), inner, "b").orderBy("time", "b").collect()
    assert [r["b"] for r in placed] == sorted(r["b"] for r in placed)
    assert {r["b"] for r in placed} == set(range(len(inner) + 1))
