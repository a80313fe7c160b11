from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rillstone.operators import features
from rillstone.streaming import daily
from tests.conftest import rows

SCHEMA = "id long, site_no string, time timestamp_ntz, discharge_cfs double"


def land(spark, folder, name, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    part = next((folder / name).glob("*.parquet"))
    part.rename(folder / f"{name}.parquet")


def test_days_close_in_order_and_repeats_count_once(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    start = datetime(2025, 1, 1)
    first = [(i, "A", start + timedelta(hours=6 * i), float(i)) for i in range(12)]
    land(spark, landing, "a", first)
    schema = spark.createDataFrame([], SCHEMA).schema
    build = lambda: daily.daily_stream(
        daily.reading_stream(spark, str(landing), schema), ["discharge_cfs"], reading_key=["id"], delay="1 day"
    )
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    one = rows(daily.drain(build(), out, state))
    assert [r[1].day for r in one] == [1]

    # A late reading inside the delay, a repeat, and newer days; the stream goes on from its state.
    more = [(100, "A", start + timedelta(days=2, hours=1), 50.0), first[-1]]
    more += [(200 + i, "A", start + timedelta(days=3 + i), 1.0) for i in range(3)]
    land(spark, landing, "b", more)
    got = rows(daily.drain(build(), out, state))
    assert [r[1].day for r in got] == [1, 2, 3, 4]

    every = spark.createDataFrame(first + more, SCHEMA).dropDuplicates(["id"])
    batch = features.daily_features(every).select("site_no", "date", "discharge_cfs_mean", "discharge_cfs_max", "discharge_cfs_min")
    closed = batch.filter(F.col("date") < start + timedelta(days=4))
    assert got == rows(closed)
