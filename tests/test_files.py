from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rillstone.operators import profile
from rillstone.sources import files
from tests.conftest import rows


def daily(spark):
    data = [(datetime(2020, 1, d), float(d)) for d in (1, 2, 3)]
    return spark.createDataFrame(data, "date timestamp_ntz, value double")


def test_round_trip(spark, tmp_path):
    daily(spark).write.parquet(str(tmp_path / "d"))
    back = files.read_parquet(spark, [str(tmp_path / "d")])
    assert back.columns == ["date", "value"] and rows(back) == rows(daily(spark))
    assert files.read_parquet(spark, [str(tmp_path / "d")], ["value"]).columns == ["value"]
    with pytest.raises(Exception):
        files.read_parquet(spark, [str(tmp_path / "d")], ["nothing"])


def test_paths_and_reports_per_file(spark, tmp_path):
    for name in ("a", "b"):
        daily(spark).coalesce(1).write.parquet(str(tmp_path / name))
    found, missing = files.resolve_paths(
        spark, [str(tmp_path / "*"), str(tmp_path / "a"), str(tmp_path / "none*")]
    )
    assert len(found) == 2 and missing == [str(tmp_path / "none*")]
    df = files.read_parquet(spark, found, with_file=True)
    info = files.dataset_info(df).collect()
    assert [(r["n_rows"], r["n_columns"]) for r in info] == [(3, 2), (3, 2)]
    assert all(r["n_bytes"] > 0 for r in info)
    extent = files.per_file(df, F.min("date").alias("lo"), F.max("date").alias("hi"))
    assert {r["hi"] for r in extent.collect()} == {datetime(2020, 1, 3)}


CSV = "state,dep_type,latitude,longitude\nUT,vein,38.5,-109\nCO,NA,,-108.5\n,sandstone,n/a,-107\nUT,,39,N/A\nUT, vein,1,2\n"


def test_csv_null_tokens(spark, tmp_path):
    (tmp_path / "m.csv").write_text(CSV)
    schema = "state string, dep_type string, latitude double, longitude double"
    df = files.read_csv(spark, str(tmp_path / "m.csv"), schema)
    assert [tuple(r) for r in df.collect()] == [
        ("UT", "vein", 38.5, -109.0),
        ("CO", None, None, -108.5),
        (None, "sandstone", None, -107.0),
        ("UT", None, 39.0, None),
        ("UT", " vein", 1.0, 2.0),
    ]
    assert files.read_csv(spark, str(tmp_path / "m.csv"), schema, ["latitude"]).columns == ["latitude"]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "m.csv"), schema, ["nothing"])
    assert [tuple(r) for r in profile.count_by(df, "state").collect()] == [("UT", 3), (None, 1), ("CO", 1)]


def test_csv_bad_number_raises(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a\nx\n")
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "m.csv"), "a double").collect()


def test_read_through_table(spark, tmp_path):
    calls = []

    def build(v):
        def made():
            calls.append(v)
            return spark.createDataFrame([("A", v), ("B", v)], "site_no string, v double")

        return made

    tag = files.window_tag("dv", 5)
    assert tag == "dv_5y" and files.window_tag("iv", 7) == "iv_7d"
    run = lambda v, **k: rows(files.materialize_if_absent(spark, str(tmp_path), tag, build(v), **k).select("site_no", "v"))
    assert run(1.0) == [("A", 1.0), ("B", 1.0)]
    assert run(2.0) == [("A", 1.0), ("B", 1.0)] and calls == [1.0]
    assert run(3.0, refresh=True) == [("A", 3.0), ("B", 3.0)]
    only_b = lambda: spark.createDataFrame([("B", 9.0)], "site_no string, v double")
    again = files.materialize_if_absent(spark, str(tmp_path), tag, only_b, refresh=True)
    assert rows(again.select("site_no", "v")) == [("A", 3.0), ("B", 9.0)]


def test_read_through_keeps_types_and_adds_sites(spark, tmp_path):
    made = lambda: spark.createDataFrame([("09095500", 1.0), ("09152500", 2.0)], "site_no string, v double")
    one = lambda: made().limit(1)
    files.materialize_if_absent(spark, str(tmp_path), "iv_7d", one, wanted=["09095500"])
    again = files.materialize_if_absent(spark, str(tmp_path), "iv_7d", one, wanted=["09095500"])
    assert rows(again) == [("09095500", 1.0)] and again.schema == made().schema
    more = files.materialize_if_absent(spark, str(tmp_path), "iv_7d", made, wanted=["09095500", "09152500"])
    assert rows(more) == [("09095500", 1.0), ("09152500", 2.0)]


def test_read_through_remembers_sites_without_rows_and_odd_names(spark, tmp_path):
    calls = []

    def made():
        calls.append(1)
        return spark.createDataFrame([("a/b=c %", 1.0), ("x", 2.0)], "site_no string, v double")

    wanted = ["a/b=c %", "never there"]
    for _ in range(3):
        got = files.materialize_if_absent(spark, str(tmp_path), "iv_7d", made, wanted=wanted)
        assert rows(got) == [("a/b=c %", 1.0), ("x", 2.0)]
    assert len(calls) == 1
    assert rows(files.materialize_if_absent(spark, str(tmp_path), "iv_7d", made, wanted=["x"])) == rows(got) and len(calls) == 1


def test_read_through_after_a_crash(spark, tmp_path):
    """Data without a note are not finished, whatever marks they have."""
    spark.createDataFrame([("A", "old")], "site_no string, other string").write.partitionBy("site_no").parquet(f"{tmp_path}/iv_7d")
    made = lambda: spark.createDataFrame([("B", 2.0)], "site_no string, v double")
    for _ in range(2):
        assert rows(files.materialize_if_absent(spark, str(tmp_path), "iv_7d", made)) == [("B", 2.0)]
