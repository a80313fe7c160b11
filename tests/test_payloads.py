"""Landed payloads: nesting, blanks, offsets, ignored parts."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rillstone.functions.columns import decode_reading
from rillstone.operators import shape
from rillstone.sources import payloads
from tests.conftest import rows


def point(value, at):
    return {"value": value, "dateTime": at}


def series(code, *points, name="s", more=(), codes=()):
    return {
        "name": name,
        "variable": {"variableCode": [{"value": code}, *[{"value": c} for c in codes]]},
        "values": [{"value": list(points)}, *[{"value": list(m)} for m in more]],
    }


def payload(*series_list, url="u"):
    return {"value": {"queryInfo": {"queryURL": url}, "timeSeries": list(series_list)}}


FLOW = series(
    "00060",
    point("10.5", "2025-01-01T00:00:00.000-06:00"),
    point("", "2025-01-01T06:15:00.000Z"),
    point(None, "2025-01-01T06:30:00.000Z"),
    point("-999999", "2025-01-01T06:45:00.000Z"),
    more=[[point("77", "2025-01-01T07:00:00.000Z")]],
    codes=["99999"],
    name="flow",
)
STAGE = series("00065", point("3.25", "2025-01-01T06:00:00.000Z"), name="stage")
EMPTY = series("00010")


def land(tmp_path, **sites):
    for site, body in sites.items():
        folder = tmp_path / f"site_no={site}"
        folder.mkdir()
        (folder / "a.json").write_text(json.dumps(body, indent=1))
    return str(tmp_path)


def test_instantaneous_from_files(spark, tmp_path):
    path = land(tmp_path, A=payload(FLOW, STAGE, EMPTY), B=payload())
    got = rows(payloads.instantaneous(payloads.read_payloads(spark, path)), "code", "time")
    at = lambda h, m: datetime(2025, 1, 1, h, m)
    assert got == [
        ("A", "00060", at(6, 0), 10.5),
        ("A", "00060", at(6, 15), None),
        ("A", "00060", at(6, 30), None),
        ("A", "00060", at(6, 45), -999999.0),
        ("A", "00065", at(6, 0), 3.25),
    ]


def test_align_and_rename(spark, tmp_path):
    path = land(tmp_path, A=payload(FLOW, STAGE))
    long = payloads.instantaneous(payloads.read_payloads(spark, path), no_data=[-999999.0])
    wide = shape.rename_codes(shape.align_variables(long, ["00060", "00065"]))
    assert wide.columns == ["site_no", "time", "discharge_cfs", "stage_ft"]
    assert [r[2:] for r in rows(wide, "time")] == [(10.5, 3.25), (None, None), (None, None), (None, None)]


def test_repeated_time_is_an_error_unless_allowed(spark):
    at = datetime(2025, 1, 1)
    long = spark.createDataFrame(
        [("A", "00060", at, 1.0), ("A", "00060", at, 2.0), ("A", "00065", at, 5.0)],
        "site_no string, code string, time timestamp_ntz, value double",
    )
    with pytest.raises(Exception, match="repeated time"):
        shape.align_variables(long, ["00060", "00065"]).collect()
    assert rows(shape.align_variables(long, ["00060", "00065"], duplicates="max")) == [("A", at, 2.0, 5.0)]
    with pytest.raises(ValueError):
        shape.align_variables(long, ["00060"], duplicates="first")


def test_daily_keeps_the_date(spark):
    body = payload(series("00060", point("5", "2020-02-29T00:00:00.000"), point("", "2020-03-01T00:00:00.000")))
    df = spark.createDataFrame([("A", "00003", json.dumps(body))], "site_no string, stat_cd string, payload string")
    got = rows(payloads.daily(payloads.parse_payloads(df)), "date")
    assert got == [("A", "00003", "00060", date(2020, 2, 29), 5.0), ("A", "00003", "00060", date(2020, 3, 1), None)]


def test_probe_with_and_without_series(spark):
    df = spark.createDataFrame(
        [("A", json.dumps(payload(FLOW, url="q1"))), ("B", json.dumps(payload(url="q2"))), ("C", json.dumps(payload(EMPTY)))],
        "site_no string, payload string",
    )
    got = rows(payloads.probe(payloads.parse_payloads(df)), "site_no")
    assert got[0] == ("A", "q1", "flow", "2025-01-01T00:00:00.000-06:00", "10.5")
    assert got[1] == ("B", "q2", None, None, None)
    assert got[2] == ("C", "u", "s", None, None)


def test_malformed_payload_fails(spark):
    df = spark.createDataFrame([("A", "{not json")], "site_no string, payload string")
    with pytest.raises(Exception):
        payloads.instantaneous(payloads.parse_payloads(df)).collect()


def test_decode_policies(spark):
    df = spark.createDataFrame([("1.5",), ("Ice",), ("NaN",)], "v string")
    assert [r[0] for r in df.select(decode_reading("v", "null")).collect()] == [1.5, None, None]
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        with pytest.raises(Exception, match="not a valid value: Ice"):
            df.select(decode_reading("v")).collect()
    spark.conf.unset("spark.sql.ansi.enabled")
    with pytest.raises(ValueError):
        decode_reading("v", "ignore")


def test_text_without_offset_is_utc(spark):
    from rillstone.functions.columns import utc_instant

    df = spark.createDataFrame([("2025-06-01T12:00:00",)], "t string")
    assert df.select(utc_instant("t")).first()[0] == datetime(2025, 6, 1, 12)
    assert df.select(utc_instant(F.concat("t", F.lit("+02:00")))).first()[0] == datetime(2025, 6, 1, 10)


def test_instants_do_not_depend_on_the_session(spark):
    from rillstone.functions.columns import utc_instant

    texts = {
        "2025-01-01T00:00:00Z": datetime(2025, 1, 1), "2025-01-01": datetime(2025, 1, 1), "2025-01-01 07:30": datetime(2025, 1, 1, 7, 30),
        "2025-11-02T01:30:00.250-06:00": datetime(2025, 11, 2, 7, 30, 0, 250000), "2025-11-02T01:30:00-07:00": datetime(2025, 11, 2, 8, 30),
        "1950-03-09T02:30:00": datetime(1950, 3, 9, 2, 30), "2025-03-09T02:30:00": datetime(2025, 3, 9, 2, 30),
    }
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    try:
        for zone in ("America/Denver", "Asia/Kolkata", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = {r[0]: r[1] for r in df.select("t", utc_instant("t")).collect()}
            assert got == {**texts, None: None}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
