"""Sensor payloads that were landed as JSON, one document per site and request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rillstone.functions.columns import decode_reading, utc_instant

# The nesting of a payload document.
_POINT = T.StructType([T.StructField("value", T.StringType()), T.StructField("dateTime", T.StringType())])
_CODE = T.StructType([T.StructField("value", T.StringType())])
_SERIES = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("variable", T.StructType([T.StructField("variableCode", T.ArrayType(_CODE))])),
        T.StructField(
            "values", T.ArrayType(T.StructType([T.StructField("value", T.ArrayType(_POINT))]))
        ),
    ]
)
PAYLOAD = T.StructType(
    [
        T.StructField(
            "value",
            T.StructType(
                [
                    T.StructField(
                        "queryInfo", T.StructType([T.StructField("queryURL", T.StringType())])
                    ),
                    T.StructField("timeSeries", T.ArrayType(_SERIES)),
                ]
            ),
        )
    ]
)

# Variable and statistic codes.
VARIABLE_NAMES = {"00060": "discharge_cfs", "00065": "stage_ft"}
STATISTICS = {"mean": "00003", "min": "00001", "max": "00002"}


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payload files under ``site_no=.../``; the site comes from the folder, not the document."""
    schema = T.StructType([*PAYLOAD.fields, T.StructField("site_no", T.StringType())])
    return spark.read.schema(schema).json(path, multiLine=True)


def parse_payloads(df: DataFrame, text: str = "payload") -> DataFrame:
    """Payload text in a column to the nested form; malformed text fails the job."""
    parsed = F.from_json(text, PAYLOAD, {"mode": "FAILFAST"})
    return df.withColumn("value", parsed.getField("value")).drop(text)


def _points(payloads: DataFrame, keep: Sequence[str]) -> DataFrame:
    # Only the first code and the first block of values count; explode drops series without points.
    one = payloads.select(*keep, F.explode("value.timeSeries").alias("s"))
    first_code = F.get("s.variable.variableCode", F.lit(0)).getField("value")
    first_block = F.get("s.values", F.lit(0)).getField("value")
    return one.select(*keep, first_code.alias("code"), F.explode(first_block).alias("p"))


def instantaneous(
    payloads: DataFrame,
    keep: Sequence[str] = ("site_no",),
    on_bad: str = "raise",
    no_data: Sequence[float] = (),
) -> DataFrame:
    """Long readings: kept columns, ``code``, ``time`` (UTC, zone-less) and ``value``."""
    return _points(payloads, keep).select(
        *keep,
        "code",
        utc_instant("p.dateTime").alias("time"),
        decode_reading("p.value", on_bad, no_data).alias("value"),
    )


def daily(
    payloads: DataFrame,
    keep: Sequence[str] = ("site_no", "stat_cd"),
    on_bad: str = "raise",
    no_data: Sequence[float] = (),
) -> DataFrame:
    """Long daily values; only the date part of the time is used."""
    return _points(payloads, keep).select(
        *keep,
        "code",
        F.to_date(F.substring("p.dateTime", 1, 10)).alias("date"),
        decode_reading("p.value", on_bad, no_data).alias("value"),
    )


def probe(payloads: DataFrame, keep: Sequence[str] = ("site_no",)) -> DataFrame:
    """One row per payload: request address, first series name, its first point."""
    first = F.get("value.timeSeries", F.lit(0))
    block = F.get(first.getField("values"), F.lit(0)).getField("value")
    point: Column = F.get(block, F.lit(0))
    return payloads.select(
        *keep,
        F.col("value.queryInfo.queryURL").alias("query_url"),
        first.getField("name").alias("first_name"),
        point.getField("dateTime").alias("first_time"),
        point.getField("value").alias("first_value"),
    )
