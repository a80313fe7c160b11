"""Projection, reshape and typing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rillstone.functions.columns import day_of, missing_label, wall_clock
from rillstone.sources.files import split_columns
from rillstone.sources.payloads import VARIABLE_NAMES


def align_variables(
    readings: DataFrame,
    variables: Sequence[str] | None = None,
    series_keys: Sequence[str] = ("site_no",),
    time_col: str = "time",
    code_col: str = "code",
    value_col: str = "value",
    duplicates: str = "error",
) -> DataFrame:
    """Variables side by side on time (a full outer alignment), in one shuffle. Without ``variables``
    every code found becomes a column, in order; one job looks them up. Naming them saves that job and selects them."""
    if duplicates not in ("error", "max"):
        raise ValueError("duplicates is 'error' or 'max'")
    if variables is None:
        codes = readings.select(code_col).dropna().distinct().orderBy(code_col)
        variables = [row[0] for row in codes.collect()]  # one per column of the result
    known = readings.filter(F.col(code_col).isin(list(variables)))
    grouped = known.groupBy(*series_keys, time_col)
    return grouped.agg(
        *[_only(value_col, code_col, time_col, v, duplicates).alias(v) for v in variables]
    )


def _only(value_col: str, code_col: str, time_col: str, variable: str, duplicates: str) -> Column:
    mine = F.col(code_col) == variable
    value = F.max(F.when(mine, F.col(value_col)))
    if duplicates == "max":
        return value
    message = F.concat(F.lit(f"repeated time for {variable}: "), F.col(time_col).cast("string"))
    return F.when(F.count_if(mine) > 1, F.raise_error(message)).otherwise(value)


def rename_codes(df: DataFrame, names: Mapping[str, str] = VARIABLE_NAMES) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def select_columns(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    wanted = split_columns(columns) if isinstance(columns, str) else list(columns)
    return df.select(*wanted) if wanted else df


def to_local(df: DataFrame, time_col: str = "time", zone: str = "America/Denver", into: str | None = None) -> DataFrame:
    """Wall clock of a zone, zone-less."""
    return df.withColumn(into or time_col, wall_clock(time_col, zone))


# The accepted date-time texts, tried in this order.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")


def lenient_time(c: str | Column, formats: Sequence[str] = TIME_FORMATS) -> Column:
    """The first format that fits the whole text, else null."""
    text = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def coerce_time_column(df: DataFrame, name: str, formats: Sequence[str] = TIME_FORMATS) -> DataFrame:
    if name not in df.columns or isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return df
    return df.withColumn(name, lenient_time(F.col(name).cast("string"), formats))


def coerce_datetimes(df: DataFrame, formats: Sequence[str] = TIME_FORMATS, share: float = 0.8) -> DataFrame:
    """Text columns that are mostly date-times become timestamps; zoned timestamps lose the zone.
    One aggregate over all text columns decides, one row comes back."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    chosen: set[str] = set()
    if texts:
        row = df.agg(
            F.count("*").alias("n"),
            *[F.count(lenient_time(c, formats)).alias(f"p{i}") for i, c in enumerate(texts)],
        ).first()
        if row["n"]:
            need = max(1, int(share * row["n"]))
            chosen = {c for i, c in enumerate(texts) if row[f"p{i}"] >= need}
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.name in chosen:
            out.append(lenient_time(c, formats).alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            out.append(c.cast("timestamp_ntz").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def chart_frame(
    wide: DataFrame,
    fields: Sequence[str] = ("discharge_cfs", "stage_ft"),
    series_keys: Sequence[str] = ("site_no",),
    time_col: str = "time",
    bucket: str = "day",
) -> DataFrame:
    """Chart input of bounded size: long form, one point per series, field and time bucket."""
    present = [f for f in fields if f in wide.columns]
    t = day_of(time_col) if bucket == "day" else F.date_trunc(bucket, time_col).cast("timestamp_ntz")
    long = wide.select(*series_keys, t.alias("t"), *present).unpivot(
        [*series_keys, "t"], present, "field", "value"
    )
    return long.groupBy(*series_keys, "t", "field").agg(
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.avg("value").alias("mean"),
        F.count("value").alias("n"),
    )


def label_missing(df: DataFrame, column: str, blank_is_missing: bool = False) -> DataFrame:
    return df.withColumn(column, missing_label(column, blank_is_missing))
