"""Column expressions: missing values, readings, clocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

MISSING = "<missing>"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """One notion of missing. Spark counts NaN as a value, so it must not get past a source."""
    return F.when(~F.isnan(col(c)), col(c))


def null_nans(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({n: nan_to_null(n) for n in floats}) if floats else df


def strict_cast(text: Column, kind: str | T.DataType) -> Column:
    """Text to a type; text that does not fit fails the job whatever the session's ANSI setting."""
    value = text.try_cast(kind)
    message = F.concat(F.lit("not a valid value: "), text)
    return F.when(text.isNotNull() & value.isNull(), F.raise_error(message)).otherwise(value)


def decode_reading(
    c: str | Column, on_bad: str = "raise", no_data: Sequence[float] = ()
) -> Column:
    """Text of a reading to DOUBLE. Empty is missing; sentinels stay numbers unless listed."""
    if on_bad not in ("raise", "null"):
        raise ValueError("on_bad is 'raise' or 'null'")
    text = F.nullif(col(c), F.lit(""))
    number = strict_cast(text, "double") if on_bad == "raise" else text.try_cast("double")
    number = nan_to_null(number)
    return F.when(~number.isin(*no_data), number) if no_data else number


#: ISO text of a date, or of a date and a time, that names no zone.
_ZONELESS = r"^\s*[+-]?\d{4,7}(-\d{1,2}(-\d{1,2}([T ]\s*\d{1,2}(:\d{1,2}(:\d{1,2}(\.\d*)?)?)?)?)?)?\s*$"


def utc_wall(instant: Column) -> Column:
    """An instant as UTC wall clock, whatever the session's zone."""
    whole = F.make_dt_interval(secs=(F.unix_micros(instant).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))
    return F.lit("1970-01-01").cast("timestamp_ntz") + whole


def utc_instant(c: str | Column) -> Column:
    """ISO text to UTC wall clock; an offset is honoured, its absence means UTC. The session's zone has no part in
    it."""
    bare = F.when(col(c).rlike(_ZONELESS), col(c))
    return F.when(bare.isNotNull(), bare.cast("timestamp_ntz")).otherwise(utc_wall(F.to_timestamp(col(c))))


def wall_clock(c: str | Column, zone: str) -> Column:
    """UTC wall clock to the wall clock of a zone. Not a key: one hour repeats each autumn."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(c))


def day_of(c: str | Column) -> Column:
    """Midnight of the day, without a zone."""
    return F.date_trunc("day", col(c)).cast("timestamp_ntz")


def micros_between(earlier: str | Column, later: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", col(earlier), col(later))


def epoch_micros(c: str | Column) -> Column:
    return micros_between(F.lit("1970-01-01").cast("timestamp_ntz"), c)


def missing_label(c: str | Column, blank_is_missing: bool = False) -> Column:
    value = F.nullif(col(c), F.lit("")) if blank_is_missing else col(c)
    return F.coalesce(value, F.lit(MISSING))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every DOUBLE for reporting; adding zero turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which a null key matches a null key, so null groups are not lost."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(named, condition, how).drop(*[f"_right_{k}" for k in keys])
