"""Row filters. Each is a plain predicate, so Parquet scans receive it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

DAYS_PER_YEAR = 365


def trailing_window(
    df: DataFrame,
    days: int = 7,
    years: int | None = None,
    time_col: str = "time",
    end: datetime | None = None,
) -> DataFrame:
    """The last ``days``, or ``years`` of 365 days, up to ``end``. Without an end it is the newest
    time of the frame, read as a one-value subquery."""
    span = years * DAYS_PER_YEAR if years is not None else days
    if span < 1:
        raise ValueError("the window must cover at least one day")
    newest: Column = F.lit(end).cast("timestamp_ntz") if end else df.select(F.max(time_col)).scalar()
    return df.filter(F.col(time_col) >= newest - F.make_dt_interval(F.lit(span)))


def parse_bound(text: str) -> datetime:
    """ISO text; raises when it is none. A zone is turned into UTC and dropped."""
    at = datetime.fromisoformat(text)
    if at.tzinfo is not None:
        at = (at - at.utcoffset()).replace(tzinfo=None)
    return at


def time_range(
    df: DataFrame, time_col: str = "time", start: str | None = None, end: str | None = None
) -> DataFrame:
    """Rows with ``start <= time <= end``; either bound may be left out."""
    if start:
        df = df.filter(F.col(time_col) >= F.lit(parse_bound(start)).cast("timestamp_ntz"))
    if end:
        df = df.filter(F.col(time_col) <= F.lit(parse_bound(end)).cast("timestamp_ntz"))
    return df


def where_expr(df: DataFrame, expression: str) -> DataFrame:
    """SQL text as a row filter, with SQL rules for nulls; blank text keeps every row."""
    return df.filter(F.expr(expression)) if expression.strip() else df


def non_null_only(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))
