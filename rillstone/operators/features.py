"""Daily features on a gap-free calendar, rolling statistics and anomaly scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rillstone.functions.columns import day_of

# Default variables, rolling width, readings needed for a score.
FEATURE_VARIABLES = ("discharge_cfs", "stage_ft")
WINDOW = 30
MIN_PERIODS = 7


def day_spine(daily: DataFrame, series_keys: Sequence[str], day_col: str, values: Sequence[str]) -> DataFrame:
    """Every day between the first and last of a series; days without a row are null. Each row
    stretches up to the next one, so no calendar is joined and the data are read once."""
    after = F.lead(day_col).over(Window.partitionBy(*series_keys).orderBy(day_col))
    one_day = F.make_dt_interval(F.lit(1))
    last = F.coalesce(F.col("_after") - one_day, F.col(day_col))
    stretched = daily.withColumn("_after", after).select(
        *series_keys,
        F.col(day_col).alias("_own"),
        F.explode(F.sequence(F.col(day_col), last, one_day)).alias(day_col),
        *values,
    )
    own = F.col("_own") == F.col(day_col)
    return stretched.select(*series_keys, day_col, *[F.when(own, F.col(v)).alias(v) for v in values])


def daily_features(
    df: DataFrame,
    series_keys: Sequence[str] = ("site_no",),
    time_col: str = "time",
    variables: Sequence[str] = FEATURE_VARIABLES,
) -> DataFrame:
    """Mean, maximum and minimum of each present variable for each UTC day. Readings are combined
    before the shuffle, so a series that holds most rows costs no more than its days."""
    present = [v for v in variables if v in df.columns]
    if not present:
        raise ValueError(f"none of {list(variables)} is a column")
    stats = {"mean": F.avg, "max": F.max, "min": F.min}
    names = [f"{v}_{s}" for v in present for s in stats]
    days = df.groupBy(*series_keys, day_of(time_col).alias("date")).agg(
        *[fn(v).alias(f"{v}_{s}") for v in present for s, fn in stats.items()]
    )
    return day_spine(days, series_keys, "date", names)


def _frame(series_keys: Sequence[str], order: str, window: int):
    if window < MIN_PERIODS:
        raise ValueError(f"the window must hold at least {MIN_PERIODS} rows")
    return Window.partitionBy(*series_keys).orderBy(order).rowsBetween(-(window - 1), 0)


def float_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    kinds = (T.FloatType, T.DoubleType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in exclude]


def _rolling(c: str, frame) -> tuple[Column, Column]:
    enough = F.count(c).over(frame) >= MIN_PERIODS
    return (
        F.when(enough, F.avg(c).over(frame)),
        F.when(enough, F.stddev_samp(c).over(frame)),
    )


def rolling_mean_std(
    daily: DataFrame,
    columns: Sequence[str] | None = None,
    series_keys: Sequence[str] = ("site_no",),
    order: str = "date",
    window: int = WINDOW,
) -> DataFrame:
    """Trailing mean and sample deviation over rows. For daily frames: a series has one row a day,
    so a window partition is bounded by the calendar, not by the readings."""
    frame = _frame(series_keys, order, window)
    out = {}
    for c in columns or float_columns(daily, series_keys):
        out[f"{c}_roll_mean"], out[f"{c}_roll_std"] = _rolling(c, frame)
    return daily.withColumns(out)


def rolling_anomaly_z(
    daily: DataFrame,
    series_keys: Sequence[str] = ("site_no",),
    order: str = "date",
    window: int = WINDOW,
) -> DataFrame:
    """``{column}_z`` for each float column after the originals; a constant window gives null."""
    frame = _frame(series_keys, order, window)
    out = {}
    for c in float_columns(daily, series_keys):
        mean, std = _rolling(c, frame)
        out[f"{c}_z"] = F.try_divide(F.col(c) - mean, std)
    return daily.withColumns(out)
