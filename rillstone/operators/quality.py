"""Sampling quality: steps between readings and gap summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rillstone.functions.columns import epoch_micros, join_null_safe, micros_between, wall_clock
from rillstone.functions.ordered import ROWS_PER_CHUNK, largest_group, previous_in_series
from rillstone.functions.quantiles import SMALL_GROUP, exact_quantiles

# Fixed value: the nominal cadence in seconds.
CADENCE_SEC = 900
MICROS = 1_000_000


def step_delta(
    df: DataFrame,
    series_keys: Sequence[str] = ("site_no",),
    time_col: str = "time",
    clock: str | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Seconds since the reading before, one row per reading but the first of each series.
    Rows are ordered by ``time_col``; the step is measured on ``clock`` when that is given."""
    clock = clock or time_col
    slim = df.select(*dict.fromkeys([*series_keys, time_col, clock]))
    steps = previous_in_series(
        slim, series_keys, [time_col], [clock], epoch_micros(time_col), rows_per_chunk=rows_per_chunk
    )
    micros = micros_between(f"prev_{clock}", clock)
    return steps.filter(F.col(f"prev_{clock}").isNotNull()).select(
        *dict.fromkeys([*series_keys, time_col, clock]),
        micros.alias("step_us"),
        (micros / MICROS).alias("step_sec"),
    )


def gap_summary(
    df: DataFrame,
    series_keys: Sequence[str] = ("site_no",),
    time_col: str = "time",
    clock: str | None = None,
    cadence_sec: float = CADENCE_SEC,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Count, first and last time, median and longest step, and the share of readings missing
    against an ideal cadence. A perfect run of n readings scores ``-1/(n-1)``; that is intended."""
    clock = clock or time_col
    slim = df.select(*dict.fromkeys([*series_keys, time_col, clock]))
    hot = largest_group(slim, series_keys)
    if hot <= min(rows_per_chunk, small_group):
        # Window and aggregate share the one exchange on the series keys.
        prev = previous_in_series(
            slim, series_keys, [time_col], [clock], epoch_micros(time_col),
            rows_per_chunk=rows_per_chunk,
        )
        step = micros_between(f"prev_{clock}", clock)
        base = prev.groupBy(*series_keys).agg(
            F.count("*").alias("n"),
            F.min(clock).alias("start"),
            F.max(clock).alias("end"),
            F.percentile(step, 0.5).alias("median_us"),
            F.max(step).alias("max_us"),
        )
    else:
        steps = step_delta(slim, series_keys, time_col, clock, rows_per_chunk)
        ends = slim.groupBy(*series_keys).agg(
            F.count("*").alias("n"), F.min(clock).alias("start"), F.max(clock).alias("end")
        )
        longest = steps.groupBy(*series_keys).agg(F.max("step_us").alias("max_us"))
        middle = exact_quantiles(steps, series_keys, "step_us", [0.5], small_group).withColumnRenamed(
            "q0", "median_us"
        )
        base = join_null_safe(ends, longest, series_keys, "left")
        base = join_null_safe(base, middle, series_keys, "left")
    ideal = micros_between("start", "end") / MICROS / F.lit(float(cadence_sec))
    return base.select(
        *series_keys,
        F.col("n").cast("double").alias("count"),
        "start",
        "end",
        (F.col("median_us") / MICROS).alias("median_step_sec"),
        (F.col("max_us") / MICROS).alias("max_gap_sec"),
        F.when(ideal > 0, 1 - F.col("n") / ideal).alias("pct_missing_vs_15min"),
    )


def gap_summary_local(
    df: DataFrame,
    series_keys: Sequence[str] = ("site_no",),
    time_col: str = "time",
    zone: str = "America/Denver",
    **options,
) -> DataFrame:
    """Gaps on local wall clock, so clock changes show; order is still UTC."""
    local = df.withColumn("_local", wall_clock(time_col, zone))
    return gap_summary(local, series_keys, time_col, clock="_local", **options)
