"""Order-dependent work on series that may be too long for one task.

A window partitioned by series puts a whole series into one task. When a series is longer than
``rows_per_chunk`` the series is cut at time boundaries shared by all series, windows run inside
a chunk, and what crosses a boundary comes from a one-row-per-chunk summary.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from rillstone.functions.columns import join_null_safe

ROWS_PER_CHUNK = 2_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the largest group: one pass over the key columns, one number to the driver."""
    counts = df.groupBy(*keys).count() if keys else df.select(F.count("*").alias("count"))
    return counts.agg(F.max("count")).first()[0] or 0


def cut_points(df: DataFrame, number: Column, parts: int) -> list[float]:
    """At most ``parts - 1`` inner boundaries that split ``number`` into similar row counts.
    A plain percentile sketch, so memory does not grow with the rows."""
    parts = max(2, parts)
    found = df.select(
        F.percentile_approx(
            number.cast("double"), [i / parts for i in range(1, parts)], max(10_000, 10 * parts)
        )
    ).first()[0]
    return sorted(set(found or []))


def add_bucket(df: DataFrame, number: Column, inner: Sequence[float], name: str) -> DataFrame:
    """Bucket index by binary search over fixed boundaries. A pure function of the value, so a
    recomputed task places every row as before."""
    if not inner:
        return df.withColumn(name, F.lit(0))
    raw = f"{name}_raw"
    cut = Bucketizer(
        splits=[float("-inf"), *inner, float("inf")],
        inputCol=f"{name}_in",
        outputCol=raw,
        handleInvalid="keep",
    )
    return (
        cut.transform(df.withColumn(f"{name}_in", number.cast("double")))
        .withColumn(name, F.col(raw).cast("int"))
        .drop(raw, f"{name}_in")
    )


def previous_in_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    number: Column,
    prefix: str = "prev_",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """``lag`` of ``values`` along ``order`` within ``keys``. ``number`` is a numeric form of the
    first order column; rows with the same ``number`` must stay in one chunk."""
    hot = largest_group(df, keys)
    if hot <= rows_per_chunk:
        along = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({prefix + v: F.lag(v).over(along) for v in values})

    total = df.count()
    cut = add_bucket(df, number, cut_points(df, number, ceil(total / rows_per_chunk)), "_chunk")
    along = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    inside = cut.withColumn("_before", F.lag(F.struct(*values)).over(along))
    last = cut.groupBy(*keys, "_chunk").agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    )
    # One row per series and chunk: bounded by the number of chunks for each series.
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    carry = last.select(*keys, "_chunk", F.lag("_last").over(chunks).alias("_carry"))
    joined = join_null_safe(inside, carry, [*keys, "_chunk"], "left")
    before = F.coalesce("_before", "_carry")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[before.getField(v).alias(prefix + v) for v in values],
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    amounts: Sequence[str],
    descending: bool = False,
    prefix: str = "cum_",
    rows_per_chunk: int = ROWS_PER_CHUNK,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Exact inclusive running sums of ``amounts`` along a numeric ``order`` column that is unique
    in its group, or is with ``ties``. Two levels: totals per value range, then a window inside each range."""
    sign = -1 if descending else 1
    direction = F.desc(order) if descending else F.asc(order)
    hot = largest_group(df, keys)
    if hot <= rows_per_chunk and keys:
        along = (
            Window.partitionBy(*keys)
            .orderBy(direction, *ties)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return df.withColumns({prefix + a: F.sum(a).over(along) for a in amounts})

    number = F.col(order) * sign
    parts = max(2, ceil(df.count() / rows_per_chunk))
    cut = add_bucket(df, number, cut_points(df, number, parts), "_range")
    along = (
        Window.partitionBy(*keys, "_range")
        .orderBy(direction, *ties)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = cut.withColumns({f"_in_{a}": F.sum(a).over(along) for a in amounts})
    totals = cut.groupBy(*keys, "_range").agg(*[F.sum(a).alias(f"_tot_{a}") for a in amounts])
    # Range totals: one row for each range and group. Without keys this is the only window
    # in one task, over that bounded table.
    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys, "_range", *[F.sum(f"_tot_{a}").over(earlier).alias(f"_off_{a}") for a in amounts]
    )
    joined = join_null_safe(inside, offsets, [*keys, "_range"], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[
            (F.col(f"_in_{a}") + F.coalesce(F.col(f"_off_{a}"), F.lit(0))).alias(prefix + a)
            for a in amounts
        ],
    )
