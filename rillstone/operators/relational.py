"""Joins, reshaping, missing shares, units, histograms, correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from rillstone.functions.quantiles import exact_quantiles
from rillstone.functions.statistics import join_statistics

JOINS = ("inner", "left", "right", "full")


def merge(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Relational join on shared key columns. Without a hint Spark broadcasts a side only when its
    measured size is small, and splits partitions of hot keys."""
    if how not in JOINS:
        raise ValueError(f"how is one of {JOINS}")
    return left.join(right, on, how)


def merge_all(frames: Sequence[DataFrame], on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Several tables on one key: after the first exchange the rest are co-located."""
    out = frames[0]
    for f in frames[1:]:
        out = merge(out, f, on, how)
    return out


def melt(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable", value: str = "value"
) -> DataFrame:
    return df.unpivot(list(ids), list(values), variable, value)


def pivot(
    df: DataFrame, ids: Sequence[str], variable: str, value: str, names: Sequence[str], agg: str = "sum"
) -> DataFrame:
    """Long to wide. The new columns are named by the caller, which saves a job."""
    return df.groupBy(*ids).pivot(variable, list(names)).agg({value: agg})


def missingness_profile(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Missing count and share per column, in each group when ``by`` is given."""
    wide = df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return wide.unpivot([*by, "n_rows"], list(columns), "column", "n_missing").withColumn(
        "share", F.try_divide("n_missing", "n_rows")
    )


def five_numbers(df: DataFrame, value: str, by: Sequence[str] = (), **options) -> DataFrame:
    """Boxplot numbers and Tukey fences per group."""
    q = exact_quantiles(df, by, value, [0.0, 0.25, 0.5, 0.75, 1.0], **options)
    named = q.toDF(*by, "low", "q1", "median", "q3", "high")
    spread = F.col("q3") - F.col("q1")
    return named.withColumns(
        {"lower_fence": F.col("q1") - 1.5 * spread, "upper_fence": F.col("q3") + 1.5 * spread}
    )


def iqr_outliers(df: DataFrame, value: str, by: Sequence[str], **options) -> DataFrame:
    """Rows outside the fences of their group."""
    fences = five_numbers(df, value, by, **options).select(*by, "lower_fence", "upper_fence")
    return join_statistics(df, fences, by).filter(
        (F.col(value) < F.col("lower_fence")) | (F.col(value) > F.col("upper_fence"))
    )


def convert_units(
    df: DataFrame, value: str, unit: str, factors: Mapping[str, float], into: str
) -> DataFrame:
    """Multiply by the factor of each row's unit; an unknown unit gives null. The factors are a
    caller's dictionary, so they become one map literal and no join is needed."""
    table = F.create_map(*[F.lit(x) for kv in factors.items() for x in kv])
    return df.withColumn(into, F.col(value) * F.try_element_at(table, F.col(unit)))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Fixed-width bins from minimum to maximum; the last bin includes the maximum. The range is
    a one-row subquery."""
    ends = df.agg(F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))).scalar()
    lo, hi = ends.getField("lo"), ends.getField("hi")
    place = F.floor(F.try_divide((F.col(value) - lo) * bins, hi - lo)).cast("int")
    binned = df.filter(F.col(value).isNotNull()).select(
        F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).alias("bin"), ends.alias("e")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return (
        binned.groupBy("bin")
        .agg(F.count("*").alias("n"), F.first("e.lo").alias("lo"), F.first("e.hi").alias("hi"))
        .select(
            "bin",
            (F.col("lo") + width * F.col("bin")).alias("bin_start"),
            (F.col("lo") + width * (F.col("bin") + 1)).alias("bin_end"),
            "n",
        )
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlations, all from one aggregate."""
    pairs = list(combinations(columns, 2))
    cells = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.corr(a, b).alias("r")) for a, b in pairs
    ]
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def scale_features(df: DataFrame, columns: Sequence[str], kind: str = "standard") -> DataFrame:
    """Standard or min-max scaling; the statistics are one row, read as a subquery."""
    if kind not in ("standard", "minmax"):
        raise ValueError("kind is 'standard' or 'minmax'")
    parts = []
    for c in columns:
        if kind == "standard":
            parts += [F.avg(c).alias(f"{c}_a"), F.stddev_samp(c).alias(f"{c}_b")]
        else:
            parts += [F.min(c).alias(f"{c}_a"), (F.max(c) - F.min(c)).alias(f"{c}_b")]
    stats = df.agg(F.struct(*parts)).scalar()
    return df.withColumns(
        {
            f"{c}_scaled": F.try_divide(F.col(c) - stats.getField(f"{c}_a"), stats.getField(f"{c}_b"))
            for c in columns
        }
    )
