"""Profiles of record tables: counts, summaries, distinct values, views of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from rillstone.functions.columns import epoch_micros, missing_label
from rillstone.functions.radix import column_quantiles
from rillstone.functions.runtime import cut_lineage

QUARTILES = (0.25, 0.5, 0.75)
DISTINCT_SHOWN = 10


def count_by(
    df: DataFrame, column: str, label_missing: bool = False, blank_is_missing: bool = False
) -> DataFrame:
    """Rows per value, most frequent first, the null group kept; equal counts in key order."""
    key = missing_label(column, blank_is_missing) if label_missing else F.col(column)
    counts = df.groupBy(key.alias(column)).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc_nulls_first(column))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _moments(df: DataFrame, columns: Sequence[str], q=None) -> DataFrame:
    """One pass over all columns, turned to one row per column."""
    cells = []
    for c in columns:
        x = F.col(f"`{c}`").cast("double")
        parts = [
            F.lit(c).alias("column"),
            F.count(x).alias("n"),
            F.count_if(x.isNull()).alias("nulls"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
        ]
        if q is not None:
            parts.append(q(x).alias("q"))
        cells.append(F.struct(*parts))
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def column_statistics(df: DataFrame, columns: Sequence[str] | None = None, method: str = "exact") -> DataFrame:
    """``column, n, nulls, mean, std, min, max, q25, q50, q75`` for numeric columns. Exact quartiles come from counts of
    digits (``radix``), so no task holds the values of a column."""
    columns = list(columns or numeric_columns(df))
    probs = F.array(*[F.lit(p) for p in QUARTILES])
    base = ["column", "n", "nulls", "mean", "std", "min", "max"]
    if method == "approx":
        names = [F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "q50", "q75"))]
        return _moments(df, columns, lambda x: F.percentile_approx(x, probs)).select(*base, *names)
    if method != "exact":
        raise ValueError("method is 'exact' or 'approx'")
    q = column_quantiles(df, columns, QUARTILES).toDF("column", "q25", "q50", "q75")
    return _moments(df, columns).join(F.broadcast(q), "column", "left")  # one row for each column


def numeric_summary(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "exact",
) -> DataFrame:
    """Long form ``(column, stat, value)``: count, mean, std, min, quartiles, max."""
    s = column_statistics(df, columns, method)
    wide = s.select(
        "column",
        F.col("n").cast("double").alias("count"),
        "mean",
        "std",
        "min",
        F.col("q25").alias("25%"),
        F.col("q50").alias("50%"),
        F.col("q75").alias("75%"),
        "max",
    )
    stats = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    return wide.unpivot(["column"], [F.col(f"`{x}`") for x in stats], "stat", "value")


def six_number_summary(df: DataFrame, columns: Sequence[str] = ("latitude", "longitude")) -> DataFrame:
    """Minimum, quartiles, mean, maximum and the number of nulls, one row per column."""
    s = column_statistics(df, columns)
    return s.select(
        "column",
        "min",
        F.col("q25").alias("first_quartile"),
        F.col("q50").alias("median"),
        "mean",
        F.col("q75").alias("third_quartile"),
        "max",
        F.col("nulls").alias("n_null"),
    )


def describe_all(df: DataFrame) -> DataFrame:
    """Mixed summary, one row per column: numbers have moments and quartiles, times have mean and
    quartiles as times, text and truth values have distinct count, most frequent value (smallest on a tie) and its
    frequency. Columns of other kinds are left out."""
    numbers = numeric_columns(df)
    times = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    ]
    kinds = {f.name: "text" if isinstance(f.dataType, T.StringType) else "boolean" for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))}
    texts = list(kinds)
    base = {
        "column": "string", "kind": "string", "count": "bigint", "unique": "bigint", "top": "string",
        "freq": "bigint", "mean": "double", "std": "double", "min": "double", "q25": "double",
        "q50": "double", "q75": "double", "max": "double", "mean_time": "timestamp_ntz",
        "min_time": "timestamp_ntz", "q25_time": "timestamp_ntz", "q50_time": "timestamp_ntz",
        "q75_time": "timestamp_ntz", "max_time": "timestamp_ntz",
    }

    def shaped(part: DataFrame, **given) -> DataFrame:
        return part.select(
            *[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in base.items()]
        )

    parts = []
    if numbers:
        s = column_statistics(df, numbers)
        given = {n: F.col(n) for n in ("column", "mean", "std", "min", "max", "q25", "q50", "q75")}
        parts.append(shaped(s, kind=F.lit("number"), count=F.col("n"), **given))
    if times:
        micros = df.select(*[epoch_micros(F.col(c).cast("timestamp_ntz")).alias(c) for c in times])
        s = column_statistics(micros, times)

        def as_time(c: str):
            whole = F.round(c).cast("long")
            start = F.lit("1970-01-01").cast("timestamp_ntz")
            return F.timestamp_add("MICROSECOND", whole, start)

        given = {
            f"{n}_time": as_time(n) for n in ("mean", "min", "q25", "q50", "q75", "max")
        }
        parts.append(shaped(s, column=F.col("column"), kind=F.lit("time"), count=F.col("n"), **given))
    if texts:
        per_value = (
            df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in texts])
            .unpivot([], [F.col(f"`{c}`") for c in texts], "column", "value")
            .filter(F.col("value").isNotNull())
            .groupBy("column", "value")
            .agg(F.count("*").alias("n"))
        )
        best = F.min(F.struct((-F.col("n")).alias("less"), F.col("value").alias("value")))
        s = per_value.groupBy("column").agg(
            F.sum("n").alias("count"), F.count("*").alias("unique"), best.alias("best")
        )
        parts.append(
            shaped(
                s,
                column=F.col("column"),
                kind=F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("column")),
                count=F.col("count"),
                unique=F.col("unique"),
                top=F.col("best.value"),
                freq=-F.col("best.less"),
            )
        )
    out = shaped(df.limit(0).select(F.lit(None).alias("_"))) if not parts else parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def time_extent(df: DataFrame, time_col: str = "time", series_keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*series_keys).agg(
        F.min(time_col).alias("first_time"), F.max(time_col).alias("last_time")
    )


def distinct_sorted(df: DataFrame, column: str, shown: int | None = DISTINCT_SHOWN) -> DataFrame:
    """Sorted distinct non-null values with their number; the first ``shown`` of them."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    number = values.select(F.count("*")).scalar()
    out = values.select(column, number.alias("n_distinct")).orderBy(column)
    return out.limit(shown) if shown else out


def dataset_overview(
    df: DataFrame, state: str = "state", dep_type: str = "dep_type", shown: int = DISTINCT_SHOWN
) -> DataFrame:
    """Report as ``(item, value)`` rows: number of rows and columns, number and every value of the
    state column, number and the first ``shown`` values of the deposit type. Values stay rows, so
    a column with very many of them is no burden for one task."""

    # the table is read once; what is asked of it is in the counts of pairs
    pairs = cut_lineage(df.groupBy(F.col(state).alias("_s"), F.col(dep_type).alias("_d")).agg(F.count("*").alias("_n")))

    def item(name: str, value) -> list:
        return [F.lit(name).alias("item"), value.cast("string").alias("value")]

    def values(c: str) -> DataFrame:
        return pairs.select(c).filter(F.col(c).isNotNull()).distinct()

    parts = [
        pairs.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).select(*item("rows", F.col("n"))),
        pairs.agg(F.lit(len(df.columns)).alias("n")).select(*item("columns", F.col("n"))),
        pairs.agg(F.count_distinct("_s").alias("n")).select(*item("states", F.col("n"))),
        pairs.agg(F.count_distinct("_d").alias("n")).select(*item("dep_types", F.col("n"))),
        values("_s").select(*item("state", F.col("_s"))),
        values("_d").orderBy("_d").limit(shown).select(*item("dep_type", F.col("_d"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sort_desc(df: DataFrame, column: str, *tie_break: str) -> DataFrame:
    return df.orderBy(F.desc(column), *tie_break)


def top_n(df: DataFrame, column: str, n: int = 10, *tie_break: str) -> DataFrame:
    """Spark keeps the best n of each task and merges those; nothing is fully sorted."""
    return sort_desc(df, column, *tie_break).limit(n)


def head_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Last n rows, in ascending order again."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def tail_n_per_series(df: DataFrame, n: int, series_keys: Sequence[str], *order: str) -> DataFrame:
    """Last n rows of each series. Spark limits the groups before the shuffle."""
    back = Window.partitionBy(*series_keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(back)).filter(F.col("_rn") <= n).drop("_rn")


def sample_n(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``min(n, rows)`` rows by the order of a hash of their key: the same rows however the data
    are partitioned."""
    ticket = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(ticket, key).limit(n)


