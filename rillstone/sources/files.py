"""Parquet and CSV datasets: pruned scans, per-file reports, read-through tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rillstone.functions.columns import strict_cast

# Cell texts read as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _path(spark: SparkSession, path: str):
    """Hadoop path and its file system, so globs and checks work on any store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def resolve_paths(spark: SparkSession, paths: Iterable[str]) -> tuple[list[str], list[str]]:
    """Arguments that exist, globs expanded and repeats dropped, and those that match nothing."""
    found: dict[str, None] = {}
    missing: dict[str, None] = {}
    for text in paths:
        p, fs = _path(spark, text)
        hits = fs.globStatus(p) or []
        for hit in hits:
            found[hit.getPath().toString()] = None
        if not len(hits):
            missing[text] = None
    return list(found), list(missing)


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.getFileStatus(p).isDirectory()


def split_columns(text: str) -> list[str]:
    """A comma list: trimmed, blanks ignored."""
    return [part.strip() for part in text.split(",") if part.strip()]


def read_parquet(
    spark: SparkSession,
    paths: Sequence[str],
    columns: Sequence[str] | None = None,
    with_file: bool = False,
) -> DataFrame:
    """One scan over all files. Unknown columns raise; Catalyst reads only those selected."""
    df = spark.read.parquet(*paths)
    wanted = [F.col(c) for c in (columns or df.columns)]
    if with_file:
        wanted += [
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("file_bytes"),
        ]
    return df.select(*wanted)


def dataset_info(df: DataFrame, file_col: str = "file", bytes_col: str = "file_bytes") -> DataFrame:
    """Bytes, rows and columns per file of a frame read ``with_file``."""
    n_columns = len([c for c in df.columns if c not in (file_col, bytes_col)])
    return df.groupBy(file_col).agg(
        F.max(bytes_col).alias("n_bytes"),
        F.count("*").alias("n_rows"),
        F.lit(n_columns).cast("long").alias("n_columns"),
    )


def per_file(df: DataFrame, *aggregates, file_col: str = "file") -> DataFrame:
    """Any report on many files in one job: group by the file instead of looping over files."""
    return df.groupBy(file_col).agg(*aggregates)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    columns: Sequence[str] | None = None,
    null_tokens: Sequence[str] = NULL_TOKENS,
    **options,
) -> DataFrame:
    """CSV with a header and a declared schema. Spark knows one null text, so cells are read as
    text, tokens become null, and then they are cast; a cell of the wrong type raises."""
    declared = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in declared])
    raw = spark.read.options(**options).schema(text).csv(
        path, header=True, enforceSchema=False, nullValue="", emptyValue=""
    )
    wanted = list(columns) if columns else declared.names
    unknown = [c for c in wanted if c not in declared.names]
    if unknown:
        raise ValueError(f"columns not in the file: {unknown}")

    def typed(f: T.StructField):
        # Text columns keep their spaces; numbers are compared without them.
        c = F.col(f"`{f.name}`")
        probe = c if isinstance(f.dataType, T.StringType) else F.trim(c)
        kept = F.when(~probe.isin(*null_tokens), probe) if null_tokens else probe
        typed_value = kept if isinstance(f.dataType, T.StringType) else strict_cast(kept, f.dataType)
        return typed_value.alias(f.name)

    return raw.select(*[typed(declared[c]) for c in wanted])


def window_tag(kind: str, amount: int) -> str:
    """``iv_7d`` for days of readings, ``dv_5y`` for years of daily values."""
    unit = {"iv": "d", "dv": "y"}[kind]
    return f"{kind}_{amount}{unit}"


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def materialize_if_absent(
    spark: SparkSession,
    root: str,
    tag: str,
    build: Callable[[], DataFrame],
    refresh: bool = False,
    partition_by: Sequence[str] = ("site_no",),
    wanted: Sequence[str] | None = None,
) -> DataFrame:
    """Read-through Parquet table under ``root/tag``, partitioned by site. A finished table is
    read back with the types it was written with; ``refresh`` rebuilds the partitions that ``build``
    returns. With ``wanted`` values of the first partition column, those that were not asked for yet and are not
    stored are built and added; a wanted value without rows is remembered too. A table is finished when its note beside
    the data is, which comes last: what a crash leaves behind is built again. One site may hold much of the data, so
    rows go to as many writers as they already have tasks."""
    path = f"{root.rstrip('/')}/{tag.replace('/', '-')}"
    first = partition_by[0]
    note = _read_note(spark, f"{path}/_note")
    asked = {str(v) for v in wanted or ()}
    missing: set[str] = set()
    if note and not refresh and asked - set(note["asked"]):
        stored = T.StructType.fromJson(note["schema"])
        there = spark.read.schema(stored).parquet(path).select(F.col(first).cast("string").alias("v")).filter(F.col("v").isin(sorted(asked)))
        missing = asked - set(note["asked"]) - {r["v"] for r in there.distinct().collect()}
    if note and not refresh and not missing:
        stored = T.StructType.fromJson(note["schema"])
        return spark.read.schema(stored).parquet(path).select(*stored.names)
    made = build()
    added = made.filter(F.col(first).cast("string").isin(sorted(missing))) if missing else made
    # A dynamic overwrite leaves the other partitions, so the first write is a plain one.
    (
        added.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if note else "static")
        .partitionBy(*partition_by)
        .parquet(path)
    )
    text = json.dumps({"schema": made.schema.jsonValue(), "asked": sorted(asked | set(note["asked"] if note else ()))})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_note")
    return spark.read.schema(made.schema).parquet(path).select(*made.columns)


def _read_note(spark: SparkSession, path: str) -> dict | None:
    """The schema and the values asked for of a finished table."""
    return json.loads(spark.read.text(path).first()[0]) if _exists(spark, f"{path}/_SUCCESS") else None
