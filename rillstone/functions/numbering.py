"""Dense numbers for the values of any column, in two levels: the rank inside a range, after the sizes of ranges before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rillstone.functions.runtime import cut_lineage


def dense_ids(df: DataFrame, *order: str | Column, name: str = "id") -> DataFrame:
    """``df`` with ``name``, 0, 1, 2, ... along ``order``, which should be unique. Rows are dealt to tasks by range and sorted
    there; only the sizes of the ranges, one for each task, are added up in one place."""
    order = order or tuple(df.columns)
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the row's place in its task
    ranged = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), inside.alias("_at"))
    )
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
