"""Daily features of a stream of readings, with late data and repeated readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rillstone.functions.columns import epoch_micros, null_nans, utc_wall
from rillstone.sources.files import is_folder


def reading_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """New Parquet files of a folder, or one file alone."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if is_folder(spark, path):
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def daily_stream(
    readings: DataFrame,
    variables: Sequence[str],
    series_keys: Sequence[str] = ("site_no",),
    time_col: str = "time",
    reading_key: Sequence[str] = (),
    delay: str = "1 day",
) -> DataFrame:
    """Mean, maximum and minimum per series and UTC day, for days the watermark has passed.
    Readings that come again within the delay count once when ``reading_key`` names them. State is
    one row per open series and day, and the keys seen within the delay."""
    # A watermark needs an instant; zone-less times are UTC.
    timed = null_nans(readings)
    if dict(timed.dtypes)[time_col] != "timestamp":
        timed = timed.withColumn(time_col, F.timestamp_micros(epoch_micros(time_col)))
    marked = timed.withWatermark(time_col, delay)
    if reading_key:
        marked = marked.dropDuplicatesWithinWatermark(list(reading_key))
    stats = {"mean": F.avg, "max": F.max, "min": F.min}
    days = marked.groupBy(*series_keys, F.window(time_col, "1 day")).agg(
        *[fn(v).alias(f"{v}_{s}") for v in variables for s, fn in stats.items()]
    )
    return days.select(
        *series_keys,
        utc_wall(F.col("window.start")).alias("date"),
        *[f"{v}_{s}" for v in variables for s in stats],
    )


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there, append it to a Parquet table exactly once, and read the table. The
    checkpoint lets a later call go on where this one ended."""
    running = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
