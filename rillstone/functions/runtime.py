"""Session settings, reliable checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that a Python task is given at once.
BATCH_BYTES = 4 << 20
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def use_utc(spark: SparkSession) -> SparkSession:
    """Read and print instants in UTC. Zone-less columns are UTC wall clock throughout."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """Hand rows to Python a few megabytes at a time. The usual bound is on rows, and rows may be long texts. A smaller
    bound that is set already stays."""
    now = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_CONF)))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: the cluster's own setting, or a temporary one
    when Spark runs in a single local process, with its own threads, and nothing is set."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="rillstone-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table written between two steps of a job."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: survives lost executors, and is computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``written``, and what was shuffled for it leaves the disk at once, not when the driver next collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP_CONF, None)
    conf.set(CLEANUP_CONF, "true")
    try:
        return written(df, name)
    finally:
        if before is None:
            conf.unset(CLEANUP_CONF)
        else:
            conf.set(CLEANUP_CONF, before)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows to all cores when a scan gives fewer tasks than there are cores, for work that is
    heavy per row. A table of many files is left as it is, so nothing large is moved. For scans
    and what is computed from them without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
