"""Privacy checks and noised counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

HASH_RANGE = float(1 << 52)


def k_anonymity(df: DataFrame, quasi: Sequence[str], k: int = 5) -> DataFrame:
    """Smallest class, number of classes, and the rows in classes below k. Classes are counted
    before the shuffle, so a class that holds most rows costs nothing extra."""
    classes = df.groupBy(*quasi).agg(F.count("*").alias("n"))
    return classes.agg(
        F.min("n").alias("k"),
        F.count("*").alias("n_classes"),
        F.count_if(F.col("n") < k).alias("n_small_classes"),
        F.coalesce(F.sum(F.when(F.col("n") < k, F.col("n"))), F.lit(0)).alias("n_exposed_rows"),
    )


def l_diversity(df: DataFrame, quasi: Sequence[str], sensitive: str) -> DataFrame:
    """Classes with their size and number of distinct sensitive values. Distinct pairs are made
    first, so a large class is spread over its sensitive values."""
    pairs = df.groupBy(*quasi, sensitive).agg(F.count("*").alias("_n"))
    return pairs.groupBy(*quasi).agg(F.sum("_n").alias("n"), F.count(sensitive).alias("l"))


def dp_count(df: DataFrame, by: Sequence[str], epsilon: float = 1.0, *, seed: str) -> DataFrame:
    """Counts with Laplace noise of scale 1/epsilon. The noise comes from a seeded uniform of the
    group key, so a repeated release gives no new draw. The seed must be secret, or the noise can be taken off
    again, and a new one for each release of changed data, or two releases differ by the exact change."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in by], F.lit(seed))
    whole = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    u = (whole + 0.5) / HASH_RANGE - 0.5
    noise = -F.signum(u) * F.log(1 - 2 * F.abs(u)) / epsilon
    return counts.select(*by, (F.col("n") + noise).alias("noisy_count"))
