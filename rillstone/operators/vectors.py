"""Distances, clusters, their quality, and projections of array-valued columns."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from rillstone.functions.runtime import cut_lineage

#: Clusters that one array of a comparison holds.
BLOCK = 512


def with_vector(df: DataFrame, array: str, into: str = "features") -> DataFrame:
    return df.withColumn(into, array_to_vector(F.col(array)))


def _total(a: Column, b: Column, fn) -> Column:
    return F.aggregate(F.zip_with(a, b, fn), F.lit(0.0), lambda s, v: s + v)


def distance(a: str | Column, b: str | Column, kind: str = "euclidean") -> Column:
    """Euclidean, Manhattan or cosine distance of two arrays, without leaving the JVM."""
    x = (F.col(a) if isinstance(a, str) else a).cast("array<double>")
    y = (F.col(b) if isinstance(b, str) else b).cast("array<double>")
    if kind == "euclidean":
        return F.sqrt(_total(x, y, lambda p, q: (p - q) * (p - q)))
    if kind == "manhattan":
        return _total(x, y, lambda p, q: F.abs(p - q))
    if kind == "cosine":
        dot = _total(x, y, lambda p, q: p * q)
        sizes = F.sqrt(_total(x, x, lambda p, q: p * q)) * F.sqrt(_total(y, y, lambda p, q: p * q))
        return 1 - F.try_divide(dot, sizes)
    raise ValueError("kind is 'euclidean', 'manhattan' or 'cosine'")


def pairwise_distance(
    pairs: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str, array: str
) -> DataFrame:
    """All three distances for listed pairs of keys. The caller says which pairs; nothing is
    crossed."""
    a = left.select(left_key, F.col(array).alias("_a"))
    b = right.select(right_key, F.col(array).alias("_b"))
    return pairs.join(a, left_key).join(b, right_key).select(
        *[F.col(c) for c in pairs.columns],
        *[distance("_a", "_b", k).alias(k) for k in ("euclidean", "manhattan", "cosine")],
    )


def centroids(df: DataFrame, array: str, label: str) -> DataFrame:
    """Mean vector and size per label, in one partially combined aggregate."""
    mean = Summarizer.mean(F.col("_v"))
    return with_vector(df, array, "_v").groupBy(label).agg(
        vector_to_array(mean).alias("centroid"), F.count("*").alias("n")
    )


def kmeans(df: DataFrame, array: str, k: int, seed: int = 0, iterations: int = 20) -> tuple[DataFrame, float]:
    """Rows with their cluster, and the inertia."""
    model = KMeans(k=k, seed=seed, maxIter=iterations, predictionCol="cluster").fit(with_vector(df, array))
    return model.transform(with_vector(df, array)).drop("features"), model.summary.trainingCost


def bisecting_kmeans(df: DataFrame, array: str, k: int, seed: int = 0) -> tuple[DataFrame, float]:
    model = BisectingKMeans(k=k, seed=seed, predictionCol="cluster").fit(with_vector(df, array))
    return model.transform(with_vector(df, array)).drop("features"), model.summary.trainingCost


def silhouette(df: DataFrame, array: str, cluster: str) -> float:
    """Mean silhouette on squared Euclidean distance, which needs only sums per cluster."""
    found = ClusteringEvaluator(featuresCol="features", predictionCol=cluster, metricName="silhouette")
    return found.evaluate(with_vector(df, array).withColumn(cluster, F.col(cluster).cast("double")))


def davies_bouldin(df: DataFrame, array: str, cluster: str) -> DataFrame:
    """One row: the index and the number of clusters. Spread and centre per cluster are aggregates; each cluster is
    then compared with the others a block at a time, and its largest ratio counts."""
    middle = centroids(df, array, cluster).drop("n")
    far = df.select(cluster, array).join(middle, cluster)
    spread = cut_lineage(far.groupBy(cluster).agg(
        F.avg(distance(array, "centroid")).alias("s"), F.first("centroid").alias("c")
    ))
    parts = max(1, -(-spread.count() // BLOCK))
    blocks = spread.groupBy(F.pmod(F.xxhash64(cluster), F.lit(parts)).alias("_b")).agg(
        F.collect_list(F.struct(F.col(cluster).alias("k"), "s", "c")).alias("_all")
    )
    each = spread.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))).join(blocks, "_b")
    others = F.filter("_all", lambda o: o["k"] != F.col(cluster))
    ratios = F.transform(others, lambda o: F.try_divide(F.col("s") + o["s"], distance(F.col("c"), o["c"])))
    worst = each.select(cluster, F.array_max(ratios).alias("_r")).groupBy(cluster).agg(F.max("_r").alias("_r"))
    return worst.agg(F.avg("_r").alias("davies_bouldin"), F.count("*").alias("n_clusters"))


def fit_pca(df: DataFrame, array: str, k: int):
    """The model; only the covariance matrix (dimensions squared) reaches the driver."""
    return PCA(k=k, inputCol="features", outputCol="projected").fit(with_vector(df, array))


def explained_variance(model) -> list[tuple[int, float]]:
    return [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance)]


def project(df: DataFrame, array: str, model, into: str = "projected") -> DataFrame:
    return model.transform(with_vector(df, array)).drop("features").withColumn(
        into, vector_to_array("projected")
    )


def whiten(projected: DataFrame, column: str = "projected", k: int = 2) -> DataFrame:
    """Components centred and scaled to unit variance."""
    stats = []
    for i in range(k):
        stats += [F.avg(F.get(column, F.lit(i))).alias(f"m{i}"), F.stddev_samp(F.get(column, F.lit(i))).alias(f"s{i}")]
    row = projected.agg(F.struct(*stats)).scalar()
    cells = [
        F.try_divide(F.get(column, F.lit(i)) - row.getField(f"m{i}"), row.getField(f"s{i}")) for i in range(k)
    ]
    return projected.withColumn("whitened", F.array(*cells))


def reconstruct(projected: DataFrame, model, column: str = "projected", into: str = "rebuilt") -> DataFrame:
    """Back to the original axes: the components times the loadings, which are model constants."""
    loadings = np.asarray(model.pc.toArray())
    weights = [F.array(*[F.lit(float(v)) for v in row]) for row in loadings]
    cells = [_total(F.col(column), w, lambda p, q: p * q) for w in weights]
    return projected.withColumn(into, F.array(*cells))
