"""Supervised models of Spark ML, and ways to look into them."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import Interaction, PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window, functions as F

from rillstone.functions.statistics import join_statistics


def assemble(df: DataFrame, columns: Sequence[str], into: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=into).transform(df)


def simple_ols(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """One-variable least squares per group, in one aggregate."""
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
    )


def linear_model(df: DataFrame, label: str, kind: str = "ols", strength: float = 0.1, features: str = "features"):
    """OLS, ridge or lasso on an assembled frame."""
    mix = {"ols": (0.0, 0.0), "ridge": (strength, 0.0), "lasso": (strength, 1.0)}
    reg, elastic = mix[kind]
    return LinearRegression(
        featuresCol=features, labelCol=label, regParam=reg, elasticNetParam=elastic, maxIter=50
    ).fit(df)


def coefficient_table(df: DataFrame, columns: Sequence[str], model, kind: str) -> DataFrame:
    rows = [(kind, c, float(w)) for c, w in zip(columns, model.coefficients)]
    rows.append((kind, "(intercept)", float(model.intercept)))
    return df.sparkSession.createDataFrame(rows, "model string, term string, weight double")


def polynomial(df: DataFrame, degree: int = 2, features: str = "features", into: str = "poly") -> DataFrame:
    return PolynomialExpansion(degree=degree, inputCol=features, outputCol=into).transform(df)


def interaction(df: DataFrame, columns: Sequence[str], into: str = "crossed") -> DataFrame:
    return Interaction(inputCols=list(columns), outputCol=into).transform(df)


def balance_weights(df: DataFrame, label: str, into: str = "weight") -> DataFrame:
    """Weight of a row so that all classes weigh the same."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = df.select(F.count("*")).scalar()
    classes = sizes.select(F.count("*")).scalar()
    joined = join_statistics(df.filter(F.col(label).isNotNull()), sizes, [label])
    return joined.withColumn(into, total / (classes * F.col("_n"))).drop("_n")


def resample(df: DataFrame, label: str, key: str, share: dict, seed: int = 0) -> DataFrame:
    """Rows of each class repeated ``share`` times on average: a whole part, and one more row by
    a hash of the key. Under- and over-sampling that gives the same rows in every run."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    table = F.create_map(*[F.lit(v) for kv in share.items() for v in kv])
    rate = F.coalesce(F.try_element_at(table, F.col(label)), F.lit(1.0))
    times = F.floor(rate).cast("int") + (u < rate - F.floor(rate)).cast("int")
    return df.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))).drop("_copy")


def logistic(df: DataFrame, label: str, weight: str | None = None, reg: float = 0.01, features: str = "features"):
    model = LogisticRegression(featuresCol=features, labelCol=label, regParam=reg, maxIter=50)
    return (model.setWeightCol(weight) if weight else model).fit(df)


def linear_svm(df: DataFrame, label: str, reg: float = 0.01):
    return LinearSVC(labelCol=label, regParam=reg, maxIter=50).fit(df)


def perceptron(df: DataFrame, label: str, layers: Sequence[int], seed: int = 0, iterations: int = 60):
    """Inputs are standardised; layers run from the number of inputs to the number of classes."""
    scale = StandardScaler(inputCol="features", outputCol="_scaled", withMean=True)
    net = MultilayerPerceptronClassifier(
        featuresCol="_scaled", labelCol=label, layers=list(layers), seed=seed, maxIter=iterations
    )
    return Pipeline(stages=[scale, net]).fit(df)


def tree_model(df: DataFrame, label: str, kind: str = "tree", seed: int = 0, depth: int = 5, trees: int = 20):
    if kind == "tree":
        return DecisionTreeClassifier(labelCol=label, maxDepth=depth, seed=seed).fit(df)
    if kind == "forest":
        return RandomForestClassifier(labelCol=label, maxDepth=depth, numTrees=trees, seed=seed).fit(df)
    if kind == "boosting":
        return GBTClassifier(labelCol=label, maxDepth=depth, maxIter=trees, seed=seed).fit(df)
    raise ValueError("kind is 'tree', 'forest' or 'boosting'")


def importance_table(df: DataFrame, columns: Sequence[str], model) -> DataFrame:
    rows = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def shuffled_column(df: DataFrame, key: str, column: str, seed: int = 0, block: int = 10_000) -> DataFrame:
    """``column`` permuted among rows. Rows are dealt by a hash to blocks of bounded size, and
    within a block one hash order is matched with another, so nothing is ordered globally."""
    blocks = max(1, ceil(df.count() / block))
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(blocks)))

    def place(salt: int):
        return F.row_number().over(
            Window.partitionBy("_block").orderBy(F.xxhash64(F.col(key), F.lit(seed + salt)), key)
        )

    mine = dealt.withColumn("_place", place(1))
    theirs = dealt.select("_block", place(2).alias("_place"), F.col(column).alias("_new"))
    return mine.join(theirs, ["_block", "_place"]).drop("_block", "_place", column).withColumnRenamed(
        "_new", column
    )


def permutation_importance(
    df: DataFrame, model, columns: Sequence[str], label: str, key: str, seed: int = 0
) -> DataFrame:
    """Accuracy lost when a column is permuted, one row per column."""

    def accuracy(rows: DataFrame) -> DataFrame:
        scored = model.transform(assemble(rows, columns))
        return scored.agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("a"))

    slim = df.select(key, label, *columns)
    base = accuracy(slim).scalar()
    out = None
    for i, c in enumerate(columns):
        row = accuracy(shuffled_column(slim, key, c, seed + 10 * i)).select(
            F.lit(c).alias("feature"), base.alias("accuracy"), (base - F.col("a")).alias("loss")
        )
        out = row if out is None else out.unionByName(row)
    return out


def ice(
    df: DataFrame, model, columns: Sequence[str], feature: str, grid: Sequence[float], key: str, output: str = "prediction"
) -> DataFrame:
    """Prediction of every row at every grid value of one feature; the grid is a short list and
    each row is repeated along it in place."""
    points = F.array(*[F.lit(float(g)) for g in grid])
    spread = df.select(key, *columns).withColumn(feature, F.explode(points))
    return model.transform(assemble(spread, columns)).select(
        key, F.col(feature).alias("at"), F.col(output).cast("double").alias("predicted")
    )


def partial_dependence(df: DataFrame, model, columns: Sequence[str], feature: str, grid: Sequence[float], key: str, output: str = "prediction") -> DataFrame:
    lines = ice(df, model, columns, feature, grid, key, output)
    return lines.groupBy("at").agg(F.avg("predicted").alias("mean"), F.count("*").alias("n"))
