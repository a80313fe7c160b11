"""Splits, metrics, intervals, ranking quality, fairness and drift."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from rillstone.functions.ordered import running_totals
from rillstone.functions.quantiles import exact_quantiles
from rillstone.functions.runtime import cut_lineage
from rillstone.functions.statistics import join_statistics

HASH_RANGE = float(1 << 60)


def ticket(key: str, seed: int = 0) -> Column:
    """A number from 0 to 2^60 drawn from the key by md5: the same in any engine and layout."""
    text = F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 0) -> DataFrame:
    part = F.when(ticket(key, seed) < int(share * HASH_RANGE), "train").otherwise("test")
    return df.withColumn("split", part)


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    return df.withColumn("fold", (ticket(key, seed) % k).cast("int"))


def stratified_split(
    df: DataFrame, key: str, stratum: str, share: float = 0.8, seed: int = 0, **options
) -> DataFrame:
    """The first ``floor(share * n)`` rows of every class in hash order train, equal hashes
    in order of the key. Ranks are two-level
    running counts when a class is large, so no class has to fit one task."""
    drawn = df.withColumns({"_ticket": ticket(key, seed), "_one": F.lit(1)})
    ranked = running_totals(drawn, [stratum], "_ticket", ["_one"], ties=[key], **options)
    joined = join_statistics(ranked, df.groupBy(stratum).agg(F.count("*").alias("_n")), [stratum])
    part = F.when(F.col("cum__one") <= F.floor(F.col("_n") * share), "train").otherwise("test")
    return joined.select(*[F.col(c) for c in df.columns], part.alias("split"))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Over the rows that have both a label and a prediction."""
    error = F.col(label) - F.col(prediction)
    return df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull()).agg(
        F.count("*").alias("n"),
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(label).alias("_var"),
    ).select(
        "n", "mse", "rmse", "mae", (1 - F.try_divide("mse", F.col("_var"))).alias("r2")
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count("*").alias("n"))


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
        "precision": F.try_divide(tp, tp + fp),
        "recall": F.try_divide(tp, tp + fn),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
    }


def _cells(label: str, prediction: str) -> list[Column]:
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return [
        F.count_if(y & p).alias("tp"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & ~p).alias("tn"),
    ]


def classification_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    cells = df.groupBy(*by).agg(*_cells(label, prediction))
    rates = _rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return cells.select("*", *[v.alias(k) for k, v in rates.items()])


def _curve(df: DataFrame, score: str, label: str, **options) -> DataFrame:
    """Positives and negatives per distinct score with totals from the highest score down."""
    y = F.col(label) == 1
    per_score = (
        df.filter(F.col(score).isNotNull())
        .groupBy(F.col(score).cast("double").alias("score"))
        .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    )
    # counted once: running totals and their users read it several times
    return running_totals(cut_lineage(per_score), [], "score", ["pos", "neg"], descending=True, **options)


def roc_curve(df: DataFrame, score: str, label: str, **options) -> DataFrame:
    """``score, tpr, fpr`` at every distinct score."""
    curve = _curve(df, score, label, **options)
    totals = curve.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    return curve.select(
        "score",
        F.try_divide("cum_pos", totals.getField("p")).alias("tpr"),
        F.try_divide("cum_neg", totals.getField("n")).alias("fpr"),
    )


def roc_auc(df: DataFrame, score: str, label: str, **options) -> DataFrame:
    """Area under the ROC curve; tied scores count half."""
    curve = _curve(df, score, label, **options)
    above = F.col("cum_pos") - F.col("pos")
    wins = F.sum(F.col("neg") * (above + F.col("pos") / 2.0))
    return curve.agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("_w")
    ).select("n_pos", "n_neg", F.try_divide("_w", F.col("n_pos") * F.col("n_neg")).alias("roc_auc"))


def pr_auc(df: DataFrame, score: str, label: str, **options) -> DataFrame:
    """Average precision: precision at each score weighted by the recall it adds."""
    curve = _curve(df, score, label, **options)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return curve.agg(
        F.sum("pos").alias("n_pos"), F.sum(F.col("pos") * precision).alias("_w")
    ).select("n_pos", F.try_divide("_w", F.col("n_pos")).alias("average_precision"))


def binned_roc_auc(df: DataFrame, score: str, label: str, bins: int = 1000) -> DataFrame:
    """The same on scores from 0 to 1 cut to ``bins`` equal bins: one aggregate, one window over
    at most ``bins`` rows."""
    binned = df.withColumn("_s", F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)))
    return roc_auc(binned, "_s", label)


def calibration(df: DataFrame, score: str, label: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Mean score and observed rate per score bin."""
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, place.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate")
    )


def precision_at_k(
    df: DataFrame, score: str, label: str, k: int, by: Sequence[str] = (), tie: str | None = None
) -> DataFrame:
    """Share of positives among the k best; groups are limited before the shuffle."""
    order = [F.desc(score), *([F.asc(tie)] if tie else [])]
    if by:
        rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        best = df.withColumn("_rn", rn).filter(F.col("_rn") <= k)
    else:
        best = df.orderBy(*order).limit(k)
    return best.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((F.col(label) == 1).cast("double")).alias("precision_at_k")
    )


def ranking_metrics(
    df: DataFrame, group: str, score: str, relevance: str, k: int = 10, tie: str | None = None
) -> DataFrame:
    """Average precision and NDCG at k per group. Only the k best rows of a group, by score and by
    relevance, are ranked."""
    ties = [F.asc(tie)] if tie else []
    by_score = Window.partitionBy(group).orderBy(F.desc(score), *ties)
    by_gain = Window.partitionBy(group).orderBy(F.desc(relevance), *ties)
    ranked = df.withColumn("_rn", F.row_number().over(by_score)).filter(F.col("_rn") <= k)
    upto = Window.partitionBy(group).orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col(relevance) > 0).cast("int")
    shown = ranked.withColumn("_hits", F.sum(hit).over(upto)).groupBy(group).agg(
        F.sum(hit * F.col("_hits") / F.col("_rn")).alias("_ap"),
        F.sum(F.col(relevance) / F.log2(F.col("_rn") + 1)).alias("_dcg"),
    )
    best = (
        df.withColumn("_rn", F.row_number().over(by_gain))
        .filter(F.col("_rn") <= k)
        .groupBy(group)
        .agg(
            F.sum(F.col(relevance) / F.log2(F.col("_rn") + 1)).alias("_ideal"),
            F.count_if(F.col(relevance) > 0).alias("_possible"),
        )
    )
    return shown.join(best, group).select(
        group,
        F.coalesce(F.try_divide("_ap", "_possible"), F.lit(0.0)).alias("ap_at_k"),
        F.coalesce(F.try_divide("_dcg", "_ideal"), F.lit(0.0)).alias("ndcg_at_k"),
    )


def mean_ranking_metrics(df: DataFrame, group: str, score: str, relevance: str, k: int = 10, tie: str | None = None) -> DataFrame:
    return ranking_metrics(df, group, score, relevance, k, tie).agg(
        F.count("*").alias("n_groups"), F.avg("ap_at_k").alias("map_at_k"), F.avg("ndcg_at_k").alias("ndcg_at_k")
    )


def _poisson_bounds() -> list[int]:
    """A draw of 32 bits gives as many events, Poisson(1), as there are bounds up to it; beyond 12 the chance is below 1e-10."""
    term, total, out = 2.718281828459045**-1, 0.0, []
    for n in range(12):
        total += term
        out.append(ceil(total * 2.0**32))
        term /= n + 1
    return [x for x in out if x < 1 << 32]


def bootstrap_mean(
    df: DataFrame, value: str, key: str, by: Sequence[str] = (), replicates: int = 200, level: float = 0.95, seed: int = 0
) -> DataFrame:
    """Mean with a bootstrap interval. Each row gets a Poisson weight for each replicate from a
    digest of its key, the same in any engine, drawn for a batch of rows at once; they are summed inside the task, so what is
    shuffled is one row per group, replicate and task. Rows of one key have the same weights: with a key that names
    stretches of time, whole stretches are drawn, as series need whose values depend on each other."""
    bounds, tails = _poisson_bounds(), [f"{d}:{seed}".encode() for d in range((replicates - 1) // 4 + 1)]

    def sums(batches):
        """Of each group of a batch the weights and the weighted values, added up for each replicate."""
        for rows in batches:
            # a digest has four draws of 32 bits
            digests = b"".join(md5(k + t).digest() for k in (x.encode() for x in rows["_k"].to_pylist()) for t in tails)
            draws = np.frombuffer(digests, ">u4").astype(np.uint32).reshape(len(rows), 4 * len(tails))[:, :replicates]
            drawn = np.zeros(draws.shape, np.int8)
            for x in bounds:
                drawn += draws >= x
            values, place = rows["_v"].to_numpy(zero_copy_only=False), np.arange(len(rows))
            if by:
                groups = pa.Table.from_batches([rows]).select(groupings).append_column("_i", pa.array(place)).group_by(groupings).aggregate([("_i", "list")])
                places = [np.array(x) for x in groups["_i_list"].to_pylist()]
            else:
                places = [place] if len(rows) else []
            n = [drawn[x].sum(axis=0, dtype=np.int64) for x in places]
            with np.errstate(invalid="ignore"):
                total = [values[x] @ drawn[x].astype(float) for x in places]
            found = [groups[c].combine_chunks() for c in groupings] if by else []
            arrays = [*found, pa.array(n, pa.list_(pa.int64())), pa.array(total, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*groupings, "_n", "_s"])

    # a null key adds nothing to the text that is hashed
    text = F.concat_ws(":", F.col(key).cast("string"), F.lit(""))
    groupings = [f"_by{i}" for i in range(len(by))]
    held = df.filter(F.col(value).isNotNull()).select(
        *(F.col(c).alias(g) for c, g in zip(by, groupings, strict=True)), F.col(value).cast("double").alias("_v"), text.alias("_k")
    )
    added = StructType([*held.schema.fields[: len(by)], StructField("_n", ArrayType(LongType())), StructField("_s", ArrayType(DoubleType()))])
    # rows are small and their draws are not: dealt to as many tasks as a shuffle has, whatever the files are
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = held.repartition(tasks).mapInArrow(sums, added).select(
        *(F.col(g).alias(c) for c, g in zip(by, groupings, strict=True)), F.posexplode(F.arrays_zip("_n", "_s")).alias("_r", "_x")
    )
    means = each.groupBy(*by, "_r").agg(F.try_divide(F.sum("_x._s"), F.sum("_x._n")).alias("_m"))
    tail = (1 - level) / 2
    spread = means.groupBy(*by).agg(
        F.percentile("_m", tail).alias("low"), F.percentile("_m", 1 - tail).alias("high"), F.stddev_samp("_m").alias("std_error")
    )
    center = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    if by:
        return center.join(spread, list(by))
    row = spread.select(F.struct("low", "high", "std_error")).scalar()
    return center.select("n", "mean", row.getField("low").alias("low"), row.getField("high").alias("high"), row.getField("std_error").alias("std_error"))


def fairness_by_group(df: DataFrame, label: str, prediction: str, group: str) -> DataFrame:
    """Selection rate, true and false positive rate and precision per group."""
    m = df.groupBy(group).agg(F.count("*").alias("n"), *_cells(label, prediction))
    return m.select(
        group,
        "n",
        F.try_divide(F.col("tp") + F.col("fp"), F.col("n")).alias("selection_rate"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"),
        F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def fairness_gaps(df: DataFrame, label: str, prediction: str, group: str) -> DataFrame:
    """Largest differences between groups: demographic parity, equalized odds, calibration."""
    g = fairness_by_group(df, label, prediction, group)

    def gap(c: str) -> Column:
        return F.max(c) - F.min(c)

    return g.agg(
        gap("selection_rate").alias("demographic_parity_gap"),
        F.greatest(gap("tpr"), gap("fpr")).alias("equalized_odds_gap"),
        gap("precision").alias("calibration_gap"),
        F.try_divide(F.min("selection_rate"), F.max("selection_rate")).alias("disparate_impact"),
    )


def drift_psi(
    before: DataFrame, after: DataFrame, value: str, bins: int = 10, floor: float = 1e-6, **options
) -> DataFrame:
    """Population stability index with bins at quantiles of the first period. One row per bin, and
    the total under a null bin; the inner bin edges are a single row."""
    probs = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(before, [], value, probs, **options)
    cuts = edges.select(F.array(*edges.columns)).scalar()

    def counts(df: DataFrame, name: str) -> DataFrame:
        place = F.size(F.filter(F.col("_cuts"), lambda e: e < F.col("_v")))
        placed = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("_v"), cuts.alias("_cuts"))
        return placed.groupBy(place.alias("bin")).agg(F.count("*").alias(name))

    both = counts(before, "n_before").join(counts(after, "n_after"), "bin", "full").fillna(
        0, ["n_before", "n_after"]
    )
    # One row per bin.
    every = Window.partitionBy(F.lit(0))
    p = F.greatest(F.col("n_before") / F.sum("n_before").over(every), F.lit(floor))
    q = F.greatest(F.col("n_after") / F.sum("n_after").over(every), F.lit(floor))
    each = both.withColumns({"_p": p, "_q": q}).select(
        "bin", "n_before", "n_after", ((F.col("_q") - F.col("_p")) * F.log(F.col("_q") / F.col("_p"))).alias("psi")
    )
    return each.unionByName(
        each.agg(F.lit(None).cast("int").alias("bin"), *[F.sum(c).alias(c) for c in ("n_before", "n_after", "psi")])
    )
