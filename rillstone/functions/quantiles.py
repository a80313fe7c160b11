"""Exact quantiles with linear interpolation, per group, at any group size.

``percentile`` keeps every distinct value of a group in the memory of one task. It is used when
the largest group is small. Beyond that a sketch brackets each wanted rank, exact counts below
each bracket are taken, and only rows inside the brackets are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rillstone.functions.columns import join_null_safe
from rillstone.functions.ordered import largest_group, running_totals
from rillstone.functions.runtime import cut_lineage
from rillstone.functions.statistics import join_statistics

SMALL_GROUP = 2_000_000


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    small_group: int = SMALL_GROUP,
    accuracy: int = 100_000,
    hot: int | None = None,
) -> DataFrame:
    """One row per group: the keys and ``q0, q1, ...`` in the order of ``probs``."""
    if hot is None:
        hot = largest_group(df, keys)
    if hot <= small_group:
        q = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]))
        return df.groupBy(*keys).agg(q.alias("_q")).select(
            *keys, *[F.get("_q", F.lit(i)).alias(f"q{i}") for i in range(len(probs))]
        )
    return _by_brackets(df, keys, value, probs, accuracy)


def _by_brackets(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int
) -> DataFrame:
    # A key that is always there lets the global case share the grouped plan.
    group = [*keys, "_all"]
    data = df.select(*keys, F.lit(0).alias("_all"), F.col(value).cast("double").alias("_v"))
    slack = 3.0 / accuracy
    edges: list[float] = []
    for p in probs:
        edges += [max(0.0, p - slack), min(1.0, p + slack)]
    # One row per group, read by both passes below.
    sketch = cut_lineage(
        data.groupBy(*group).agg(
            F.count("_v").alias("_n"),
            F.min("_v").alias("_min"),
            F.max("_v").alias("_max"),
            F.percentile_approx("_v", edges, accuracy).alias("_e"),
        )
    )

    # The sketch errs by n / accuracy ranks; three times that leaves two ranks to spare once a
    # group has ``accuracy`` rows. A smaller group is ranked as a whole.
    few = F.col("_n") < accuracy

    def low(i: int) -> Column:
        return F.when(few, F.col("_min")).otherwise(F.get("_e", F.lit(2 * i)))

    def high(i: int) -> Column:
        return F.when(few, F.col("_max")).otherwise(F.get("_e", F.lit(2 * i + 1)))

    marked = join_statistics(data, sketch, group).filter(F.col("_v").isNotNull())
    below = marked.groupBy(*group).agg(
        F.first("_n").alias("_n"),
        *[F.count_if(F.col("_v") < low(i)).alias(f"_below{i}") for i in range(len(probs))],
    )
    # Equal values are counted before anything is repeated for each bracket.
    anywhere = F.lit(False)
    for i in range(len(probs)):
        anywhere = anywhere | F.col("_v").between(low(i), high(i))
    values = marked.filter(anywhere).groupBy(*group, "_v").agg(F.count("*").alias("_c"))
    hits = [F.when(F.col("_v").between(low(i), high(i)), F.lit(i)) for i in range(len(probs))]
    inside = join_statistics(values, sketch, group).select(
        *group, "_v", "_c", F.explode(F.array_compact(F.array(*hits))).alias("_i")
    )
    # A small share of the rows; ranked in two levels should it still be large.
    ranks = running_totals(cut_lineage(inside), [*group, "_i"], "_v", ["_c"])
    ranked = join_statistics(ranks, below, group)

    picks = []
    for i, p in enumerate(probs):
        place = (F.col("_n") - 1) * F.lit(float(p))
        mine = F.col("_i") == i
        end = F.col(f"_below{i}") + F.col("cum__c")
        start = end - F.col("_c")
        for tag, rank in (("a", F.floor(place)), ("b", F.ceil(place))):
            picks.append(
                F.max(F.when(mine & (start <= rank) & (rank < end), F.col("_v"))).alias(
                    f"_{tag}{i}"
                )
            )
    picked = ranked.groupBy(*group).agg(F.first("_n").alias("_n"), *picks)
    out = []
    for i, p in enumerate(probs):
        place = (F.col("_n") - 1) * F.lit(float(p))
        part = place - F.floor(place)
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        exact = a + (b - a) * part
        out.append(
            F.when(
                a.isNull() | b.isNull(), F.raise_error(F.lit("rank outside its bracket"))
            ).otherwise(exact).alias(f"q{i}")
        )
    result = picked.select(*group, *out)
    # Groups without any value keep their row.
    return join_null_safe(sketch.select(*group), result, group, "left").drop("_all")
