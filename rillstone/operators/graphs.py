"""Connected components by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rillstone.functions.runtime import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on ``(u, v)``. The smallest neighbour is an aggregate, never a list, so a
    node with very many edges is combined before the shuffle."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("_m")).select(
        "u", F.least("_m", "u").alias("m")
    )
    joined = both.join(low, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
    return out.filter(F.col("u") != F.col("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether ``(u, v)`` are stars already: every ``u`` has one ``v``, and no ``v`` is a ``u``. Each node's edges
    are counted before the shuffle."""
    out = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    into = edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    each = out.unionByName(into).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.agg(F.count_if(F.expr("up > 1 OR (up = 1 AND down = 1)"))).first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u, v)``; the component is its smallest
    node. Rounds go on until all edges are stars, about the logarithm of the longest path; each is checkpointed."""
    clean = edges.select("u", "v")
    nodes = clean.select(F.col("u").alias("node")).unionByName(clean.select(F.col("v").alias("node"))).distinct()
    down = clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = cut_lineage(down.filter("u != v").distinct())
    while not _settled(now):
        now = cut_lineage(_star(_star(now, True), False))
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("_c")), "node", "left").select(
        "node", F.coalesce("_c", "node").alias("component")
    )
