"""Comparing the members of groups that may be large: counted first, cut into blocks, compared block against block.

No row is made for a pair that is not wanted, no task holds more than two blocks, and every pair of a group meets in
exactly one task. What a comparison gives out is a spanning forest of the pairs found in it, which keeps components.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rillstone.functions.runtime import written

EDGES = "u long, v long"


def paired_blocks(members: DataFrame, group: str, node: str, per_block: int) -> DataFrame:
    """Rows of ``members`` once for each pair of blocks ``(_i, _j)`` that their block ``_b`` is in. The block of a
    row is a hash of its node, so a task that runs again deals alike. Of each group, the rows that are not ``_open`` are
    settled among themselves: their blocks meet those of open rows only. Groups without open rows give nothing."""
    n = members.groupBy(group).agg(
        F.count_if("_open").alias("_n"), F.count_if(~F.col("_open")).alias("_m")
    ).filter("_n > 0").select(group, *(F.ceil(F.col(c) / F.lit(per_block)).alias(c) for c in ("_n", "_m")))
    h = F.xxhash64(node)
    cut = members.join(n, group).withColumn(
        "_b", F.when(F.col("_open"), F.pmod(h, "_n")).otherwise(F.col("_n") + F.pmod(h, F.greatest("_m", F.lit(1))))
    )
    last = F.when(F.col("_open"), F.col("_n") + F.col("_m")).otherwise(F.col("_n")) - 1
    cut = cut.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return cut.select(
        *members.columns, "_b", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j")
    )


def sides(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the two blocks in a task's rows: twice all of them if it compares a block with itself."""
    b, i, j = rows["_b"].to_numpy(), rows["_i"].iloc[0], rows["_j"].iloc[0]
    return np.flatnonzero(b == i), np.flatnonzero(b == j)


def each_group(df: DataFrame, by: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on all rows of each group of ``by``. Groups follow each other in a task, so that many small ones cost little; a
    group is whole in memory, and should be bounded as blocks are."""
    def run(batches):
        held = None
        for rows in batches:
            rows = rows if held is None else pd.concat((held, rows), ignore_index=True)
            new = np.zeros(len(rows), bool)
            for c in by:
                x = rows[c].to_numpy()
                new[1:] |= x[1:] != x[:-1]
            bounds = [0, *np.flatnonzero(new).tolist()]
            done = [work(rows.iloc[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
            held = rows.iloc[bounds[-1] :]
            if done := [x for x in done if len(x)]:
                yield pd.concat(done, ignore_index=True)
        if held is not None and len(held):
            yield work(held)

    return df.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, schema)


def spanning(adjacent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a boolean adjacency matrix, by breadth-first search."""
    left = np.ones(len(adjacent), bool)
    a, b = [], []
    for s in range(len(adjacent)):
        if not left[s]:
            continue
        left[s], todo = False, [s]
        while todo:
            x = todo.pop()
            new = np.flatnonzero(adjacent[x] & left)
            left[new] = False
            a.extend([x] * len(new))
            b.extend(new.tolist())
            todo.extend(new.tolist())
    return np.array(a, np.int64), np.array(b, np.int64)


Near = Callable[[pd.DataFrame, np.ndarray, np.ndarray], np.ndarray]


def bucket_edges(
    keyed: DataFrame, features: DataFrame, near: Near, near_pairs: Callable[[pd.DataFrame], np.ndarray], per_block: int,
    few: int = 2,
) -> DataFrame:
    """Candidate edges ``(u, v)`` that connect all nodes that share a key and pass ``near``.

    ``keyed(node, keys)`` has the keys of each node, ``features(node, ...)`` what ``near`` compares. Buckets with the
    same members are looked at once. In buckets of at most ``few`` all pairs are judged. In others every member is first compared with the smallest of its bucket, row by row. Those
    that pass are connected by it; only what does not pass is then compared with all of the bucket, in blocks, which
    give a spanning forest instead of all pairs. A bucket of n copies so costs n comparisons."""
    keys = keyed.select("node", F.explode("keys").alias("key"))
    buckets = written(
        keys.groupBy("key")
        .agg(
            F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"),
            F.bit_xor(F.xxhash64("node")).alias("mark"),
        )
        .filter("n > 1")
        .groupBy("n", "lo", "hi", "mark")
        .agg(F.min("key").alias("key")),
        "buckets",
    )
    names = [c for c in features.columns if c != "node"]
    first = features.select(F.col("node").alias("u"), *(F.col(c).alias(f"{c}_u") for c in names))
    second = features.select(F.col("node").alias("v"), *(F.col(c).alias(f"{c}_v") for c in names))
    large = keys.join(buckets.filter(F.col("n") > few).select("key", F.col("lo").alias("u")), "key")
    small = buckets.filter("n = 2").select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    if few > 2:
        each = keys.join(buckets.filter(F.col("n").between(3, few)).select("key"), "key").select("key", F.col("node").alias("u"))
        small = small.unionByName(each.join(each.select("key", F.col("u").alias("v")), "key").filter("u < v").select("u", "v"))
    # a pair is judged once, however many buckets it is in
    wanted = small.unionByName(large.filter("node != u").select("u", F.col("node").alias("v"))).distinct()

    def judge(batches):
        for rows in batches:
            yield rows.loc[near_pairs(rows), ["u", "v"]]

    pairs = written(wanted.join(first, "u").join(second, "v").mapInPandas(judge, EDGES), "pairs")
    passed = pairs.select("u", F.col("v").alias("node"), F.lit(False).alias("_passed"))
    flagged = large.join(passed, ["u", "node"], "left").select(
        "key", "node", (F.col("_passed").isNull() & (F.col("node") != F.col("u"))).alias("_open")
    )
    flagged = written(flagged, "flagged")
    unsettled = flagged.filter("_open").select("key").distinct()
    members = flagged.join(unsettled, "key", "left_semi").join(features, "node")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = sides(rows)
        node = rows["node"].to_numpy()
        full = np.zeros((len(rows), len(rows)), bool)
        full[np.ix_(left, right)] = near(rows, left, right)
        a, b = spanning(full | full.T)
        return pd.DataFrame({"u": node[a], "v": node[b]})

    many = each_group(paired_blocks(members, "key", "node", per_block), ["key", "_i", "_j"], compare, EDGES)
    return pairs.unionByName(many)
