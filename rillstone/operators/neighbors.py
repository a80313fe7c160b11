"""Exact nearest neighbours in few dimensions, and what is built on them.

Points are kept in cells of bounded size, cut at quantiles in all dimensions (``cells``). A query first meets the points of
its own cell; once it knows its k-th distance there it only has to visit the cells whose box this distance reaches. A query
whose cell has too few points goes by the smallest box around it that has enough. Copies of a point are merged first, so
no cell can fill up with equal points.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from rillstone.functions.runtime import cut_lineage
from rillstone.functions.statistics import join_statistics
from rillstone.operators.cells import grow, locate, reached

CELL_ROWS = 2000
#: Queries of one cell in one task.
QUERIES = 50_000
BLOCK_CELLS = 4_000_000


def distinct_points(df: DataFrame, key: str, coords: Sequence[str]) -> DataFrame:
    """One row per position: smallest key, coordinates, number of copies."""
    doubles = df.select(key, *[F.col(c).cast("double").alias(c) for c in coords]).dropna()
    return doubles.groupBy(*coords).agg(F.min(key).alias(key), F.count("*").alias("copies"))


def _search(k: int, d: int, same: bool):
    """Task-side search of one cell: the k nearest points of each query, in blocks."""

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        parts: list[pd.DataFrame] = []
        names = [f"x{i}" for i in range(d)]
        p = p.sort_values("id", kind="stable")
        points, ids = p[names].to_numpy(float), p["id"].to_numpy()
        rows_at_once = max(1, BLOCK_CELLS // max(1, len(p)))
        for start in range(0, len(q) if len(p) else 0, rows_at_once):
            block = q.iloc[start : start + rows_at_once]
            x = block[names].to_numpy(float)
            far = np.zeros((len(x), len(points)))
            for i in range(d):
                far += (x[:, i : i + 1] - points[None, :, i]) ** 2
            far = np.sqrt(far)
            if same:
                far[block["id"].to_numpy()[:, None] == ids[None, :]] = np.inf
            # All points up to the k-th distance, then the first k of each row: points are sorted
            # by id, so ties fall to the smaller id.
            edge = min(k, len(points)) - 1
            kth = np.partition(far, edge, axis=1)[:, edge]
            rows, cols = np.nonzero(far <= kth[:, None])
            order = np.lexsort((cols, far[rows, cols], rows))
            rows, cols = rows[order], cols[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
            rows, cols = rows[place < k], cols[place < k]
            found = pd.DataFrame(
                {"id": block["id"].to_numpy()[rows], "other": ids[cols], "distance": far[rows, cols]}
            )
            parts.append(found[np.isfinite(found["distance"])])
        if not parts:
            return pd.DataFrame({"id": ids[:0], "other": ids[:0], "distance": np.zeros(0)})
        return pd.concat(parts)

    return run


def nearest(
    queries: DataFrame,
    points: DataFrame,
    key: str,
    coords: Sequence[str],
    k: int,
    same: bool = False,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """``(id, other, distance, rank)``: the k nearest points of each query, ties to the smaller
    key. ``same`` leaves out the query itself. Exact in any dimension, but in many dimensions
    distances reach far and most cells are visited: reduce the dimensions first."""
    d = len(coords)
    names = [f"x{i}" for i in range(d)]

    def flat(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).alias("id"), *[F.col(c).cast("double").alias(x) for c, x in zip(coords, names)])

    cells = grow(flat(points), names, max(cell_rows, 2 * k))
    kind = points.schema[key].dataType.simpleString()
    schema = f"id {kind}, other {kind}, distance double"
    search = _search(k, d, same)

    def visit(asked: DataFrame) -> DataFrame:
        """A cell that very many queries visit is given to several tasks, with its points."""
        crowds = asked.groupBy("node").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("_parts")).filter("_parts > 1")
        crowds = cut_lineage(crowds)
        parts = F.coalesce("_parts", F.lit(1))
        left = join_statistics(asked, crowds, ["node"], "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("_parts")
        right = join_statistics(cells.points, crowds, ["node"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
        both = left.groupBy("node", "part").cogroup(right.groupBy("node", "part"))
        return both.applyInPandas(search, schema)

    # Results of the first visit are read three times: radius, visits and the merge.
    placed = cut_lineage(locate(cells, flat(queries), k))
    own = cut_lineage(visit(placed))
    reach = own.groupBy("id").agg(F.count("*").alias("n"), F.max("distance").alias("r"))
    known = F.coalesce(F.col("n"), F.lit(0)) >= k
    r = F.when(known, F.least("r", F.coalesce("within", "r"))).otherwise(F.col("within")) * (1 + 1e-9) + 1e-12
    balls = placed.withColumnRenamed("node", "_own").join(reach, "id", "left").withColumn("radius", r)
    more = reached(cells, balls.drop("n", "r", "within"), "radius").filter("node != _own")
    both = own.unionByName(visit(more))
    best = Window.partitionBy("id").orderBy("distance", "other")
    return both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def local_outlier_factor(
    df: DataFrame, key: str, coords: Sequence[str], k: int = 10, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """``(key, lof)`` for each distinct position, with k distinct neighbours; about 1 inside a
    cluster, larger for outliers."""
    points = distinct_points(df, key, coords)
    near = cut_lineage(nearest(points, points, key, coords, k, True, cell_rows))
    reach = near.groupBy("id").agg(F.max("distance").alias("k_distance"))
    other = reach.select(F.col("id").alias("other"), F.col("k_distance").alias("_kd"))
    density = near.join(other, "other").groupBy("id").agg(
        F.try_divide(F.count("*"), F.sum(F.greatest("distance", "_kd"))).alias("lrd")
    )
    theirs = density.select(F.col("id").alias("other"), F.col("lrd").alias("_lrd"))
    mean = near.join(theirs, "other").groupBy("id").agg(F.avg("_lrd").alias("_mean"))
    return mean.join(density, "id").join(reach, "id").select(
        F.col("id").alias(key), "k_distance", F.try_divide("_mean", "lrd").alias("lof")
    )


def knn_classify(
    train: DataFrame,
    test: DataFrame,
    key: str,
    coords: Sequence[str],
    label: str,
    k: int = 5,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Vote of the k nearest training rows; equal votes go to the smaller label. Test rows at one
    position are asked once, and of training rows at one position only the k smallest keys can
    ever be among the k nearest, so copies never fill a cell."""
    place = [F.col(c).cast("double").alias(c) for c in coords]
    copies = Window.partitionBy(*coords).orderBy(key)
    known = (
        train.select(key, label, *place)
        .dropna(subset=list(coords))
        .withColumn("_rn", F.row_number().over(copies))
        .filter(F.col("_rn") <= k)
        .drop("_rn")
    )
    asked = distinct_points(test, key, coords)
    near = nearest(asked, known, key, coords, k, False, cell_rows)
    votes = (
        near.join(known.select(F.col(key).alias("other"), F.col(label).alias("vote")), "other")
        .groupBy("id", "vote")
        .agg(F.count("*").alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("vote").alias("vote")))
    answer = votes.groupBy("id").agg(best.getField("vote").alias("prediction"))
    here = asked.join(answer.withColumnRenamed("id", key), key).select(*coords, "prediction")
    return test.select(key, *place).join(here, list(coords), "left").select(key, "prediction")


# --- isolation forest ------------------------------------------------------------------------


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2 * (np.log(n[big] - 1) + 0.5772156649015329) - 2 * (n[big] - 1) / n[big]
    out[n == 2] = 1.0
    return out


def isolation_forest(
    df: DataFrame, key: str, coords: Sequence[str], trees: int = 50, sample: int = 256, seed: int = 0
) -> DataFrame:
    """``(key, score)``, near 1 for rows that random splits isolate early. Each tree grows from
    ``sample`` rows drawn by a hash of the key; trees (at most ``trees * 2 * sample`` nodes) go to
    the tasks, which score all rows in batches."""
    total = df.count()
    keep = min(1.0, 4.0 * sample / max(1, total))

    def drawn_by(tree):
        return F.pmod(F.xxhash64(F.col(key), tree, F.lit(seed)), F.lit(1 << 52))

    drawn = (
        df.select(key, *[F.col(c).cast("double").alias(c) for c in coords])
        .withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: drawn_by(t) <= keep * float(1 << 52))))
        .withColumn("_d", drawn_by(F.col("tree")))
    )
    first = Window.partitionBy("tree").orderBy("_d", key)
    chosen = drawn.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= sample)
    names = list(coords)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = pdf.sort_values("_rn")[names].to_numpy(float)
        limit = ceil(np.log2(max(2, len(x))))
        nodes: list[list[float]] = []
        stack = [(np.arange(len(x)), 0, -1, 0)]
        while stack:
            rows, depth, parent, side = stack.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = me
            spread = x[rows].max(axis=0) - x[rows].min(axis=0) if len(rows) else np.zeros(len(names))
            usable = np.flatnonzero(spread > 0)
            if depth >= limit or len(rows) <= 1 or not len(usable):
                nodes.append([-1.0, float(depth + _average_path(np.array([len(rows)]))[0]), -1, -1])
                continue
            f = int(rng.choice(usable))
            cut = rng.uniform(x[rows, f].min(), x[rows, f].max())
            nodes.append([float(f), float(cut), -1, -1])
            left = x[rows, f] < cut
            stack.append((rows[~left], depth + 1, me, 1))
            stack.append((rows[left], depth + 1, me, 0))
        a = np.array(nodes, float)
        return pd.DataFrame(
            {"tree": tree, "node": np.arange(len(a)), "feature": a[:, 0].astype(int), "cut": a[:, 1],
             "below": a[:, 2].astype(int), "above": a[:, 3].astype(int)}
        )

    grown = chosen.groupBy("tree").applyInPandas(
        grow, "tree int, node int, feature int, cut double, below int, above int"
    ).toPandas().sort_values(["tree", "node"])
    forest = [
        {c: g[c].to_numpy() for c in ("feature", "cut", "below", "above")} for _, g in grown.groupby("tree")
    ]
    norm = float(_average_path(np.array([min(sample, total)]))[0]) or 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].to_numpy(float)
            depth = np.zeros(len(x))
            for t in forest:
                at = np.zeros(len(x), int)
                while True:
                    inner = np.flatnonzero(t["feature"][at] >= 0)
                    if not len(inner):
                        break
                    node = at[inner]
                    go = x[inner, t["feature"][node]] < t["cut"][node]
                    at[inner] = np.where(go, t["below"][node], t["above"][node])
                depth += t["cut"][at]
            yield pd.DataFrame({key: pdf[key], "score": 2.0 ** (-depth / len(forest) / norm)})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in coords]).mapInPandas(
        score, f"{key} {kind}, score double"
    )
