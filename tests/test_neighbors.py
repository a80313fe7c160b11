"""Neighbours, outliers and density clusters against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.operators import cells, density, graphs, neighbors


def cloud(spark, xy):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double")


@pytest.fixture(scope="module")
def skewed():
    """A dense clump with many copies, a line, and scattered points."""
    rng = np.random.default_rng(11)
    clump = np.round(rng.normal(0, 0.02, size=(150, 2)), 3)
    line = np.column_stack([np.linspace(2, 4, 60), np.full(60, 1.0)])
    rest = rng.uniform(-5, 5, size=(90, 2))
    return np.vstack([clump, np.zeros((80, 2)), line, rest])


def brute(points, queries, k, same):
    far = np.sqrt(((queries[:, None, :] - points[None]) ** 2).sum(-1))
    if same:
        np.fill_diagonal(far, np.inf)
    order = np.argsort(far, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(far, order, 1)


def test_nearest_in_small_cells(spark, skewed):
    xy = np.unique(skewed, axis=0)
    df = cloud(spark, xy)
    got = neighbors.nearest(df, df, "id", ["x", "y"], 7, True, cell_rows=20).collect()
    _, far = brute(xy, xy, 7, True)
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append((r["rank"], r["distance"]))
    assert len(by) == len(xy)
    for i, found in by.items():
        assert [d for _, d in sorted(found)] == pytest.approx(list(far[i]))


@pytest.mark.parametrize("d", [1, 2, 3])
def test_nearest_with_ties_and_far_queries(spark, d):
    rng = np.random.default_rng(d)
    p = np.unique(np.vstack([np.zeros((1, d)), np.round(rng.normal(size=(300, d)), 1), np.column_stack([np.full(120, 3.0), *[rng.uniform(-9, 9, 120)] * (d - 1)])]), axis=0)
    q = np.vstack([p[::7], rng.uniform(-40, 40, size=(25, d))])
    names = [f"c{i}" for i in range(d)]
    schema = ", ".join(["id long", *(f"{c} double" for c in names)])
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], schema)
    queries = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(q)], schema)
    order, far = brute(p, q, 5, False)
    got = {}
    for r in neighbors.nearest(queries, points, "id", names, 5, False, cell_rows=12).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["other"], r["distance"])
    for i in range(len(q)):
        assert [got[i][k + 1][0] for k in range(5)] == order[i].tolist()
        assert [got[i][k + 1][1] for k in range(5)] == pytest.approx(far[i].tolist())


def test_cells_met_by_a_query_do_not_grow_with_the_points(spark):
    rng = np.random.default_rng(5)
    met = []
    for n in (2_000, 32_000):
        xy = np.vstack([rng.normal(0, 0.3, size=(n // 2, 2)), rng.uniform(-5, 5, size=(n // 2, 2))])
        df = cloud(spark, xy).repartition(8)
        tree = cells.grow(df, ["x", "y"], 50)
        sizes = [r["count"] for r in tree.points.groupBy("node").count().collect()]
        assert sum(sizes) == n and max(sizes) <= 50
        near = neighbors.nearest(df, df, "id", ["x", "y"], 5, True, cell_rows=50).groupBy("id").agg(F.max("distance").alias("r"))
        balls = df.join(near, "id")
        met.append(cells.reached(tree, balls, "r").count() / n)
    assert met[1] < 1.3 * met[0] and met[1] < 12, met
    # cuts are joined, so they do not stand in the plan
    plan = neighbors.nearest(df, df, "id", ["x", "y"], 5, True, cell_rows=50)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 50_000


def test_outlier_factor_does_not_depend_on_cells(spark, skewed):
    df = cloud(spark, skewed)
    small = {r["id"]: r["lof"] for r in neighbors.local_outlier_factor(df, "id", ["x", "y"], 5, 25).collect()}
    whole = {r["id"]: r["lof"] for r in neighbors.local_outlier_factor(df, "id", ["x", "y"], 5, 10_000).collect()}
    assert small.keys() == whole.keys() and len(small) == len(np.unique(skewed, axis=0))
    assert all(small[k] == pytest.approx(whole[k]) for k in small)


def test_fewer_points_than_neighbours(spark):
    df = cloud(spark, [(0, 0), (1, 0), (5, 0)])
    got = neighbors.nearest(df, df, "id", ["x", "y"], 10, True).collect()
    assert len(got) == 6


def test_votes_with_copies(spark):
    train = cloud(spark, [(0, 0)] * 50 + [(3, 3)] * 4).withColumn("label", (F.col("x") > 1).cast("int"))
    test = cloud(spark, [(0.1, 0)] * 20 + [(2.9, 3)])
    got = neighbors.knn_classify(train, test, "id", ["x", "y"], "label", 3, cell_rows=10).collect()
    assert len(got) == 21 and {r["id"]: r["prediction"] for r in got}[20] == 1
    assert sum(r["prediction"] for r in got) == 1


def test_forest_ranks_the_outlier_first(spark):
    rng = np.random.default_rng(4)
    df = cloud(spark, np.vstack([rng.normal(size=(800, 2)), [[12.0, 12.0]]]))
    scores = {r["id"]: r["score"] for r in neighbors.isolation_forest(df, "id", ["x", "y"]).collect()}
    assert len(scores) == 801 and max(scores, key=scores.get) == 800 and all(0 < s < 1 for s in scores.values())
    again = {r["id"]: r["score"] for r in neighbors.isolation_forest(df.repartition(5), "id", ["x", "y"]).collect()}
    assert again == pytest.approx(scores)


def reference_clusters(xy, eps, least):
    near = ((xy[:, None, :] - xy[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    label = np.full(len(xy), -1)
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo, seen = [i], {i}
        while todo:
            j = todo.pop()
            for k in np.flatnonzero(near[j] & core):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        for j in seen:
            label[j] = min(seen)
    for i in np.flatnonzero(~core):
        mates = label[near[i] & core]
        if len(mates):
            label[i] = mates.min()
    return label, core


@pytest.mark.parametrize(("eps", "least"), [(0.5, 4), (0.05, 6), (0.3, 3)])
def test_density_clusters(spark, skewed, eps, least):
    label, core = reference_clusters(skewed, eps, least)
    got = {r["id"]: (r["cluster"], r["is_core"]) for r in density.dbscan(cloud(spark, skewed), "id", "x", "y", eps, least).collect()}
    assert len(got) == len(skewed)
    for i, (c, k) in got.items():
        assert k == core[i] and (-1 if c is None else c) == label[i]


def test_two_dense_bands_almost_touching(spark):
    """Representatives are far apart, so the decision needs refined boxes."""
    eps = 1.0
    t = np.linspace(0, 0.6, 200)
    for gap, joined in ((0.999999, True), (1.000001, False)):
        xy = np.vstack([np.column_stack([t * 0.3, t]), np.column_stack([0.18 + gap + t * 0.2, 0.6 - t])])
        label, _ = reference_clusters(xy, eps, 5)
        got = density.dbscan(cloud(spark, xy), "id", "x", "y", eps, 5)
        assert {r["id"]: r["cluster"] for r in got.collect()} == dict(enumerate(label))
        assert (len(set(label)) == 1) == joined or len(set(label)) == 1


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    star = [(300, 300 + i) for i in range(1, 60)]
    edges = spark.createDataFrame(path + star, "u long, v long")
    got = {r["node"]: r["component"] for r in graphs.connected_components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and got[102] == 100 and got[200] == 200
    assert {got[300 + i] for i in range(60)} == {300} and len(got) == 41 + 3 + 1 + 60
