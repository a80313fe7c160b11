"""Density clusters in the plane, exact, on a grid.

Cells have diagonal eps, so points of one cell are always neighbours: a cell with enough points is
all core, whatever its size, and a cell is one node of the cluster graph. Only points of sparse
cells (fewer than ``min_points``) are compared one by one, which keeps the work linear. Whether
two neighbouring cells touch is decided on boxes of sub-cells that are refined where undecided.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, functions as F

from rillstone.functions.runtime import cut_lineage
from rillstone.operators.graphs import connected_components
from rillstone.operators.neighbors import distinct_points

# Cells whose nearest corners can be within eps.
REACH = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if (a, b) != (0, 0) and abs(a) + abs(b) < 4]
REFINE = 8


def _apart(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return dx * dx + dy * dy


def _near_cells(df: DataFrame, own: bool) -> DataFrame:
    steps = REACH + ([(0, 0)] if own else [])
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])
    moved = df.withColumn("_o", F.explode(offsets))
    return moved.withColumns(
        {"nx": F.col("cx") + F.col("_o.a"), "ny": F.col("cy") + F.col("_o.b")}
    ).drop("_o")


def dbscan(df: DataFrame, key: str, x: str, y: str, eps: float, min_points: int = 5) -> DataFrame:
    """``(key, cluster, is_core)``; the cluster is the smallest key of its core points, null for
    noise and for points without a place. A border point within reach of several clusters takes the smallest."""
    side = eps / sqrt(2)
    cell = {"cx": F.floor(F.col(x) / side), "cy": F.floor(F.col(y) / side)}
    points = cut_lineage(
        distinct_points(df, key, [x, y]).select(
            F.col(key).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"), "copies",
            *[v.alias(k) for k, v in cell.items()],
        )
    )
    sizes = points.groupBy("cx", "cy").agg(F.sum("copies").alias("_size"))
    sized = points.join(sizes, ["cx", "cy"])
    dense = sized.filter(F.col("_size") >= min_points)
    sparse = sized.filter(F.col("_size") < min_points)

    # Neighbours of sparse points: each has fewer than min_points mates per cell, so every point
    # of the plane is met by a bounded number of them.
    asked = _near_cells(sparse.select("id", "x", "y", "cx", "cy"), own=True).select(
        "id", F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("nx").alias("cx"), F.col("ny").alias("cy")
    )
    limit = eps * eps
    counted = (
        asked.join(points.select("x", "y", "copies", "cx", "cy"), ["cx", "cy"])
        .filter(_apart(F.col("qx"), F.col("qy"), F.col("x"), F.col("y")) <= limit)
        .groupBy("id")
        .agg(F.sum("copies").alias("_near"))
    )
    sparse_core = counted.filter(F.col("_near") >= min_points).select("id")
    columns = ["id", "x", "y", "cx", "cy"]
    core = cut_lineage(
        dense.select(*columns).unionByName(sparse.select(*columns).join(sparse_core, "id", "left_semi"))
    )

    names = core.groupBy("cx", "cy").agg(F.min("id").alias("node"))
    links = _touching_cells(core, side, eps)
    a = names.select(F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("node").alias("u"))
    b = names.select(F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("node").alias("v"))
    edges = links.join(a, ["ax", "ay"]).join(b, ["bx", "by"]).select("u", "v")
    loops = names.select(F.col("node").alias("u"), F.col("node").alias("v"))
    comp = connected_components(edges.unionByName(loops))
    cell_cluster = names.join(comp, "node").select("cx", "cy", F.col("component").alias("cluster"))
    core_cluster = core.join(cell_cluster, ["cx", "cy"])

    # Border points lie in sparse cells too.
    rest = sparse.select(*columns).join(sparse_core, "id", "left_anti")
    asked = _near_cells(rest, own=True).select(
        "id", F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("nx").alias("cx"), F.col("ny").alias("cy")
    )
    border = (
        asked.join(core_cluster.select("x", "y", "cx", "cy", "cluster"), ["cx", "cy"])
        .filter(_apart(F.col("qx"), F.col("qy"), F.col("x"), F.col("y")) <= limit)
        .groupBy("id")
        .agg(F.min("cluster").alias("cluster"))
    )
    placed = core_cluster.select("x", "y", "cluster", F.lit(True).alias("is_core")).unionByName(
        rest.join(border, "id", "left").select("x", "y", "cluster", F.lit(False).alias("is_core"))
    )
    every = df.select(F.col(key), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    # a point without a place is noise
    return every.join(placed, ["x", "y"], "left").select(
        key, "cluster", F.coalesce("is_core", F.lit(False)).alias("is_core")
    )


def _boxes(core: DataFrame, side: float, level: int) -> DataFrame:
    """Sub-cells of core points: bounding box, one of its points, number of points."""
    step = side / REFINE**level
    place = [F.floor(F.col("x") / step).alias("sx"), F.floor(F.col("y") / step).alias("sy")]
    one = F.min(F.struct("x", "y"))
    return core.groupBy("cx", "cy", *place).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        one.getField("x").alias("px"), one.getField("y").alias("py"),
    )


def _gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), a0 - b1, b0 - a1)


def _touching_cells(core: DataFrame, side: float, eps: float) -> DataFrame:
    """Pairs ``(ax, ay, bx, by)`` of cells with core points within eps of each other. It ends: each level cuts boxes
    eight times finer, until a box holds one position, and two such boxes are decided by their distance."""
    limit = eps * eps
    occupied = core.select("cx", "cy").distinct()
    # Each pair once: the other cell is later in reading order.
    open_pairs = (
        _near_cells(occupied, own=False)
        .filter((F.col("nx") > F.col("cx")) | ((F.col("nx") == F.col("cx")) & (F.col("ny") > F.col("cy"))))
        .select(F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("nx").alias("bx"), F.col("ny").alias("by"))
        .join(occupied.select(F.col("cx").alias("bx"), F.col("cy").alias("by")), ["bx", "by"], "left_semi")
    )
    pair = ["ax", "ay", "bx", "by"]
    # Open work: pairs of boxes, at first the two whole cells.
    boxes = _boxes(core, side, 0)
    work = _pair_boxes(open_pairs, boxes, boxes, [])
    touching = None
    level = 0
    while True:
        level += 1
        # Rounding must not lose a pair, so a box pair is dropped only when clearly apart.
        possible = work.filter(
            F.pow(_gap(F.col("ax0"), F.col("ax1"), F.col("bx0"), F.col("bx1")), 2)
            + F.pow(_gap(F.col("ay0"), F.col("ay1"), F.col("by0"), F.col("by1")), 2)
            <= limit * (1 + 1e-9)
        )
        possible = cut_lineage(
            possible.withColumn(
                "_hit", _apart(F.col("apx"), F.col("apy"), F.col("bpx"), F.col("bpy")) <= limit
            )
        )
        hit = possible.filter("_hit").select(*pair).distinct()
        touching = hit if touching is None else touching.unionByName(hit)
        single = (
            (F.col("ax0") == F.col("ax1")) & (F.col("ay0") == F.col("ay1"))
            & (F.col("bx0") == F.col("bx1")) & (F.col("by0") == F.col("by1"))
        )
        undecided = possible.join(hit, pair, "left_anti").filter(~single)
        undecided = cut_lineage(undecided.select(*pair, "asx", "asy", "bsx", "bsy"))
        if undecided.isEmpty():
            return touching
        finer = _boxes(core, side, level).withColumns(
            {"ux": F.floor(F.col("sx") / REFINE), "uy": F.floor(F.col("sy") / REFINE)}
        )
        work = _pair_boxes(undecided, finer, finer, ["asx", "asy", "bsx", "bsy"])


def _pair_boxes(pairs: DataFrame, left: DataFrame, right: DataFrame, parents: list[str]) -> DataFrame:
    def side(df: DataFrame, s: str) -> tuple[DataFrame, list[str]]:
        named = df.select(
            F.col("cx").alias(f"{s}x"), F.col("cy").alias(f"{s}y"),
            *[F.col(c).alias(f"{s}s{c[1]}") for c in ("ux", "uy") if parents],
            F.col("sx").alias(f"{s}nx"), F.col("sy").alias(f"{s}ny"),
            *[F.col(c).alias(f"{s}{c}") for c in ("x0", "x1", "y0", "y1", "px", "py")],
        )
        return named, [f"{s}x", f"{s}y"] + ([f"{s}sx", f"{s}sy"] if parents else [])

    a, ka = side(left, "a")
    b, kb = side(right, "b")
    out = pairs.join(a, ka).join(b, kb).drop("asx", "asy", "bsx", "bsy")
    return out.withColumnsRenamed({"anx": "asx", "any": "asy", "bnx": "bsx", "bny": "bsy"})
