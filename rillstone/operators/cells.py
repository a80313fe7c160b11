"""A tree of cells over points in few dimensions, made and searched by joins.

A node of too many points is cut across its longest side at quantiles, into as many parts as its size asks for, and so on
level by level. Every node has the box of its points. A search moves down with a ball around each query and keeps the
nodes whose box the ball reaches, so it meets about as many cells however many points there are. A level is a table with
one row for each node; it is sent to the tasks while it has few rows and joined by a shuffle on the node otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rillstone.functions.runtime import cut_lineage
from rillstone.functions.statistics import MOST_SENT

#: Parts of a node at most, and levels: a node's number has four bits for each level.
WAYS, LEVELS = 16, 15


@dataclass
class Level:
    """``node, n, low, high, side, cuts``: points, box, the coordinate that is cut and where; no cuts in a leaf."""

    table: DataFrame
    few: bool

    def beside(self, rows: DataFrame) -> DataFrame:
        """``rows`` with what the level says of their node; nulls if the node is of another level."""
        named = self.table.select("node", *(F.col(c).alias(f"_{c}") for c in ("n", "low", "high", "side", "cuts")))
        return rows.join(F.broadcast(named) if self.few else named, "node", "left")


@dataclass
class Cells:
    """The levels, and the points with their leaf as ``node``."""

    levels: list[Level]
    points: DataFrame
    coords: list[str]


_OF_LEVEL = ("_n", "_low", "_high", "_side", "_cuts")


def _child(node: Column, place: Column) -> Column:
    return node * WAYS + place.cast("bigint") + 1


def _place(cuts: Column, value: Column) -> Column:
    """The part a value is in: the number of cuts before it."""
    return F.size(F.filter(cuts, lambda c: c < value))


def _cut_nodes(points: DataFrame, coords: Sequence[str], capacity: int) -> DataFrame:
    """One row for each node of ``points(node, ...)``."""
    shares = [i / WAYS for i in range(1, WAYS)]
    found = points.groupBy("node").agg(
        F.count("*").alias("n"),
        F.array(*(F.min(c) for c in coords)).alias("low"),
        F.array(*(F.max(c) for c in coords)).alias("high"),
        F.array(*(F.percentile_approx(c, shares, 200) for c in coords)).alias("_cuts"),
    )
    spans = F.zip_with("high", "low", lambda a, b: a - b)
    longest = F.array_max(spans)
    side = (F.array_position(spans, longest) - 1).cast("int")
    least, most = F.get("low", F.col("side")), F.get("high", F.col("side"))
    # as many parts as the size asks for, a power of two
    parts = F.least(F.lit(WAYS), F.pow(F.lit(2), F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / F.lit(capacity))))).cast("int"))
    step = (F.lit(WAYS) / parts).cast("int")
    kept = F.filter(F.get("_cuts", F.col("side")), lambda c, i: ((i + 1) % step == 0))
    cuts = F.array_distinct(F.filter(kept, lambda c: c < most))
    # where most points share the highest value, the lowest one is cut off
    cuts = F.when(F.size(cuts) > 0, cuts).otherwise(F.array(least))
    return found.withColumn("side", side).select(
        "node", "n", "low", "high", "side", F.when((F.col("n") > capacity) & (longest > 0), cuts).alias("cuts")
    )


def grow(points: DataFrame, coords: Sequence[str], capacity: int) -> Cells:
    """Cells of at most ``capacity`` points, as far as different coordinates and the number of levels allow."""
    coords = list(coords)
    rows = todo = points.withColumn("node", F.lit(0).cast("bigint"))
    levels: list[Level] = []
    while len(levels) < LEVELS:
        table = cut_lineage(_cut_nodes(todo, coords, capacity))
        n, cut = table.agg(F.count("*"), F.count("cuts")).first()
        levels.append(Level(table, n <= MOST_SENT))
        if not cut:
            break
        rows = _down(levels[-1].beside(rows), coords).drop(*_OF_LEVEL)
        # only what has just been cut is looked at again; numbers of deeper nodes are larger
        todo = rows.filter(F.col("node") > sum(WAYS**k for k in range(len(levels))) - 1)
    return Cells(levels, cut_lineage(rows), coords)


def _down(rows: DataFrame, coords: Sequence[str]) -> DataFrame:
    """``rows`` beside a level, one level further down where their node is cut."""
    part = _child(F.col("node"), _place(F.col("_cuts"), F.get(F.array(*coords), F.col("_side"))))
    return rows.withColumn("node", F.when(F.col("_cuts").isNull(), F.col("node")).otherwise(part))


def _squared(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p * p
    return out


def _farthest(coords: Sequence[str], low: str, high: str) -> Column:
    """Squared distance to the farthest corner of a box."""
    return _squared([F.greatest(F.abs(F.col(c) - F.get(low, F.lit(i))), F.abs(F.col(c) - F.get(high, F.lit(i)))) for i, c in enumerate(coords)])


def _nearest(coords: Sequence[str], low: str, high: str) -> Column:
    """Squared distance to a box, 0 inside."""
    return _squared([
        F.greatest(F.lit(0.0), F.get(low, F.lit(i)) - F.col(c), F.col(c) - F.get(high, F.lit(i))) for i, c in enumerate(coords)
    ])


def locate(cells: Cells, rows: DataFrame, k: int) -> DataFrame:
    """``rows`` with the ``node`` of the leaf they fall into and ``within``: a distance that has more than ``k`` points,
    to the farthest corner of the smallest box with as many; null if there are not that many."""
    out = rows.withColumn("node", F.lit(0).cast("bigint")).withColumn("_w", F.lit(None).cast("double"))
    for level in cells.levels:
        met = level.beside(out)
        far = _farthest(cells.coords, "_low", "_high")
        met = met.withColumn("_w", F.when(F.col("_n") > k, F.least("_w", far)).otherwise(F.col("_w")))
        out = _down(met, cells.coords).drop(*_OF_LEVEL)
    return out.withColumn("within", F.sqrt("_w")).drop("_w")


def reached(cells: Cells, balls: DataFrame, radius: str) -> DataFrame:
    """``balls`` once for each leaf whose box is within ``radius`` of them, as ``node``; a null radius reaches all."""
    coords = cells.coords
    out = balls.withColumn("node", F.lit(0).cast("bigint"))
    r = F.col(radius)
    for level in cells.levels:
        near = F.col("_low").isNull() | r.isNull() | (_nearest(coords, "_low", "_high") <= r * r)
        value = F.get(F.array(*coords), F.col("_side"))
        first = F.when(r.isNull(), F.lit(0)).otherwise(_place(F.col("_cuts"), value - r))
        last = F.when(r.isNull(), F.size("_cuts")).otherwise(_place(F.col("_cuts"), value + r))
        parts = F.transform(F.sequence(first, last), lambda p: _child(F.col("node"), p))
        down = F.when(F.col("_cuts").isNull(), F.array("node")).otherwise(parts)
        out = level.beside(out).filter(near).withColumn("node", F.explode(down)).drop(*_OF_LEVEL)
    return out
