"""Leaders of labelled points: the lexicographically first independent set within a radius, in rounds over a grid."""

from __future__ import annotations

from functools import reduce
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.plans.checkpoint import sized_broadcast, written

#: Cells away in which a point within the radius can lie, when a cell's diagonal is the radius.
REACH = 2


def _around(cells: DataFrame, *columns: Column) -> DataFrame:
    """cells (_l, _n, _i, _j, ...) once for each cell around theirs, which takes the place of their own; columns go along."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-REACH, REACH + 1) for j in range(-REACH, REACH + 1)])
    return cells.select("_l", "_n", "_i", "_j", *columns, F.explode(steps).alias("_s")).select("_l", "_n", (F.col("_i") + F.col("_s.i")).alias("_i"), (F.col("_j") + F.col("_s.j")).alias("_j"), *[c for c in cells.columns if c.startswith("lead_")])


def independent_leaders(points: DataFrame, radius: float) -> tuple[DataFrame, DataFrame]:
    """(points with their cell, leaders): in ord order a point leads its label if no earlier leader is within radius.

    points: ord (unique in a label), label, x, y. Cells are so small that two points of one are within the radius, so a cell has
    one leader at most, and in a round only its first open point can lead: it does if no open point of the cells around is
    earlier. Then all open points near a new leader are closed. A round is a minimum for each cell, a join of cells, and a join of
    the points with the few new leaders; the earliest open point leads in every round, and all that are earliest around
    themselves do. Rounds are as many as the longest chain of neighbouring cells that wait for each other.
    """
    if radius <= 0:
        raise ValueError("the radius must be positive")
    side = radius / sqrt(2)
    cell = lambda c: F.floor(F.col(c) / side).alias
    rows = points.select("ord", "label", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = rows.where("abs(x) < 1e15 and abs(y) < 1e15")
    rows = rows.select("*", F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_l"), F.col("label").isNull().alias("_n"), cell("x")("_i"), cell("y")("_j"))
    rows = written(rows, "points")
    at, here = ["_l", "_n", "_i", "_j"], rows.select("ord", "x", "y", "_l", "_n", "_i", "_j")
    found, still = [], here
    while True:
        first = written(still.groupBy(*at).agg(F.min_by(F.struct("ord", "x", "y"), "ord").alias("_p")).select(*at, F.col("_p.ord").alias("lead_ord"), F.col("_p.x").alias("lead_x"), F.col("_p.y").alias("lead_y")), "first")
        if first.isEmpty():
            break
        near = _around(first, F.col("lead_ord"), F.col("lead_x"), F.col("lead_y")).groupBy(*at).agg(F.min("lead_ord").alias("_least"))
        new = written(first.join(near, at).where("lead_ord = _least").drop("_least"), "leaders")
        found.append(new)
        if len(found) == 16:  # a long chain must not grow the plan
            found = [written(reduce(DataFrame.unionByName, found), "leaders")]
        spread = sized_broadcast(written(_around(new, F.col("lead_ord"), F.col("lead_x"), F.col("lead_y")), "spread"))
        still = written(still.join(spread, [*[still[c] == spread[c] for c in at], _within(still, spread, radius)], "left_anti"), "open")
    empty = [F.lit(None).cast(here.schema[c].dataType).alias(n) for c, n in (("ord", "lead_ord"), ("x", "lead_x"), ("y", "lead_y"))]
    return rows, reduce(DataFrame.unionByName, found) if found else here.select(*at, *empty)


def _within(points: DataFrame, leaders: DataFrame, radius: float) -> Column:
    dx, dy = points["x"] - leaders["lead_x"], points["y"] - leaders["lead_y"]
    return dx * dx + dy * dy < radius * radius


def label_leaders(points: DataFrame, radius: float = 4.0, size: float = 0.5, step: float = 0.25) -> DataFrame:
    """(label, x, y, size): in ord order, a point within radius of a leader of its label enlarges the first such, else it leads.

    points: ord, label, x, y. Null labels are a label of their own; points without both coordinates, or beyond
    1e15, are left out. Points meet
    only leaders of the cells around, of which there are at most 25, so a label with most of the points, or many points in
    one place, are dealt over tasks.
    """
    rows, leaders = independent_leaders(points, radius)
    leaders = written(leaders, "all-leaders")
    around = sized_broadcast(written(_around(leaders, F.col("lead_ord"), F.col("lead_x"), F.col("lead_y")), "around"))
    at = ["_l", "_n", "_i", "_j"]
    hit = rows.join(around, [*[rows[c] == around[c] for c in at], _within(rows, around, radius)])
    # A leader is nearest to itself; others count for the first leader that is near them.
    owner = hit.groupBy(rows["_l"], rows["_n"], rows["ord"]).agg(F.min("lead_ord").alias("lead_ord"))
    grown = owner.groupBy("_l", "_n", "lead_ord").agg((F.count(F.lit(1)) - 1).alias("_more"))
    named = rows.select("_l", "_n", F.col("ord").alias("lead_ord"), "label", "x", "y")
    return named.join(sized_broadcast(written(grown, "grown")), ["_l", "_n", "lead_ord"]).select("label", "x", "y", (F.lit(float(size)) + F.lit(float(step)) * F.col("_more")).alias("size"))
