"""Exact nearest neighbours of points in few dimensions, by joins on cells sized to the data.

Cells are halved wherever they hold many points, so a point's cell tells how dense its surroundings
are.  The points of its cell and a few of the cell around it give a distance within which the wanted
neighbours lie for sure; then one join meets each point with all others inside that distance, on
cells as wide as the distance's ball.  Work grows with the number of points: a point in thin
surroundings may meet a dense cell, but a cell has only few such points around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.sources.warehouse import store

#: Points a cell may hold before it is halved in every dimension, and how often a cell can be halved.
CELL_POINTS, DEEPEST = 32, 48
#: Rounding must not lose a point on the edge of a ball.
EDGE = 1 + 1e-9


def gap(a: str, b: str) -> str:
    """Squared distance of two arrays, dimension by dimension."""
    return f"aggregate(zip_with({a}, {b}, (s, t) -> (s - t) * (s - t)), 0D, (s, t) -> s + t)"


class Grid:
    """Cells of the points' bounding cube; level n halves its edge n times."""

    def __init__(self, points: DataFrame):
        self.dims = points.agg(F.max(F.size("x"))).first()[0] or 0
        ends = points.agg(*[F.min(F.col("x")[j]) for j in range(self.dims)], *[F.max(F.col("x")[j]) for j in range(self.dims)]).first() if self.dims else ()
        self.low = list(ends[: self.dims])
        self.width = max((b - a for a, b in zip(ends[: self.dims], ends[self.dims :])), default=0.0)

    def place(self, value: Column, dim: int, level: Column) -> Column:
        """Monotone in the value, so whatever lies between two values has a place between theirs."""
        return F.floor((value - F.lit(self.low[dim])) * F.pow(F.lit(2.0), level) / F.lit(self.width)).cast("long")

    def cell(self, level: Column) -> Column:
        return F.array(*[self.place(F.col("x")[j], j, level) for j in range(self.dims)])


def with_reach(points: DataFrame, k: int, grid: Grid, folder: str) -> DataFrame:
    """points with ``reach2``: the square of a distance within which each has k others (or all there are)."""
    whole = grid.dims * grid.width**2 * EDGE
    active, around, done = points, None, None
    for level in range(DEEPEST + 1):
        celled = store(active.withColumn("cell", grid.cell(F.lit(level))), folder, f"level{level}")
        counts = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        small = counts.filter(F.col("n") <= CELL_POINTS) if level < DEEPEST else counts
        first = F.row_number().over(Window.partitionBy("cell").orderBy("tie", "vid"))
        some = celled.withColumn("_rn", first).filter(F.col("_rn") <= max(CELL_POINTS, k + 1))
        own = some.groupBy("cell").agg(F.collect_list(F.struct("vid", "x")).alias("inside"))
        leaf = celled.join(small.select("cell"), "cell").join(own, "cell")
        if around is not None:
            leaf = leaf.withColumn("up", F.transform("cell", lambda c: F.shiftright(c, 1)))
            leaf = leaf.join(around.select(F.col("cell").alias("up"), F.col("inside").alias("outside")), "up", "left")
        else:
            leaf = leaf.withColumn("outside", F.lit(None).cast("array<struct<vid: string, x: array<double>>>"))
        gaps = F.expr(f"array_sort(transform(filter(array_distinct(concat(inside, coalesce(outside, array()))), p -> p.vid <> vid), p -> {gap('x', 'p.x')}))")
        reach = F.coalesce(F.try_element_at(gaps, F.lit(k)), F.lit(whole))
        found = leaf.select("vid", "x", "tie", reach.alias("reach2"))
        done = found if done is None else done.unionByName(found)
        active = celled.join(counts.filter(F.col("n") > CELL_POINTS).select("cell"), "cell").drop("cell")
        around = own.select("cell", F.slice("inside", 1, k + 1).alias("inside"))
        if level == DEEPEST or counts.filter(F.col("n") > CELL_POINTS).isEmpty():
            break
    return store(done, folder, "reach")


def candidate_pairs(searching: DataFrame, points: DataFrame, k: int, folder: str) -> DataFrame:
    """(vid, other, tie, gap): every pair within the searching point's reach."""
    grid = Grid(points)
    if not grid.width:
        empty = points.select("vid", F.col("vid").alias("other"), "tie", F.lit(0.0).alias("gap"))
        return empty.limit(0)
    reached = with_reach(points, k, grid, folder).join(searching.select("vid"), "vid", "left_semi")
    reach = F.sqrt("reach2") * EDGE
    level = F.least(F.lit(DEEPEST), F.greatest(F.lit(0), F.floor(F.log2(F.lit(grid.width) / (2 * reach))).cast("int")))
    asked = reached.withColumns({"level": level, "reach": reach})
    for j in range(grid.dims):
        low = grid.place(F.col("x")[j] - F.col("reach"), j, F.col("level"))
        high = grid.place(F.col("x")[j] + F.col("reach"), j, F.col("level"))
        last = F.pow(F.lit(2.0), F.col("level")).cast("long")
        asked = asked.withColumn(f"c{j}", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), low), F.least(last, high))))
    asked = asked.select("vid", F.col("x").alias("a"), "reach2", "level", F.array(*[f"c{j}" for j in range(grid.dims)]).alias("cell"))
    asked = store(asked, folder, "asked")
    levels = [r["level"] for r in asked.select("level").distinct().collect()]  # at most one for each halving
    others = points.select(F.col("vid").alias("other"), "x", "tie", F.explode(F.array(*[F.lit(v) for v in levels])).alias("level")) if levels else points.limit(0).select(
        F.col("vid").alias("other"), "x", "tie", F.lit(0).alias("level"))
    others = others.withColumn("cell", grid.cell(F.col("level"))).withColumnRenamed("x", "b")
    met = asked.join(others, ["level", "cell"]).filter("vid <> other").withColumn("gap", F.expr(gap("a", "b")))
    return met.filter(F.col("gap") <= F.col("reach2")).select("vid", "other", "tie", "gap")


def nearest(searching: DataFrame, points: DataFrame, k: int, folder: str) -> DataFrame:
    """(vid, other, gap, place): the k nearest other points of each searching one, ties by ``tie``.

    points: vid (string), x (array of as many numbers in each, none missing, no two rows equal), tie.
    Searching ones are among them; ``gap`` is the squared distance.
    """
    order = Window.partitionBy("vid").orderBy("gap", "tie", "other")
    pairs = candidate_pairs(searching, points, k, folder)
    return pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("tie")
