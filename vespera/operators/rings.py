"""Polygons around sets of cells: boundaries as rings, each hole with the polygon it lies in.

A cell's sides run around it with the cell on their left; a side that two cells share is none. Sides that go on straight are put
together to runs. A run leads to the run that starts where it ends, to the left where there are two: cells that touch at a corner alone
belong to different polygons, and a hole may touch itself there. Rings are found by pointer doubling: in every round a run learns
the least run among twice as many successors, so a ring's runs know its name after as many joins as its length has binary
digits, and their places in it after as many again. No ring is followed in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from vespera.sources.files import stored

EAST, NORTH, WEST, SOUTH = range(4)


def sides(cells: DataFrame) -> DataFrame:
    """line, at, way: the sides of cells (row, col) that bound them; horizontal ones lie on line y = line from x = at, vertical ones on x = line from y = at."""
    side = lambda line, at, way: F.struct(F.lit(way % 2).alias("axis"), line.cast("long").alias("line"), at.cast("long").alias("at"), F.lit(way).alias("way"))
    r, c = F.col("row"), F.col("col")
    each = cells.select("row", "col").distinct().select(F.explode(F.array(side(r, c, EAST), side(c + 1, r, NORTH), side(r + 1, c, WEST), side(c, r, SOUTH))).alias("s")).select("s.*")
    return each.groupBy("axis", "line", "at").agg(F.count("*").alias("n"), F.min("way").alias("way")).filter("n = 1").select("line", "at", "way")


def straight_runs(bounds: DataFrame) -> DataFrame:
    """run (its id), way, x0, y0, x1, y1 of sides that go on straight; the ids of runs are in the order of y0, x0 and way."""
    island = F.col("at") - F.row_number().over(W.partitionBy("line", "way").orderBy("at"))
    runs = bounds.withColumn("island", island).groupBy("line", "way", "island").agg(F.min("at").alias("a"), (F.max("at") + 1).alias("b"))
    begin, end = F.when(F.col("way").isin(EAST, NORTH), F.col("a")).otherwise(F.col("b")), F.when(F.col("way").isin(EAST, NORTH), F.col("b")).otherwise(F.col("a"))
    flat = F.col("way").isin(EAST, WEST)
    out = runs.select("way", F.when(flat, begin).otherwise(F.col("line")).alias("x0"), F.when(flat, F.col("line")).otherwise(begin).alias("y0"), F.when(flat, end).otherwise(F.col("line")).alias("x1"), F.when(flat, F.col("line")).otherwise(end).alias("y1"))
    return out.select((F.shiftleft("y0", 34) + F.shiftleft("x0", 2) + F.col("way")).alias("run"), "*")


def successors(runs: DataFrame) -> DataFrame:
    """runs with next: the run that starts where a run ends, to the left if there are two."""
    begins = runs.select(F.col("run").alias("next"), F.col("way").alias("then"), F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    right = F.col("then") != (F.col("way") + 1) % 4
    return runs.join(begins, ["x1", "y1"]).groupBy(*runs.columns).agg(F.min_by("next", right).alias("next"))


def named(links: DataFrame) -> DataFrame:
    """run and ring, the least run of the cycle, of links (run, next)."""
    state = stored(links.select("run", F.col("next").alias("jump"), F.least("run", "next").alias("least")), "ring-names")
    while True:
        ahead = state.select(F.col("run").alias("jump"), F.col("jump").alias("far"), F.col("least").alias("other"))
        state = stored(state.join(ahead, "jump").select("run", F.col("far").alias("jump"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("moved")), "ring-names")
        if not state.filter("moved").limit(1).count():
            return state.select("run", F.col("least").alias("ring"))
        state = state.drop("moved")


def ranked(links: DataFrame, names: DataFrame) -> DataFrame:
    """run, ring and seq, the place in the ring from its least run on."""
    start = F.col("run") == F.col("ring")
    state = stored(links.select("run", "next").join(names, "run").select("run", "ring", F.when(~start, F.col("next")).alias("jump"), F.when(start, 0).otherwise(1).cast("long").alias("left")), "ring-places")
    while state.filter("jump IS NOT NULL").limit(1).count():
        ahead = state.select(F.col("run").alias("jump"), F.col("jump").alias("far"), F.col("left").alias("more"))
        state = stored(state.join(ahead, "jump", "left").select("run", "ring", F.col("far").alias("jump"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "ring-places")
    length = state.groupBy("ring").agg(F.count("*").alias("n"))
    return state.join(length, "ring").select("run", "ring", F.when(F.col("left") == 0, F.lit(0)).otherwise(F.col("n") - F.col("left")).cast("long").alias("seq"))


def ring_points(cells: DataFrame) -> DataFrame:
    """ring, seq, x, y: the corners of the rings around cells (row, col), counter-clockwise around polygons and clockwise around holes; the last is not the first again."""
    links = stored(successors(straight_runs(sides(cells))), "runs")
    return ranked(links, named(links)).join(links, "run").select("ring", "seq", F.col("x0").alias("x"), F.col("y0").alias("y"), "run", "way", "x1", "y1")


def areas(points: DataFrame) -> DataFrame:
    """ring, corners and area of ring_points; a hole's area is negative."""
    return points.groupBy("ring").agg(F.count("*").alias("corners"), (F.sum(F.col("x") * F.col("y1") - F.col("x1") * F.col("y")) / 2).alias("area"))


def owners(points: DataFrame) -> DataFrame:
    """ring and poly: for each ring the outer ring of its polygon.

    West of a hole's westernmost side is the polygon, up to the next side in the same row: that one's ring is the outer one or another hole
    of the same polygon, which is farther west. Pointers from hole to hole are doubled until all are outer rings.
    """
    size = areas(points)
    upright = points.filter(F.col("way").isin(NORTH, SOUTH)).withColumn("row", F.explode(F.sequence(F.least("y", "y1"), F.greatest("y", "y1") - 1)))
    west = upright.withColumn("beside", F.lag("ring").over(W.partitionBy("row").orderBy("x")))
    holes = west.join(size.filter("area < 0").select("ring"), "ring").groupBy("ring").agg(F.min_by("beside", F.struct("x", "row")).alias("jump"))
    outer = size.filter("area > 0").select("ring", F.col("ring").alias("jump"))
    state = stored(outer.unionByName(holes), "ring-owners")
    while True:
        ahead = state.select(F.col("ring").alias("jump"), F.col("jump").alias("far"))
        after = stored(state.join(ahead, "jump").select("ring", F.col("far").alias("jump"), (F.col("far") != F.col("jump")).alias("moved")), "ring-owners")
        if not after.filter("moved").limit(1).count():
            return after.select("ring", F.col("jump").alias("poly"))
        state = after.drop("moved")


def polygons_of(cells: DataFrame, cell: float = 1.0, west: float = 0.0, south: float = 0.0) -> DataFrame:
    """poly, ring (0 outside, then its holes), x, y: arrays of closed rings around cells (row, col; row 0 in the south), in degrees. A ring is a row, as in any table of polygons."""
    points = stored(ring_points(cells), "ring-points")
    pair = F.struct("seq", (F.col("x") * F.lit(cell) + F.lit(west)).alias("x"), (F.col("y") * F.lit(cell) + F.lit(south)).alias("y"))
    rings = points.groupBy("ring").agg(F.sort_array(F.collect_list(pair)).alias("p")).join(owners(points), "ring")
    closed = lambda c: F.concat(F.col(f"p.{c}"), F.array(F.get(f"p.{c}", F.lit(0))))
    number = F.row_number().over(W.partitionBy("poly").orderBy(F.col("ring") != F.col("poly"), "ring")) - 1
    return rings.select("poly", number.cast("int").alias("ring"), closed("x").alias("x"), closed("y").alias("y"))
