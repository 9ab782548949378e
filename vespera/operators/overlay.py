"""Unions, intersections and differences of polygons as vectors, and repair of rings that cross themselves.

Edges meet in the squares of a grid that they pass through; squares with many edges are divided again. There they are
split at crossings, touching ends and shared stretches. Pieces that lie on each other become one, with the
changes of winding number it stands for. What lies on either side of a piece follows from the pieces above its middle, which share a slab with it;
a piece stays if the set operation tells its two sides apart, directed so that the inside is on its left. Rings are
linked by pointer doubling (rings.py), at a point with several ways by the first one clockwise from where they come.

Coordinates are snapped to multiples of 2**-30 (a tenth of a millimetre, in degrees), and so are crossings. Polygons may overlap,
share edges, touch themselves and have holes; inside a polygon is what the even-odd rule says.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vespera.operators import rings
from vespera.sources.files import stored

GRID = float(1 << 30)
#: Slant of the direction that is up, so that no edge points there.
SLANT = math.sqrt(2) / 1000
#: Edges in a square that are compared without dividing it; parts on a side that a square is divided into, and how often.
CROWD, PARTS, DEPTH = 64, 4, 6
HOW = ("union", "intersection", "difference")
#: By how much winding numbers of either table change over a piece, and how many of its edges lie there.
COUNTS = ("side_a", "side_b", "n_a", "n_b")


def snapped(edges: DataFrame) -> DataFrame:
    """edges with ends on the grid; those of no length go."""
    at = lambda c: (F.round(F.col(c) * GRID) / GRID).alias(c)
    ends = ("x0", "y0", "x1", "y1")
    return edges.select(*[at(c) if c in ends else c for c in edges.columns]).filter("x0 <> x1 OR y0 <> y1")


def _squares(edges: DataFrame, size: Column) -> DataFrame:
    """edges with gx, gy of each square of a size that they pass, and perhaps of some beside."""
    low, high = F.least("x0", "x1"), F.greatest("x0", "x1")
    out = edges.withColumn("gx", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    slope = F.try_divide(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    at = lambda x: F.coalesce(F.col("y0") + (F.least(F.greatest(x, low), high) - F.col("x0")) * slope, F.col("y0"))
    a, b = at(F.col("gx") * size), at((F.col("gx") + 1) * size)
    steep = F.col("x0") == F.col("x1")
    bottom, top = F.when(steep, F.least("y0", "y1")).otherwise(F.least(a, b)), F.when(steep, F.greatest("y0", "y1")).otherwise(F.greatest(a, b))
    slack = F.lit(2 / GRID)
    return out.withColumn("gy", F.explode(F.sequence(F.floor((bottom - slack) / size), F.floor((top + slack) / size))))


def meetings(edges: DataFrame, key: list[str]) -> DataFrame:
    """key, piece, x, y: the points at which edges (key, piece, x0, y0, x1, y1) of one key meet others of it."""
    mean = edges.agg(F.avg(F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0")))).first()[0] or 1.0
    size, out, left = 2 * mean, None, edges
    for depth in range(DEPTH + 1):
        placed = stored(_squares(left, F.lit(size)), "squares")
        many = placed.groupBy(*key, "gx", "gy").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD)
        crowded = stored(placed.join(many.drop("n"), [*key, "gx", "gy"], "left_semi"), "crowded") if depth < DEPTH else None
        few = placed.join(many.drop("n"), [*key, "gx", "gy"], "left_anti") if depth < DEPTH else placed
        found = _met(few, key)
        out = found if out is None else out.unionByName(found)
        if crowded is None or not crowded.limit(1).count():
            break
        left, size = crowded.drop("gx", "gy").distinct(), size / PARTS
    return out.distinct()


def _met(placed: DataFrame, key: list[str]) -> DataFrame:
    other = placed.select(*key, "gx", "gy", *[F.col(c).alias(f"o{c}") for c in ("piece", "x0", "y0", "x1", "y1")])
    c = F.col
    pairs = placed.join(other, [*key, "gx", "gy"]).filter("piece < opiece").filter(
        (F.least("x0", "x1") <= F.greatest("ox0", "ox1")) & (F.least("ox0", "ox1") <= F.greatest("x0", "x1")) & (F.least("y0", "y1") <= F.greatest("oy0", "oy1")) & (F.least("oy0", "oy1") <= F.greatest("y0", "y1"))
    ).drop("gx", "gy").distinct()
    dx, dy, ex, ey, wx, wy = c("x1") - c("x0"), c("y1") - c("y0"), c("ox1") - c("ox0"), c("oy1") - c("oy0"), c("ox0") - c("x0"), c("oy0") - c("y0")
    across = dx * ey - dy * ex
    t, u = F.try_divide(wx * ey - wy * ex, across), F.try_divide(wx * dy - wy * dx, across)
    snap = lambda v: F.round(v * GRID) / GRID
    crossing = F.when((across != 0) & t.between(0, 1) & u.between(0, 1), F.struct(snap(c("x0") + t * dx).alias("x"), snap(c("y0") + t * dy).alias("y")))

    def on(px: str, py: str, x0: str, y0: str, x1: str, y1: str) -> Column:
        """The point if it lies on an edge, within the grid's width."""
        lx, ly = c(x1) - c(x0), c(y1) - c(y0)
        length = lx * lx + ly * ly
        along = ((c(px) - c(x0)) * lx + (c(py) - c(y0)) * ly) / length
        off = F.abs((c(px) - c(x0)) * ly - (c(py) - c(y0)) * lx) / F.sqrt(length)
        return F.when(along.between(0, 1) & (off <= 1 / GRID), F.struct(c(px).alias("x"), c(py).alias("y")))

    mine, theirs = ("x0", "y0", "x1", "y1"), ("ox0", "oy0", "ox1", "oy1")
    ends = [on("ox0", "oy0", *mine), on("ox1", "oy1", *mine), on("x0", "y0", *theirs), on("x1", "y1", *theirs)]
    # An end on the other edge is the meeting point; the crossing that is computed beside it would be a second one.
    points = F.filter(F.array(*ends), lambda p: p.isNotNull())
    points = F.when(F.size(points) > 0, points).otherwise(F.filter(F.array(crossing), lambda p: p.isNotNull()))
    both = pairs.select(*key, F.array("piece", "opiece").alias("pieces"), F.explode(points).alias("p"))
    return both.select(*key, F.explode("pieces").alias("piece"), "p.x", "p.y")


def arrangement(edges: DataFrame, key: list[str]) -> DataFrame:
    """key, x0, y0, x1, y1 and side_a, side_b, n_a, n_b: the pieces that edges (key, side, x0, y0, x1, y1) of one key cut each other into, once each and directed east (by the slant).

    side: 0 (a) or 1 (b). side_a and side_b say by how much the winding numbers above a piece exceed those below, n_a and n_b how many edges lie on it.
    """
    whole = stored(_once(snapped(edges), key).withColumn("piece", F.monotonically_increasing_id()), "edges")
    ends = whole.select(*key, "piece", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p")).select(*key, "piece", "p.x", "p.y")
    points = ends.unionByName(meetings(whole.drop(*COUNTS), key)).distinct()
    at = points.join(whole, [*key, "piece"])
    along = (F.col("x") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y") - F.col("y0")) * (F.col("y1") - F.col("y0"))
    step = W.partitionBy(*key, "piece").orderBy("along", "x", "y")
    cut = at.withColumn("along", along).select(*key, *COUNTS, "x", "y", F.lead("x").over(step).alias("x1"), F.lead("y").over(step).alias("y1")).filter("x1 IS NOT NULL")
    return _merged(cut.withColumnsRenamed({"x": "x0", "y": "y0"}), key)


def _once(edges: DataFrame, key: list[str]) -> DataFrame:
    """key, x0, y0, x1, y1 and COUNTS: edges (key, side, x0, y0, x1, y1) that lie on each other from end to end are one, so that copies of a polygon meet others once."""
    of = lambda s, v: F.when(F.col("side") == s, v).otherwise(0)
    return _merged(edges.select(*key, "x0", "y0", "x1", "y1", *[of(s, 1).cast("long").alias(f"{n}_{'ab'[s]}") for n in ("side", "n") for s in (0, 1)]), key)


def _merged(edges: DataFrame, key: list[str]) -> DataFrame:
    """Edges (key, x0, y0, x1, y1, COUNTS) directed east, with equal ones as one that has the sums of their COUNTS."""
    east = (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * SLANT > 0
    ends = [F.when(east, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))]
    counts = [(F.when(east, F.col(c)).otherwise(-F.col(c)) if c.startswith("side") else F.col(c)).alias(c) for c in COUNTS]
    return edges.select(*key, *ends, *counts).groupBy(*key, "x0", "y0", "x1", "y1").agg(*[F.sum(c).alias(c) for c in COUNTS])


def above(pieces: DataFrame, key: list[str], counts: list[str]) -> DataFrame:
    """pieces with, for each of counts, its sum over the pieces above the middle of each (up_ and the count's name)."""
    pieces = stored(pieces.withColumn("id", F.monotonically_increasing_id()), "pieces")
    flat = lambda x, y: F.col(x) + F.col(y) * SLANT
    sheared = pieces.withColumns({"a": flat("x0", "y0"), "b": flat("x1", "y1")})
    width = (sheared.agg(F.avg(F.col("b") - F.col("a"))).first()[0] or 1.0) * 2
    over = sheared.select(*key, "a", "b", F.col("y0").alias("ya"), F.col("y1").alias("yb"), *counts).withColumn("slab", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))))
    middle = sheared.select(*key, "id", ((F.col("a") + F.col("b")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my")).withColumn("slab", F.floor(F.col("mx") / width))
    high = F.col("ya") + (F.col("mx") - F.col("a")) / (F.col("b") - F.col("a")) * (F.col("yb") - F.col("ya"))
    met = middle.join(over, [*key, "slab"]).filter((F.col("a") <= F.col("mx")) & (F.col("mx") < F.col("b")) & (high > F.col("my")))
    # The pieces that lie on the middle's own piece are itself: high equals my there, up to rounding, which the id of equal ends excludes.
    sums = met.filter(~((F.col("a") + F.col("b") == 2 * F.col("mx")) & (F.col("ya") + F.col("yb") == 2 * F.col("my")))).groupBy("id").agg(*[F.sum(c).alias(f"up_{c}") for c in counts])
    return pieces.join(sums, "id", "left").drop("id").fillna(0, [f"up_{c}" for c in counts])


def _kept(pieces: DataFrame, over: Column, under: Column, key: list[str]) -> DataFrame:
    """The pieces whose sides differ, with the inside on their left."""
    out = pieces.withColumns({"over": over, "under": under}).filter("over <> under")
    turn = lambda a, b, n: F.when(F.col("over"), F.col(a)).otherwise(F.col(b)).alias(n)
    return out.select(*key, turn("x0", "x1", "x0"), turn("y0", "y1", "y0"), turn("x1", "x0", "x1"), turn("y1", "y0", "y1"))


def repaired(edges: DataFrame, key: list[str] | None = None) -> DataFrame:
    """key, x0, y0, x1, y1: of each polygon (key, poly by default) the edges around what the even-odd rule says is inside, on their left; crossings are ends, spikes and edges that lie on each other are gone."""
    key = key or ["poly"]
    pieces = arrangement(edges.select(*key, F.lit(0).alias("side"), "x0", "y0", "x1", "y1"), key).withColumn("odd", F.col("n_a") % 2).filter("odd = 1")
    out = above(pieces, key, ["odd"])
    return _kept(out, F.col("up_odd") % 2 == 1, F.col("up_odd") % 2 == 0, key)


def compared(a: DataFrame, b: DataFrame | None) -> DataFrame:
    """The pieces of the edges of polygons (poly, x0, y0, x1, y1) with how often each table covers either side of them (over_a, over_b, under_a, under_b), stored."""
    parts = [repaired(p).select(F.lit(s).alias("side"), "x0", "y0", "x1", "y1") for s, p in enumerate((a, b)) if p is not None]
    edges = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    pieces = above(arrangement(edges, []).filter("side_a <> 0 OR side_b <> 0"), [], ["side_a", "side_b"])
    # The inside is on an edge's left: where a piece above runs east, it takes away below what it adds above.
    over = {f"over_{s}": -F.col(f"up_side_{s}") for s in "ab"}
    under = {f"under_{s}": -F.col(f"up_side_{s}") - F.col(f"side_{s}") for s in "ab"}
    return stored(pieces.withColumns(over | under).select("x0", "y0", "x1", "y1", *over, *under), "compared")


def picked(pieces: DataFrame, how: str) -> DataFrame:
    """x0, y0, x1, y1: of compared pieces the edges around the union, intersection or difference (a without b), inside on their left."""
    if how not in HOW:
        raise ValueError(f"set operations are {', '.join(HOW)}")
    inside = {"union": lambda a, b: (a > 0) | (b > 0), "intersection": lambda a, b: (a > 0) & (b > 0), "difference": lambda a, b: (a > 0) & ~(b > 0)}[how]
    return _kept(pieces, inside(F.col("over_a"), F.col("over_b")), inside(F.col("under_a"), F.col("under_b")), [])


def overlay(a: DataFrame, b: DataFrame | None, how: str) -> DataFrame:
    """The edges around a set operation on polygons; without b, the union of a's own."""
    if b is None and how != "union":
        raise ValueError("one table has a union alone")
    return picked(compared(a, b), how)


def linked(edges: DataFrame, key: list[str] | None = None) -> DataFrame:
    """key, ring, seq, x, y: rings of directed edges, counter-clockwise around the inside; the last point is not the first again."""
    key = key or []
    runs = stored(edges.withColumn("run", F.monotonically_increasing_id()), "directed")
    back, out = F.atan2(F.col("y0") - F.col("y1"), F.col("x0") - F.col("x1")), F.atan2(F.col("ey") - F.col("y1"), F.col("ex") - F.col("x1"))
    begins = runs.select(*key, F.col("run").alias("next"), F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("x1").alias("ex"), F.col("y1").alias("ey"))
    turn = F.pmod(back - out, F.lit(2 * math.pi))
    links = runs.join(begins, [*key, "x1", "y1"]).groupBy("run").agg(F.min_by("next", F.when(turn < 1e-12, 2 * math.pi).otherwise(turn)).alias("next"))
    links = stored(links, "links")
    return rings.ranked(links, rings.named(links)).join(runs, "run").select(*key, "ring", "seq", F.col("x0").alias("x"), F.col("y0").alias("y"))


def area(edges: DataFrame) -> Column:
    """Of directed edges, as an aggregate."""
    return F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2


def holding(points: DataFrame, edges: DataFrame, width: float = 1.0) -> DataFrame:
    """The points (x, y, ...) inside directed edges, by the edges above each; both meet in slabs of a width."""
    spans = edges.select(*[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")]).filter("_x0 <> _x1")
    spans = spans.withColumn("_slab", F.explode(F.sequence(F.floor(F.least("_x0", "_x1") / width), F.floor(F.greatest("_x0", "_x1") / width))))
    at = points.withColumns({"_slab": F.floor(F.col("x") / width), "_id": F.monotonically_increasing_id()})
    at = stored(at, "points")
    high = F.col("_y0") + (F.col("x") - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0"))
    met = at.join(spans, "_slab").filter((F.least("_x0", "_x1") <= F.col("x")) & (F.col("x") < F.greatest("_x0", "_x1")) & (high > F.col("y")))
    odd = met.groupBy("_id").agg(F.count("*").alias("_n")).filter("_n % 2 = 1").select("_id")
    return at.join(odd, "_id", "left_semi").select(*points.columns)
