"""Line of sight along rays: which samples see the sea horizon."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vespera.functions.geo import along_perp, ray_of

RAY = ("strip", "az", "j")


def verdicts(samples: DataFrame, spacing: float, curvature: float, eye: float, skip: float = 0.0, ray: tuple[str, ...] = RAY) -> DataFrame:
    """samples (ray, k, h, water) from the first land sample of their ray on, with x, the highest reach so far and visible.

    A ray without land yields nothing. Heights that are missing count as the sea's; heights below it obstruct
    like the sea but an observer stands at their own. One shuffle by ray serves the crossing and the running maximum.
    """
    whole, so_far = W.partitionBy(*ray), W.partitionBy(*ray).orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    root = math.sqrt(max(0.0, curvature))
    h = F.coalesce(F.nanvl(F.col("h").cast("double"), F.lit(0.0)), F.lit(0.0))
    out = samples.withColumn("k0", F.min(F.when(~F.col("water"), F.col("k"))).over(whole)).filter("k >= k0")
    out = out.withColumn("x", (F.col("k") - F.col("k0")) * F.lit(spacing))
    reach = F.sqrt(F.greatest(h, F.lit(0.0))) - F.col("x") * F.lit(root)
    out = out.withColumn("highest", F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("x") >= skip, reach)).over(so_far), F.lit(0.0))))
    return out.withColumn("visible", F.sqrt(F.greatest(h + F.lit(eye), F.lit(0.0))) - F.col("x") * F.lit(root) >= F.col("highest"))


def flips(judged: DataFrame, ray: tuple[str, ...] = RAY) -> DataFrame:
    """Per ray, how often visibility changes from one sample to the next."""
    before = F.lag("visible").over(W.partitionBy(*ray).orderBy("k"))
    return judged.withColumn("__b", before).groupBy(*ray).agg(F.count_if(F.col("__b").isNotNull() & (F.col("__b") != F.col("visible"))).alias("flips"))


def trace(samples: DataFrame, judged: DataFrame, target: Column, before: int, after: int, spacing: float, curvature: float, eye: float, ray: tuple[str, ...] = RAY, skip: float = 0.0) -> DataFrame:
    """A ray around its crossing: step, side, water, h, and inland x, in_skip, max_reach and obs_reach in metres and visible.

    samples are all of the ray's, judged what verdicts made of them; target picks the ray. Steps count from the crossing;
    seaward ones were never judged and are not visible. With a flat earth reaches stay unscaled.
    """
    root = math.sqrt(max(0.0, curvature))
    metres = 1 / root if root else 1.0
    own = judged.filter(target).select(*ray, "k", "k0", "x", "highest", "visible")
    crossing = own.select(*ray, "k0").distinct()
    rows = samples.filter(target).join(F.broadcast(crossing), list(ray)).withColumn("step", (F.col("k") - F.col("k0")).cast("int")).filter(F.col("step").between(-before, after))  # one ray
    out = rows.drop("k0").join(own.drop("k0"), [*ray, "k"], "left")
    h = F.coalesce(F.nanvl(F.col("h").cast("double"), F.lit(0.0)), F.lit(0.0))
    reach = F.sqrt(F.greatest(h + F.lit(eye), F.lit(0.0))) - F.col("x") * F.lit(root)
    return out.select(
        *ray, "step", F.when(F.col("step") < 0, "sea").otherwise("land").alias("side"), "water", "h", (F.col("step") * F.lit(spacing)).alias("x"),
        F.when(F.col("step") >= 0, F.col("x") < skip).alias("in_skip"), (F.col("highest") * metres).alias("max_reach"), (reach * metres).alias("obs_reach"), F.coalesce("visible", F.lit(False)).alias("visible"),
    )


def target_ray(lat: Column, lon: Column, lat0: float, lon0: float, azimuth: float, config) -> Column:
    """The ray of a strip's frame that a point takes its verdicts from, as the gather chooses it."""
    return ray_of(along_perp(lat, lon, lat0, lon0, azimuth, config)[1], F.lit(config.spacing_m))


def west_edge(samples: DataFrame, tolerance: float) -> DataFrame:
    """Of samples (box, lat, water) on a box's western edge: land count and share, land's extent, and whether the share is tolerable."""
    out = samples.groupBy("box").agg(
        F.count("*").alias("n"), F.count_if(~F.col("water")).alias("land"),
        F.min(F.when(~F.col("water"), F.col("lat"))).alias("land_min"), F.max(F.when(~F.col("water"), F.col("lat"))).alias("land_max"),
    )
    return out.withColumn("passes", F.col("land") <= F.col("n") * F.lit(tolerance))


def corners(cells: DataFrame, per_degree: int) -> DataFrame:
    """south, west, r, c and h00, h01, h10, h11: of each cell (south, west, r, c, h) its own height and those of the next column, row and both; the last ones of a tile stand for what is beyond them."""
    at = F.struct(F.col("r").alias("r"), F.col("c").alias("c"))
    back = lambda dr, dc: F.struct((F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.lit(f"h{dr}{dc}").alias("which"))
    each = cells.select("south", "west", "h", at.alias("at"), F.explode(F.array(*[back(dr, dc) for dr in (0, 1) for dc in (0, 1)])).alias("q")).filter("q.r >= 0 AND q.c >= 0")
    names = ("h00", "h01", "h10", "h11")
    out = each.groupBy("south", "west", F.col("q.r").alias("r"), F.col("q.c").alias("c")).agg(*[F.max(F.when(F.col("q.which") == n, F.col("h"))).alias(n) for n in names])
    down, right = F.col("r") < per_degree - 1, F.col("c") < per_degree - 1
    h = lambda n: F.col(n)
    beside = F.when(right, h("h01")).otherwise(h("h00"))
    below = F.when(down, h("h10")).otherwise(h("h00"))
    both = F.when(down & right, h("h11")).when(down, h("h10")).when(right, h("h01")).otherwise(h("h00"))
    return out.select("south", "west", "r", "c", "h00", beside.alias("h01"), below.alias("h10"), both.alias("h11"))


def bilinear(points: DataFrame, cells: DataFrame, per_degree: int) -> DataFrame:
    """points (lat, lon, ...) with h from the four cells (south, west, r, c, h) around them; null where there is no tile.

    Cells are area-registered with row 0 in the north; a point near a tile's edge uses the edge's cells. Each cell
    hands its height to the four squares that it is a corner of, so points meet their square in one equi-join.
    """
    y = (F.col("south") + 1 - F.col("lat")) * per_degree - 0.5
    x = (F.col("lon") - F.col("west")) * per_degree - 0.5
    inside = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(per_degree - 1.0))
    out = points.withColumns({"south": F.floor("lat").cast("int"), "west": F.floor("lon").cast("int")})
    out = out.withColumns({"__fy": inside(y), "__fx": inside(x)}).withColumns({"__r": F.floor("__fy").cast("int"), "__c": F.floor("__fx").cast("int")})
    squares = corners(cells, per_degree).withColumnsRenamed({"r": "__r", "c": "__c"} | {f"h{i}": f"__h{i}" for i in ("00", "01", "10", "11")})
    out = out.join(squares, ["south", "west", "__r", "__c"], "left")
    ty, tx = F.col("__fy") - F.col("__r"), F.col("__fx") - F.col("__c")
    top, bottom = F.col("__h00") * (1 - tx) + F.col("__h01") * tx, F.col("__h10") * (1 - tx) + F.col("__h11") * tx
    out = out.withColumn("h", (top * (1 - ty) + bottom * ty).cast("float"))
    return out.select(*[c for c in points.columns if c not in ("south", "west", "h")], "south", "west", "h")
