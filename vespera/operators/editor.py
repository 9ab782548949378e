"""Boxes as they are drawn and clicked, and the azimuth that a date shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vespera.config import BitLayout
from vespera.functions.bits import bit_index
from vespera.functions.geo import sunset_azimuths
from vespera.operators.rasters import cover

SLIVER = 1e-4


def drawn(corners: DataFrame) -> DataFrame:
    """corners (lat_a, lon_a, lat_b, lon_b, ...) of drags in any direction as north, west, south, east, to six places; slivers are none."""
    at = lambda pick, c: F.round(pick(f"{c}_a", f"{c}_b"), 6)
    out = corners.withColumns({"north": at(F.greatest, "lat"), "west": at(F.least, "lon"), "south": at(F.least, "lat"), "east": at(F.greatest, "lon")})
    return out.filter((F.col("north") - F.col("south") > SLIVER) & (F.col("east") - F.col("west") > SLIVER)).drop("lat_a", "lon_a", "lat_b", "lon_b")


def box_name(index: Column, digits: int = 3) -> Column:
    """box_ and the index in at least so many digits."""
    text = index.cast("string")
    return F.concat(F.lit("box_"), F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text))


def clicked(clicks: DataFrame, boxes: DataFrame) -> DataFrame:
    """clicks (click, lat, lon) with box, the smallest of boxes (box_idx, north, west, south, east) that holds them, the first of equals; null for none.

    Boxes are listed under the one-degree tiles they touch, so clicks meet them by an equi-join.
    """
    area = (F.col("north") - F.col("south")) * (F.col("east") - F.col("west"))
    listed = cover(boxes.withColumn("__north", F.col("north") + F.lit(2e-9)).withColumn("__east", F.col("east") + F.lit(2e-9)).withColumn("area", area).select(
        "box_idx", "area", "south", "west", F.col("__north").alias("north"), F.col("__east").alias("east"))).withColumnsRenamed({"lat": "__lat", "lon": "__lon"})
    at = clicks.withColumns({"__lat": F.floor("lat").cast("int"), "__lon": F.floor("lon").cast("int")})
    inside = F.col("lat").between(F.col("south"), F.col("north") - F.lit(2e-9)) & F.col("lon").between(F.col("west"), F.col("east") - F.lit(2e-9))
    met = at.join(listed, ["__lat", "__lon"]).filter(inside).groupBy("click").agg(F.min_by("box_idx", F.struct("area", "box_idx")).alias("box"))
    return clicks.join(met, "click", "left")


def shown(days: DataFrame, layout: BitLayout) -> DataFrame:
    """days (day, lat, ...) with bit: the one that a date's sunset lights, null outside the window."""
    return sunset_azimuths(days).withColumn("bit", bit_index(F.col("azimuth"), layout)).drop("azimuth")


def recoloured(days: DataFrame, layout: BitLayout, key: list[str]) -> DataFrame:
    """shown, with changes: whether the bit differs from that of the day before, so that a map is coloured anew."""
    before = W.partitionBy(*key).orderBy("day")
    out = shown(days, layout)
    return out.withColumn("changes", (F.row_number().over(before) == 1) | ~F.col("bit").eqNullSafe(F.lag("bit").over(before)))
