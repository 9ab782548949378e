"""One lattice for many rasters: bounds, offsets, contracts, and the map tiles that cover them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

CONTRACT = ["azimuth_min_deg", "azimuth_max_deg", "azimuth_step_deg", "bit_count", "format_version", "bytes_per_pixel"]
#: Half the side of the map's square in metres.
HALF = math.pi * 6378137.0
TILE_SIZE = 512


def bounds(sources: DataFrame) -> DataFrame:
    """One row: the western and northern ends of sources (west, south, east, north) and the other two."""
    return sources.agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))


def snap(sources: DataFrame, cell: float) -> DataFrame:
    """sources (src, west, north, height, width, ...) with row_off and col_off on their common lattice, halves to even, and the lattice's out_height and out_width."""
    edge = sources.agg(F.min("west").alias("__west"), F.max("north").alias("__north"))
    steps = lambda c: F.bround(c / F.lit(float(cell))).cast("long")
    out = sources.crossJoin(F.broadcast(edge))  # one row
    out = out.withColumns({"row_off": steps(F.col("__north") - F.col("north")), "col_off": steps(F.col("west") - F.col("__west"))}).drop("__west", "__north")
    size = out.agg(F.max(F.col("row_off") + F.col("height")).alias("out_height"), F.max(F.col("col_off") + F.col("width")).alias("out_width"))
    return out.crossJoin(F.broadcast(size))


def mismatches(sources: DataFrame, columns: list[str] = CONTRACT) -> DataFrame:
    """The sources (src, contract) whose contract differs from that of the first one, the least src."""
    first = sources.agg(F.min_by(F.struct(*columns), "src").alias("__first"))
    return sources.crossJoin(F.broadcast(first)).filter(~F.struct(*columns).eqNullSafe(F.col("__first"))).drop("__first")


def unlike(sources: DataFrame, columns: list[str] = CONTRACT) -> DataFrame:
    """src and why: what of a source (src, contract, crs, cell_x, cell_y) is not as in the first one: its contract, else its reference system, else a cell's side by more than a millionth of the larger."""
    own = [*columns, "crs", "cell_x", "cell_y"]
    first = sources.agg(F.min_by(F.struct(*own), "src").alias("__first"))
    out = sources.crossJoin(F.broadcast(first))  # one row
    other = lambda c: F.col(f"__first.{c}")
    apart = lambda c: ~F.coalesce(F.abs(F.col(c) - other(c)) <= F.greatest(F.abs(c), F.abs(other(c))) * 1e-6, F.lit(False))
    contract = ~F.struct(*columns).eqNullSafe(F.struct(*[other(c).alias(c) for c in columns]))
    why = F.when(contract, "contract").when(~F.col("crs").eqNullSafe(other("crs")), "crs").when(apart("cell_x") | apart("cell_y"), "cell")
    return out.select("src", why.alias("why")).filter("why IS NOT NULL")


def same_contract(sources: DataFrame, columns: list[str] = CONTRACT) -> DataFrame:
    """sources, an error where one differs from the first."""
    first = sources.agg(F.min_by(F.struct(*columns), "src").alias("__first"))
    out = sources.crossJoin(F.broadcast(first))
    wrong = F.raise_error(F.concat(F.lit("unlike the first in its bit layout: source "), F.col("src").cast("string"))).cast("string")
    return out.filter(F.when(F.struct(*columns).eqNullSafe(F.col("__first")), F.lit("")).otherwise(wrong) == "").drop("__first")


def rectangle(boxes: DataFrame, margin: float = 1.0) -> DataFrame:
    """One row: the rectangle around boxes (north, west, south, east) with a margin in degrees."""
    around = bounds(boxes)
    return around.select(*[(F.col(c) + F.lit(margin if c in ("east", "north") else -margin)).alias(c) for c in ("west", "south", "east", "north")])


def overlapping(polygons: DataFrame, area: DataFrame) -> DataFrame:
    """The polygons whose bounds meet a one-row rectangle."""
    of = area.select(*[F.col(c).alias(f"__{c}") for c in ("west", "south", "east", "north")])
    meets = (F.col("west") <= F.col("__east")) & (F.col("east") >= F.col("__west")) & (F.col("south") <= F.col("__north")) & (F.col("north") >= F.col("__south"))
    return polygons.crossJoin(F.broadcast(of)).filter(meets).select(*polygons.columns)


def curve_key(lat: Column, lon: Column, bits: int = 16) -> Column:
    """Place of a point along a curve that fills the map: the bits of both coordinates by turns (Morton order), so near points mostly have near places."""
    part = lambda v, span: F.least(F.greatest(F.floor((v / span + 0.5) * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")

    def spread(v: Column) -> Column:
        """The bits of a number of up to 32 bits, an empty place behind each."""
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(part(lon, 360.0)).bitwiseOR(F.shiftleft(spread(part(lat, 180.0)), 1))


def store_by_curve(polygons: DataFrame, path: str, files: int) -> None:
    """polygons (west, south, east, north, ...) as a table in the order of their middles along the curve, in so many files: the bounds of a row group are then a small part of the map, and filters on them skip the others."""
    middle = curve_key((F.col("south") + F.col("north")) / 2, (F.col("west") + F.col("east")) / 2)
    dealt = polygons.withColumn("__curve", middle).repartitionByRange(files, "__curve").sortWithinPartitions("__curve").drop("__curve")
    dealt.write.option("parquet.block.size", 1 << 20).parquet(path)


def metres(lat: Column, lon: Column) -> tuple[Column, Column]:
    """x and y of a point on the map, in metres."""
    s = F.sin(F.radians(lat))
    return lon / 180 * F.lit(HALF), F.log((1 + s) / (1 - s)) / 2 * F.lit(6378137.0)


def tile_range(sources: DataFrame, zoom: int) -> DataFrame:
    """sources (west, south, east, north in metres) with tx_min, tx_max, ty_min, ty_max: the map tiles they cover.

    Eastern and southern ends that fall on a tile's edge, to a billionth of a tile, don't reach into the next one.
    """
    side, last = 2 * HALF / 2**zoom, 2**zoom - 1
    slack = side * 1e-9
    index = lambda c: F.floor(c / F.lit(side))
    low, high = lambda c: F.greatest(c, F.lit(0)).cast("int"), lambda c: F.least(c, F.lit(last)).cast("int")
    return sources.withColumns({
        "tx_min": low(index(F.col("west") + F.lit(HALF))), "tx_max": high(index(F.col("east") + F.lit(HALF - slack))),
        "ty_min": low(index(F.lit(HALF) - F.col("north"))), "ty_max": high(index(F.lit(HALF - slack) - F.col("south"))),
    })


def base_raster(ranges: DataFrame, zoom: int, size: int = TILE_SIZE) -> DataFrame:
    """ranges (tx_min, ...) with the raster of whole tiles that holds them: its bounds in metres, width and height in pixels."""
    side = 2 * HALF / 2**zoom
    span = lambda a, b: ((F.col(b) - F.col(a) + 1) * size).cast("long")
    edge = lambda c, more, sign: F.lit(-sign * HALF) + sign * (F.col(c) + more) * F.lit(side)
    return ranges.withColumns({
        "x_min": edge("tx_min", 0, 1), "x_max": edge("tx_max", 1, 1), "y_max": edge("ty_min", 0, -1), "y_min": edge("ty_max", 1, -1),
        "width": span("tx_min", "tx_max"), "height": span("ty_min", "ty_max"),
    })
