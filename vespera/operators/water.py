"""Water masks: which cells of a one-degree tile are water, and what a point there reads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vespera.operators.rasters import cover, crossings, without_cells

TILE_CELLS = 10_800


def cell_of(lat: Column, lon: Column, south: Column, west: Column, cells: int = TILE_CELLS) -> tuple[Column, Column]:
    """Row (0 in the north) and column of a point in its tile, clamped to the tile."""
    clamp = lambda c: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(cells - 1)).cast("int")
    return clamp((south + F.lit(1.0) - lat) * F.lit(cells)), clamp((lon - west) * F.lit(cells))


def pack_rows(cells: DataFrame) -> DataFrame:
    """south, west, r, words: the water cells (south, west, r, c) of each tile row as 32-bit words, the least significant bit first.

    Words are ORed before rows are put together, so a row is at most cells / 32 entries.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("c") % 32).cast("int"))
    words = cells.groupBy("south", "west", "r", F.floor(F.col("c") / 32).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits"))
    rows = words.groupBy("south", "west", "r").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"), F.max("w").alias("last"))
    full = F.transform(F.sequence(F.lit(0), F.col("last")), lambda w: F.coalesce(F.element_at("m", w), F.lit(0).cast("long")))
    return rows.select("south", "west", "r", full.alias("words"))


def tile_index(polygons: DataFrame) -> DataFrame:
    """poly, south, west of the one-degree tiles that the bounds of polygons (poly, west, south, east, north) overlap; an edge on a tile's border doesn't reach into the next."""
    return cover(polygons.select("poly", "south", "north", "west", "east")).select("poly", F.col("lat").alias("south"), F.col("lon").alias("west"))


def rasterised(edges: DataFrame, index: DataFrame, cells: int = TILE_CELLS) -> DataFrame:
    """south, west, r, words: the cells of tiles whose centres lie in polygons, as pack_rows has them; rows without any have no row.

    edges: poly, x0, y0, x1, y1 in degrees; index: poly, south, west. Polygons meet tiles by an equi-join, and a tile's row is
    set run by run, never cell by cell.
    """
    at = edges.join(index, "poly")
    px, py = lambda c: (F.col(c) - F.col("west")) * cells, lambda c: (F.col("south") + 1 - F.col(c)) * cells
    at = at.select("poly", "south", "west", px("x0").alias("x0"), py("y0").alias("y0"), px("x1").alias("x1"), py("y1").alias("y1"))
    met = crossings(at, cells, ("poly", "south", "west"))

    @F.arrow_udf("array<long>")
    def packed(rows: pa.Array) -> pa.Array:
        """Of a row's crossings, by polygon and from the west, every second pair bounds a run of water; runs of several polygons may overlap."""
        begin, flat = rows.offsets.to_numpy(), rows.values
        poly, x = flat.field("poly").to_numpy(), flat.field("x").to_numpy()
        out, bits = [], np.zeros(-(-cells // 32) * 32, np.uint8)
        for i in range(len(rows)):
            bits[:] = 0
            p, edge = poly[begin[i] : begin[i + 1]], x[begin[i] : begin[i + 1]]
            order = np.lexsort((edge, p))
            p, edge = p[order], np.ceil(edge[order] - 0.5).astype(np.int64)
            place = np.arange(len(p)) - np.searchsorted(p, p)  # among its polygon's
            first = np.flatnonzero((place[:-1] % 2 == 0) & (p[:-1] == p[1:]))
            for a, b in zip(np.clip(edge[first], 0, cells).tolist(), np.clip(edge[first + 1], 0, cells).tolist()):
                bits[a:b] = 1
            words = np.packbits(bits, bitorder="little").view("<u4")
            out.append(words.astype(np.int64) if words.any() else None)
        return pa.array(out, pa.list_(pa.int64()))

    rows = met.groupBy("south", "west", F.col("row").alias("r")).agg(F.collect_list(F.struct("poly", "x")).alias("g"))  # a row's crossings: its polygons' edges over one row of cells
    return rows.select("south", "west", "r", packed("g").alias("words")).filter("words IS NOT NULL")


def water_at(points: DataFrame, rows: DataFrame, tiles: DataFrame, cells: int = TILE_CELLS) -> DataFrame:
    """points (lat, lon, ...) with water. A tile that is not among tiles (south, west) is all water; a row without words has none."""
    out = points.withColumns({"south": F.floor("lat").cast("int"), "west": F.floor("lon").cast("int")})
    r, c = cell_of(F.col("lat"), F.col("lon"), F.col("south"), F.col("west"), cells)
    out = out.withColumns({"r": r, "__c": c}).join(rows, ["south", "west", "r"], "left")
    out = out.join(tiles.select("south", "west").distinct().withColumn("__tile", F.lit(True)), ["south", "west"], "left")
    word = F.coalesce(F.get("words", F.floor(F.col("__c") / 32).cast("int")), F.lit(0).cast("long"))
    bit = F.call_function("shiftright", word, (F.col("__c") % 32).cast("int")).bitwiseAND(F.lit(1)) == 1
    return out.select(*points.columns, F.when(F.col("__tile").isNull(), F.lit(True)).otherwise(bit).alias("water"))


def all_water(ocean: DataFrame, inland: DataFrame | None = None) -> DataFrame:
    """Polygons or cells of the ocean and, where there is a second source, of inland water."""
    return ocean if inland is None else ocean.unionByName(inland)


def tile_cells(tiles: DataFrame, cells: int = TILE_CELLS) -> DataFrame:
    """south, west, row, col of every cell of tiles (south, west)."""
    each = F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    return tiles.select("south", "west").withColumn("row", each).withColumn("col", each)


def tile_land(tiles: DataFrame, water: DataFrame, cells: int = TILE_CELLS) -> DataFrame:
    """The cells of tiles that no water cell (south, west, row, col) covers; a tile without water is land throughout."""
    return without_cells(tile_cells(tiles, cells), water, key=("south", "west", "row", "col"))
