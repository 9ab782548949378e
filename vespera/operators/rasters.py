"""Masks of pixels: accumulation over azimuths, merging of boxes, pyramids, polygons."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from vespera.config import BitLayout
from vespera.functions.bits import bit_of
from vespera.functions.geo import interior


def accumulate(slices: DataFrame, layout: BitLayout, pixel: tuple[str, ...]) -> DataFrame:
    """slices (pixel, bit, visible) as one mask per pixel; bits outside the layout are ignored. Partial ORs run before the shuffle."""
    known = F.col("visible") & F.col("bit").between(0, layout.bit_count - 1)
    zero = F.lit(0).cast("long")
    return slices.groupBy(*pixel).agg(*[F.bit_or(F.when(known, bit_of(F.col("bit"), k)).otherwise(zero)).alias(f"w{k}") for k in range(layout.words)])


def flag_land(masks: DataFrame, layout: BitLayout, water) -> DataFrame:
    """masks with the flag bit on land and nothing on water."""
    zero = F.lit(0).cast("long")
    flag = lambda k: F.lit(1 << (layout.flag_bit % 32) if layout.flag_bit // 32 == k else 0).cast("long")
    return masks.withColumns({f"w{k}": F.when(water, zero).otherwise(F.col(f"w{k}").bitwiseOR(flag(k))) for k in range(layout.words)})


def merge_deepest(pixels: DataFrame, boxes: DataFrame, value: str) -> DataFrame:
    """row, col on the common lattice and the value of the box in which the pixel lies deepest; the first of equals wins.

    pixels: src, row, col (in the box), value; boxes: src, row_off, col_off, height, width (a row for each box).
    """
    placed = pixels.join(boxes, "src").withColumn("depth", interior(F.col("row"), F.col("col"), F.col("height"), F.col("width")))
    best = F.max_by(F.struct("src", value), F.struct(F.col("depth"), -F.col("src")))
    out = placed.groupBy((F.col("row") + F.col("row_off")).alias("row"), (F.col("col") + F.col("col_off")).alias("col")).agg(best.alias("b"))
    return out.select("row", "col", "b.src", f"b.{value}")


def pyramid(base: DataFrame, levels: int, words: list[str]) -> DataFrame:
    """z, row, col and words of a base level (z, row, col, words) and the levels above it: each pixel is the OR of the four below.

    A level is made from the one below, so each is a fourth of the last one's work.
    """
    out = level = base
    for _ in range(levels):
        level = level.groupBy((F.col("z") - 1).alias("z"), F.shiftright("row", 1).alias("row"), F.shiftright("col", 1).alias("col")).agg(*[F.bit_or(w).alias(w) for w in words])
        out = out.unionByName(level)
    return out.filter(" OR ".join(f"{w} <> 0" for w in words))


def overzoom(tiles: DataFrame, wanted: DataFrame, levels: int, size: int) -> DataFrame:
    """Pixels (x, y, row, col, value) of wanted tiles (x, y) from tiles levels above them, each source pixel repeated."""
    n = 1 << levels
    side = size >> levels
    up = wanted.withColumns({"px": F.shiftright("x", levels), "py": F.shiftright("y", levels)})
    joined = up.join(tiles.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("row").alias("sr"), F.col("col").alias("sc"), "value"), ["px", "py"])
    joined = joined.withColumns({"r0": F.col("sr") - (F.col("y") - F.col("py") * n) * side, "c0": F.col("sc") - (F.col("x") - F.col("px") * n) * side})
    joined = joined.filter(F.col("r0").between(0, side - 1) & F.col("c0").between(0, side - 1))
    step = F.sequence(F.lit(0), F.lit(n - 1))
    return joined.withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step)).select("x", "y", (F.col("r0") * n + F.col("dr")).alias("row"), (F.col("c0") * n + F.col("dc")).alias("col"), "value")


def crossings(edges: DataFrame, height: int, key: tuple[str, ...] = ("poly",)) -> DataFrame:
    """key, row, x: where edges (key, x0, y0, x1, y1 in pixels) cross the middles of the rows 0 to height - 1, a row for each."""
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.greatest(F.ceil(low - 0.5), F.lit(0)), F.least(F.ceil(high - 0.5) - 1, F.lit(height - 1))
    rows = edges.filter("y0 <> y1").withColumn("first", first.cast("int")).withColumn("last", last.cast("int")).filter("first <= last")
    rows = rows.withColumn("row", F.explode(F.sequence("first", "last")))
    x = F.col("x0") + (F.col("row") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    return rows.select(*key, "row", x.alias("x"))


def fill_runs(edges: DataFrame, height: int, width: int, key: tuple[str, ...] = ("poly",)) -> DataFrame:
    """key, row, a, b: runs of pixels a to b whose centres lie in polygons, by the even-odd rule.

    edges: key, x0, y0, x1, y1 in pixels. Each edge is expanded to the rows it crosses; of a row's sorted
    crossings, every second pair bounds a run of pixels.
    """
    met = crossings(edges, height, key).groupBy(*key, "row").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size("xs") / 2).cast("int")), lambda i: F.struct(F.get("xs", 2 * i - 2).alias("a"), F.get("xs", 2 * i - 1).alias("b")))
    runs = met.filter("size(xs) > 1").select(*key, "row", F.explode(pairs).alias("r"))
    a, b = F.greatest(F.ceil(F.col("r.a") - 0.5), F.lit(0)).cast("int"), F.least(F.ceil(F.col("r.b") - 0.5) - 1, F.lit(width - 1)).cast("int")
    return runs.select(*key, "row", a.alias("a"), b.alias("b")).filter("a <= b")


def fill(edges: DataFrame, height: int, width: int) -> DataFrame:
    """poly, row, col of the pixels whose centres lie in polygons, by the even-odd rule; edges: poly, x0, y0, x1, y1 in pixels."""
    return fill_runs(edges, height, width).select("poly", "row", F.explode(F.sequence("a", "b")).alias("col")).distinct()


def cover(boxes: DataFrame) -> DataFrame:
    """boxes (south, north, west, east) with a row for each one-degree tile (lat, lon) they touch: a range join becomes an equi-join."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(a).cast("int"), F.floor(F.col(b) - 1e-9).cast("int")))
    return boxes.withColumn("lat", cells("south", "north")).withColumn("lon", cells("west", "east"))


def touched(edges: DataFrame, height: int, width: int) -> DataFrame:
    """poly, row, col of the pixels that polygons touch at all: their interior and every cell an edge passes through.

    An edge is expanded to its rows, and in each row to the columns between its ends there.
    """
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = edges.withColumns({"first": F.greatest(F.floor(low), F.lit(0)).cast("int"), "last": F.least(F.floor(high), F.lit(height - 1)).cast("int")}).filter("first <= last")
    rows = rows.withColumn("row", F.explode(F.sequence("first", "last")))
    tall = F.col("y1") - F.col("y0")
    at = lambda y: F.when(tall == 0, F.lit(None)).otherwise(F.col("x0") + (F.least(F.greatest(y, low), high) - F.col("y0")) * F.try_divide(F.col("x1") - F.col("x0"), tall))
    a, b = at(F.col("row").cast("double")), at(F.col("row") + F.lit(1.0))
    left, right = F.coalesce(F.least(a, b), F.least("x0", "x1")), F.coalesce(F.greatest(a, b), F.greatest("x0", "x1"))
    spans = rows.select("poly", "row", F.greatest(F.floor(left), F.lit(0)).cast("int").alias("a"), F.least(F.floor(right), F.lit(width - 1)).cast("int").alias("b")).filter("a <= b")
    grazed = spans.select("poly", "row", F.explode(F.sequence("a", "b")).alias("col"))
    return grazed.union(fill(edges, height, width)).distinct()


def clip(pixels: DataFrame, inside: DataFrame, words: list[str]) -> DataFrame:
    """pixels (row, col, words) with nothing outside the cells (row, col) inside."""
    kept = inside.select("row", "col").distinct().withColumn("__in", F.lit(True))
    out = pixels.join(kept, ["row", "col"], "left")
    return out.withColumns({w: F.when(F.col("__in"), F.col(w)).otherwise(F.lit(0).cast("long")) for w in words}).drop("__in")


def reproject(pixels: DataFrame, south: float, west: float, north: float, east: float, per_degree: float, zoom: int, words: list[str], size: int = 512) -> DataFrame:
    """z, row, col and words of the map's pixels at a zoom, each the nearest of pixels (row, col; row 0 in the south, points on the grid).

    The map's rows depend on latitude alone and its columns on longitude alone, so two narrow tables and two
    equi-joins carry the pixels over; their lengths are a raster's height and width.
    """
    spark, n = pixels.sparkSession, size * 2**zoom
    half = 0.5 / per_degree
    unit_x = lambda lon: (lon + 180) / 360
    unit_y = lambda lat: 0.5 - math.log((1 + math.sin(math.radians(lat))) / (1 - math.sin(math.radians(lat)))) / (4 * math.pi)
    cols = spark.range(max(0, math.floor(unit_x(west - half) * n) - 1), min(n, math.ceil(unit_x(east + half) * n) + 1)).select(F.col("id").alias("__col"), ((F.col("id") + 0.5) / n * 360 - 180).alias("lon"))
    rows = spark.range(max(0, math.floor(unit_y(north + half) * n) - 1), min(n, math.ceil(unit_y(south - half) * n) + 1))
    lat = F.degrees(F.atan(F.sinh((F.lit(0.5) - (F.col("id") + 0.5) / n) * 2 * math.pi)))
    rows = rows.select(F.col("id").alias("__row"), lat.alias("lat"))
    nearest = lambda degrees, origin: F.floor((degrees - F.lit(float(origin))) * F.lit(float(per_degree)) + 0.5)
    rows, cols = rows.select("__row", nearest(F.col("lat"), south).alias("row")), cols.select("__col", nearest(F.col("lon"), west).alias("col"))
    out = pixels.join(rows, "row").join(cols, "col")
    return out.select(F.lit(zoom).alias("z"), F.col("__row").alias("row"), F.col("__col").alias("col"), *words)


def without_cells(cells: DataFrame, *others: DataFrame, key: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Cells that none of the others hold: the difference of polygons on the grid."""
    for other in others:
        cells = cells.join(other.select(*key), list(key), "left_anti")
    return cells
