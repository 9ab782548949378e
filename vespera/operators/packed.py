"""Masks as rows of bytes from boxes to map tiles: no row for a pixel anywhere.

Boxes are merged by runs: along a lattice row a box's depth is flat and then falls by one a column to its eastern edge, so the
deepest box changes at few columns, found by a sweep over the flat and falling pieces of the row's boxes. Map rows take their bytes from the nearest source row
through one vector of columns. Tiles are put together from row pieces, and coarser tiles from four finer ones.
"""

from __future__ import annotations

import gzip
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vespera.config import BitLayout
from vespera.sources.tiles import TILE

#: A box in a lattice row: source, first column, column after the last, depth before the fall.
Span = tuple[int, int, int, float]
#: A part of one: whether it falls, first column, column after the last, depth at the first column, source.
Piece = tuple[bool, int, int, float, int]


def row_runs(spans: list[Span]) -> list[tuple[int, int, int]]:
    """(first column, last column, source) of the runs of a row that the same box is deepest in; of equals the least source."""
    pieces = []
    for src, a, b, flat in spans:
        turn = max(a, math.ceil(b - 0.5 - flat))
        pieces += [(False, a, turn, flat, src)] * (turn > a) + [(True, turn, b, b - 0.5 - turn, src)] * (b > turn)
    return piece_runs(pieces)


def piece_runs(pieces: list[Piece]) -> list[tuple[int, int, int]]:
    """The runs of a row from the flat and the falling pieces of its boxes, by a sweep over their ends that holds the pieces it is in as two heaps."""
    coming, edges = sorted(pieces, key=lambda p: -p[1]), sorted({e for p in pieces for e in p[1:3]})
    flats, falls, out = [], [], []

    def won(at: int, until: int, src: int) -> None:
        if at < until and out and out[-1][1] == at - 1 and out[-1][2] == src:
            out[-1][1] = until - 1
        elif at < until:
            out.append([at, until - 1, src])

    for begin, end in zip(edges, edges[1:]):
        while coming and coming[-1][1] <= begin:
            falling, _, b, flat, src = coming.pop()
            heapq.heappush(*((falls, (-b, src, b)) if falling else (flats, (-flat, src, b))))
        for held in (flats, falls):
            while held and held[0][2] <= begin:
                heapq.heappop(held)
        # Of the falling pieces the one that ends last is deepest until the deepest flat one overtakes it, one column earlier if of equals that is the lesser source.
        cut = end if falls else begin
        if falls and flats:
            meet = falls[0][2] - 0.5 + flats[0][0]
            cut = min(end, max(begin, math.floor(meet) + (meet != math.floor(meet) or falls[0][1] < flats[0][1])))
        if falls:
            won(begin, cut, falls[0][1])
        if flats:
            won(cut, end, flats[0][1])
    return [tuple(r) for r in out]


def row_pieces(boxes: DataFrame) -> DataFrame:
    """row, falls, a, b, flat, src: the flat and the falling pieces of boxes (src, row_off, col_off, height, width) in the rows of the lattice, from column a to before b, at a as deep as flat and a half.

    Of pieces that begin, end and lie deep alike only the least source's is kept: a row has no more of them than its columns
    and depths allow, however many boxes lie over it.
    """
    c = F.col
    rows = boxes.filter("height > 0 AND width > 0").withColumn("r", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    ends = rows.select((c("r") + c("row_off")).cast("long").alias("row"), c("src").cast("long").alias("src"), c("col_off").cast("long").alias("a"), (c("col_off") + c("width")).cast("long").alias("b"), F.least(c("r"), c("height") - c("r") - 1, c("width") - 1).cast("long").alias("flat"))
    piece = lambda falls, a, b: F.struct(F.lit(falls).alias("falls"), a.alias("a"), b.alias("b"))
    turn = c("b") - 1 - c("flat")
    pieces = ends.select("row", "src", "flat", F.inline(F.array(piece(False, c("a"), turn), piece(True, turn, c("b"))))).filter("a < b")
    return pieces.groupBy("row", "falls", "a", "b", "flat").agg(F.min("src").alias("src"))


def merge_runs(boxes: DataFrame) -> DataFrame:
    """row, a, b, src: of each row of the lattice the runs of columns a to b and the box in which they lie deepest, the least of equals.

    boxes: src, row_off, col_off, height, width. A row's different pieces meet in one task; work grows with boxes and rows.
    """

    def runs(row: pa.Table) -> pa.Table:
        falls, a, b, flat, src = (row[n].to_pylist() for n in ("falls", "a", "b", "flat", "src"))
        found = piece_runs(list(zip(falls, a, b, (f + 0.5 for f in flat), src)))
        return pa.table({"row": pa.array([row["row"][0].as_py()] * len(found), pa.int64())} | {n: pa.array([r[i] for r in found], pa.int64()) for i, n in enumerate(("a", "b", "src"))})

    return row_pieces(boxes).groupBy("row").applyInArrow(runs, "row long, a long, b long, src long")  # the pieces of one row


def merged_rows(rows: DataFrame, boxes: DataFrame, width: int, size: int) -> DataFrame:
    """row and mask (width pixels of size bytes) of the lattice's rows, from rows (src, row in the box, mask) of boxes; pixels of no box are 0.

    Rows of the lattice that no box has are left out. Bytes are cut out of the winners' rows and copied whole.
    """
    at = boxes.select("src", "row_off", "col_off")
    pieces = merge_runs(boxes).join(F.broadcast(at), "src").withColumn("own", F.col("row") - F.col("row_off"))  # a row for each box
    lines = rows.select("src", F.col("row").cast("long").alias("own"), "mask")
    cut = F.substring("mask", ((F.col("a") - F.col("col_off")) * size + 1).cast("int"), ((F.col("b") - F.col("a") + 1) * size).cast("int"))
    pieces = pieces.join(lines, ["src", "own"]).select("row", "a", cut.alias("piece"))
    held = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("a", "piece"))).alias("pieces"))  # one row's bytes

    @F.arrow_udf("binary")
    def joined(lists: pa.Array) -> pa.Array:
        out = []
        for pieces in lists.to_pylist():
            line = bytearray(width * size)
            for p in pieces:
                line[p["a"] * size : p["a"] * size + len(p["piece"])] = p["piece"]
            out.append(bytes(line))
        return pa.array(out, pa.binary())

    return held.select("row", joined("pieces").alias("mask"))


def reproject_rows(rows: DataFrame, south: float, west: float, height: int, width: int, per_degree: float, zoom: int, size: int, tile: int = TILE) -> DataFrame:
    """z, row, col and mask: the map's pixel rows of a zoom from the first pixel column on that some pixel is nearest to, each the nearest of rows (row, mask; row 0 in the south, points on the grid).

    The columns are one vector for all rows; a map row finds its source row by an equi-join and its bytes by that vector. Source rows that
    are missing give no map rows.
    """
    spark, n, half = rows.sparkSession, tile * 2**zoom, 0.5 / per_degree
    north, east = south + (height - 1) / per_degree, west + (width - 1) / per_degree
    unit_x = lambda lon: (lon + 180) / 360
    unit_y = lambda lat: 0.5 - math.log((1 + math.sin(math.radians(lat))) / (1 - math.sin(math.radians(lat)))) / (4 * math.pi)
    cols = np.arange(max(0, math.floor(unit_x(west - half) * n) - 1), min(n, math.ceil(unit_x(east + half) * n) + 1))
    nearest = np.floor(((cols + 0.5) / n * 360 - 180 - west) * per_degree + 0.5).astype(np.int64)
    inside = (nearest >= 0) & (nearest < width)
    cols, nearest = cols[inside], nearest[inside]  # contiguous
    lines = spark.range(max(0, math.floor(unit_y(north + half) * n) - 1), min(n, math.ceil(unit_y(south - half) * n) + 1))
    lat = F.degrees(F.atan(F.sinh((F.lit(0.5) - (F.col("id") + 0.5) / n) * 2 * math.pi)))
    lines = lines.select(F.col("id").alias("map_row"), F.floor((lat - F.lit(float(south))) * F.lit(float(per_degree)) + 0.5).alias("row"))
    first = int(cols[0]) if len(cols) else 0

    @F.arrow_udf("binary")
    def gathered(masks: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(m.as_py(), np.uint8).reshape(-1, size)[nearest].tobytes() for m in masks], pa.binary())

    out = rows.select(F.col("row").cast("long").alias("row"), "mask").join(lines, "row")
    return out.select(F.lit(zoom).alias("z"), F.col("map_row").alias("row"), F.lit(first).cast("long").alias("col"), gathered("mask").alias("mask"))


def tiles_of_rows(rows: DataFrame, size: int, tile: int = TILE, level: int = 6) -> DataFrame:
    """z, x, y and payload of map rows (z, row, col, mask): each row is cut at the tiles' edges, and a tile stacks its lines. Tiles without a set bit have no row."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                first, last, out = r.col // tile, (r.col + len(r.mask) // size - 1) // tile, []
                for x in range(first, last + 1):
                    a, b = max(x * tile, r.col), min((x + 1) * tile, r.col + len(r.mask) // size)
                    piece = r.mask[(a - r.col) * size : (b - r.col) * size]
                    if any(piece):
                        out.append((r.z, x, r.row // tile, r.row % tile, a % tile, piece))
                yield pd.DataFrame(out, columns=["z", "x", "y", "line", "at", "piece"])

    def stacked(group: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((tile, tile * size), np.uint8)
        for line, at, piece in zip(group.line, group["at"], group.piece):
            out[line, at * size : at * size + len(piece)] |= np.frombuffer(piece, np.uint8)
        return pd.DataFrame({"z": group.z.iloc[:1].to_numpy(), "x": group.x.iloc[:1].to_numpy(), "y": group.y.iloc[:1].to_numpy(), "payload": [gzip.compress(out.tobytes(), level, mtime=0)]})

    pieces = rows.select("z", "row", "col", "mask").mapInPandas(cut, "z int, x int, y int, line int, at int, piece binary")
    return pieces.groupBy("z", "x", "y").applyInPandas(stacked, "z int, x int, y int, payload binary")  # a tile's lines


def pyramid_payloads(base: DataFrame, levels: int, layout: BitLayout, tile: int = TILE, level: int = 6) -> DataFrame:
    """z, x, y and payload of tiles and the levels above them: a tile's quarters are the ORs of two by two pixels of the four tiles below.

    Tiles are halved where they are read, so a quarter of a tile is shuffled for each; tiles without a set bit have no row, nor a part in the next level.
    """
    size = layout.bytes_per_pixel

    def halved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for p in batch.payload:
                t = np.frombuffer(gzip.decompress(p), np.uint8).reshape(tile // 2, 2, tile // 2, 2, size)
                parts.append(gzip.compress((t[:, 0, :, 0] | t[:, 0, :, 1] | t[:, 1, :, 0] | t[:, 1, :, 1]).tobytes(), 1, mtime=0))
            yield pd.DataFrame({"z": batch.z - 1, "x": batch.x // 2, "y": batch.y // 2, "right": batch.x % 2, "low": batch.y % 2, "part": parts})

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        out, half = np.zeros((tile, tile, size), np.uint8), tile // 2
        for right, low, part in zip(group.right, group.low, group.part):
            out[low * half : (low + 1) * half, right * half : (right + 1) * half] |= np.frombuffer(gzip.decompress(part), np.uint8).reshape(half, half, size)
        return pd.DataFrame({"z": group.z.iloc[:1].to_numpy(), "x": group.x.iloc[:1].to_numpy(), "y": group.y.iloc[:1].to_numpy(), "payload": [gzip.compress(out.tobytes(), level, mtime=0)]})

    out = below = base.select("z", "x", "y", "payload")
    for _ in range(levels):
        parts = below.mapInPandas(halved, "z int, x int, y int, right int, low int, part binary")
        below = parts.groupBy("z", "x", "y").applyInPandas(joined, "z int, x int, y int, payload binary")  # four parts
        out = out.unionByName(below)
    return out
