"""Binary rasters and polygons: TIFF elevation and mask files, shoreline files, shapefiles."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from vespera.config import BitLayout
from vespera.sources.tiff import BITS, COMPRESSION, GEO_KEYS, HEIGHT, METADATA, NODATA, PHOTOMETRIC, PLANAR, ROWS, SAMPLE_FORMAT, SAMPLES, SCALE, STRIP_AT, STRIP_BYTES, TIEPOINT, WIDTH, Tiff

BLOCK = 512
POLYGONS = "poly long, west double, south double, east double, north double, rings array<struct<x:array<double>,y:array<double>>>"


def read_tiff(data: bytes) -> tuple[np.ndarray, dict]:
    """The bands (band, row, col) of a TIFF file that is held whole, and its tags."""
    file = Tiff(lambda at, size: data[at : at + size])
    _, h, w = file.shape
    return file.window(0, h, 0, w), file.tags


def write_tiff(bands: np.ndarray, west: float, north: float, cell: float, metadata: dict[str, str] | None = None, point: bool = False) -> bytes:
    """A deflated TIFF in geographic coordinates, bands (band, row, col) apart; west and north bound pixel (0, 0)."""
    n, h, w = bands.shape
    kind = bands.dtype.newbyteorder("<")
    rows = max(1, min(h, (1 << 18) // max(1, w * kind.itemsize)))
    parts = [zlib.compress(np.ascontiguousarray(b[r : r + rows], kind).tobytes(), 6) for b in bands for r in range(0, h, rows)]
    sample = {"u": 1, "i": 2, "f": 3}[kind.kind]
    keys = (1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 2 if point else 1, 2048, 0, 1, 4326)
    entries = {
        WIDTH: ("I", (w,)), HEIGHT: ("I", (h,)), BITS: ("H", (kind.itemsize * 8,) * n), COMPRESSION: ("H", (8,)), PHOTOMETRIC: ("H", (1,)), SAMPLES: ("H", (n,)), ROWS: ("I", (rows,)),
        STRIP_BYTES: ("I", tuple(map(len, parts))), PLANAR: ("H", (2,)), SAMPLE_FORMAT: ("H", (sample,) * n), SCALE: ("d", (cell, cell, 0.0)), TIEPOINT: ("d", (0.0, 0.0, 0.0, west, north, 0.0)), GEO_KEYS: ("H", keys),
    }
    if metadata:
        items = "".join(f'<Item name="{k}">{v}</Item>' for k, v in metadata.items())
        entries[METADATA] = ("s", (f"<GDALMetadata>{items}</GDALMetadata>".encode() + b"\0",))
    ids = {"H": 3, "I": 4, "d": 12, "s": 2}
    entries[STRIP_AT] = ("I", (0,) * len(parts))
    pack = lambda code, values: values[0] if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
    body_at = 8 + 2 + 12 * len(entries) + 4
    spare = sum(len(pack(*e)) + 1 for e in entries.values() if len(pack(*e)) > 4)
    first = body_at + spare
    entries[STRIP_AT] = ("I", tuple(first + sum(map(len, parts[:i])) for i in range(len(parts))) if len(parts) < 64 else tuple((first + np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])).tolist()))
    head, extra = struct.pack("<2sHIH", b"II", 42, 8, len(entries)), b""
    for tag in sorted(entries):
        code, values = entries[tag]
        raw = pack(code, values)
        count = len(raw) if code == "s" else len(values)
        if len(raw) <= 4:
            head += struct.pack("<HHI", tag, ids[code], count) + raw.ljust(4, b"\0")
        else:
            head += struct.pack("<HHII", tag, ids[code], count, body_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    return head + struct.pack("<I", 0) + extra.ljust(spare, b"\0") + b"".join(parts)


def mask_tiff(mask: np.ndarray, layout: BitLayout, west: float, north: float, cell: float) -> bytes:
    """A mask (row, col, byte; row 0 in the south) as bands of bytes, north up, pixel centres on its points, with its contract as metadata."""
    number = lambda x: f"{x:.10g}"
    about = {"azimuth_min_deg": number(layout.azimuth_min), "azimuth_max_deg": number(layout.azimuth_max), "azimuth_step_deg": number(layout.step), "bit_count": number(layout.bit_count), "format_version": "1", "AREA_OR_POINT": "Point"}
    return write_tiff(np.ascontiguousarray(mask[::-1].transpose(2, 0, 1)), west - cell / 2, north - cell / 2, cell, about)


def elevation_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """south, west, size, block_r, block_c, rows, cols and pixels (float bytes) of the elevation TIFFs under a path.

    A tile is one file and one task's row; its blocks go on as rows, so joins move only blocks that are
    needed. Pixels without data are sea level. The corner is taken from the file's own coordinates.
    """

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples():
                try:
                    bands, tags = read_tiff(f.content)
                    scale, tie = tags[SCALE], tags[TIEPOINT]
                except (ValueError, KeyError, struct.error, zlib.error) as e:
                    raise ValueError(f"cannot read elevations of {f.path}: {e}") from e
                h = bands[0].astype(np.float32)
                if NODATA in tags:
                    h[h == np.float32(float(tags[NODATA][0]))] = 0
                # Files overlap their degree by a few pixels: the tile is that of the middle.
                south, west = int(np.floor(tie[4] - scale[1] * h.shape[0] / 2)), int(np.floor(tie[3] + scale[0] * h.shape[1] / 2))
                for r in range(0, h.shape[0], block):
                    for c in range(0, h.shape[1], block):
                        part = np.ascontiguousarray(h[r : r + block, c : c + block])
                        yield pd.DataFrame({"south": [south], "west": [west], "size": [h.shape[0]], "block_r": [r // block], "block_c": [c // block], "rows": [part.shape[0]], "cols": [part.shape[1]], "pixels": [part.tobytes()]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(path).select("path", "content")
    return files.mapInPandas(blocks, "south int, west int, size int, block_r int, block_c int, rows int, cols int, pixels binary")


def elevation_cells(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """south, west, r, c, h of blocks: a row for each cell, for joins of the relational tier."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples():
                h = np.frombuffer(b.pixels, np.float32)
                r, c = np.divmod(np.arange(len(h), dtype=np.int32), b.cols)
                yield pd.DataFrame({"south": b.south, "west": b.west, "r": r + b.block_r * block, "c": c + b.block_c * block, "h": h})

    return blocks.mapInPandas(cells, "south int, west int, r int, c int, h float")


def _shorelines(data: bytes) -> Iterator[tuple]:
    """Level 1 polygons of a shoreline file: headers of eleven big-endian integers, then points in micro-degrees."""
    at, first = 0, True
    while at + 44 <= len(data):
        number, n, flag, west, east, south, north = struct.unpack_from(">7i", data, at)
        if first and (number != 0 or n < 1 or flag & 255 != 1):
            raise ValueError("not a shoreline file")
        points = np.frombuffer(data, ">i4", 2 * n, at + 44).reshape(n, 2)
        if flag & 255 == 1:
            lon = lambda v: v * 1e-6 - 360.0 * (v * 1e-6 > 180.0)
            x, y = np.append(lon(points[:, 0].astype(float)), lon(float(points[0, 0]))), np.append(points[:, 1], points[0, 1]) * 1e-6
            yield number, lon(float(west)), south * 1e-6, lon(float(east)), north * 1e-6, [{"x": x.tolist(), "y": y.tolist()}]
        at, first = at + 44 + 8 * n, False
    if first:
        raise ValueError("file too short for a shoreline header")


def _shapes(data: bytes) -> Iterator[tuple]:
    """Polygons of a shapefile's main file; their rings keep the file's order."""
    if len(data) < 100 or struct.unpack_from(">i", data)[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at + 12 <= len(data):
        number, words = struct.unpack_from(">2i", data, at)
        kind = struct.unpack_from("<i", data, at + 8)[0]
        if kind in (5, 15, 25):
            west, south, east, north, parts, n = struct.unpack_from("<4d2i", data, at + 12)
            starts = [*struct.unpack_from(f"<{parts}i", data, at + 52), n]
            points = np.frombuffer(data, "<f8", 2 * n, at + 52 + 4 * parts).reshape(n, 2)
            yield number, west, south, east, north, [{"x": points[a:b, 0].tolist(), "y": points[a:b, 1].tolist()} for a, b in zip(starts, starts[1:])]
        elif kind != 0:
            raise ValueError("only polygons are read")
        at += 8 + 2 * words


def _polygons(spark: SparkSession, path: str, parse) -> DataFrame:
    names = ["poly", "west", "south", "east", "north", "rings"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples():
                try:
                    held = []
                    for p in parse(f.content):
                        held.append(p)
                        if len(held) == 500:
                            yield pd.DataFrame(held, columns=names)
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=names)
                except ValueError as e:
                    raise ValueError(f"cannot read polygons of {f.path}: {e}") from e

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, POLYGONS)


def shorelines(spark: SparkSession, path: str) -> DataFrame:
    """poly, its bounds and rings of the land polygons of shoreline files; longitudes over 180 wrap."""
    return _polygons(spark, path, _shorelines)


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """poly, its bounds and rings of shapefiles' polygons."""
    return _polygons(spark, path, _shapes)


def within(polygons: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Polygons whose bounds meet a rectangle; over a table of polygons the filter reaches the scan."""
    return polygons.filter((F.col("south") < north) & (F.col("north") > south) & (F.col("west") < east) & (F.col("east") > west))


def edges(polygons: DataFrame) -> DataFrame:
    """poly, ring, x0, y0, x1, y1 of all rings, in degrees."""
    ring = polygons.select("poly", F.posexplode("rings").alias("ring", "g")).select("poly", "ring", F.explode(F.arrays_zip("g.x", "g.y", F.slice("g.x", F.lit(2), F.size("g.x")).alias("x1"), F.slice("g.y", F.lit(2), F.size("g.y")).alias("y1"))).alias("e"))
    return ring.select("poly", "ring", F.col("e.x").alias("x0"), F.col("e.y").alias("y0"), F.col("e.x1").alias("x1"), F.col("e.y1").alias("y1")).filter("x1 IS NOT NULL")
