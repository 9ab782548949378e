"""Map tiles of masks: gzip payloads, the files of a tile set, its TileJSON document, and grey PNG images."""

from __future__ import annotations

import gzip
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from vespera.config import BitLayout
from vespera.sources.files import emptied, mounted
from vespera.sources.geodata import write_tiff

TILE, FORMAT_VERSION = 512, 1
TILEJSON = "tilejson string, tiles array<string>, format string, format_version int, scheme string, bounds array<double>, minzoom int, maxzoom int, tile_size int, azimuth_min_deg double, azimuth_max_deg double, azimuth_step_deg double, bit_count int, bytes_per_pixel int"


def pack_tiles(pixels: DataFrame, layout: BitLayout, size: int = TILE, level: int = 6) -> DataFrame:
    """z, x, y, payload of pixels (z, row, col of the level's raster, w0, ...): gzip of the tile's pixels, byte by byte.

    A tile has size * size pixels at most, so a group is bounded; tiles without a set bit have no row. Equal
    tiles have equal payloads, since no time is written.
    """
    if not 0 <= level <= 9:
        raise ValueError("gzip levels are 0 to 9")
    words, width = layout.words, layout.bytes_per_pixel

    def packed(tile: pd.DataFrame) -> pd.DataFrame:
        raster = np.zeros((size, size, words), "<u4")
        raster[tile.row.to_numpy() % size, tile.col.to_numpy() % size] = tile[[f"w{k}" for k in range(words)]].to_numpy(np.uint32)
        data = raster.view(np.uint8).reshape(size, size, words * 4)[:, :, :width].tobytes()
        return pd.DataFrame({"z": tile.z.iloc[:1].to_numpy(), "x": tile.x.iloc[:1].to_numpy(), "y": tile.y.iloc[:1].to_numpy(), "payload": [gzip.compress(data, level, mtime=0)]})

    any_bit = " OR ".join(f"w{k} <> 0" for k in range(words))
    at = pixels.filter(any_bit).withColumns({"z": F.col("z").cast("int"), "x": F.floor(F.col("col") / size).cast("int"), "y": F.floor(F.col("row") / size).cast("int")})
    return at.select("z", "x", "y", "row", "col", *[f"w{k}" for k in range(words)]).groupBy("z", "x", "y").applyInPandas(packed, "z int, x int, y int, payload binary")


def unpack_tiles(tiles: DataFrame, layout: BitLayout, size: int = TILE) -> DataFrame:
    """The pixels (z, row, col, w0, ...) with a set bit of tiles (z, x, y, payload)."""
    words, width = layout.words, layout.bytes_per_pixel

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples():
                data = np.frombuffer(gzip.decompress(t.payload), np.uint8).reshape(size, size, width)
                full = np.zeros((size, size, words * 4), np.uint8)
                full[:, :, :width] = data
                values = full.view("<u4")
                r, c = np.nonzero(values.any(axis=2))
                out = {"z": t.z, "row": r + t.y * size, "col": c + t.x * size} | {f"w{k}": values[r, c, k].astype(np.int64) for k in range(words)}
                yield pd.DataFrame(out)

    return tiles.select("z", "x", "y", "payload").mapInPandas(unpacked, "z int, row long, col long, " + ", ".join(f"w{k} long" for k in range(words)))


def write_tile_files(tiles: DataFrame, root: str) -> None:
    """root/z/x/y.bin of every tile, by the executors; root must be a folder that all of them share, and is emptied first: no tile of an earlier run stays.

    A file appears whole or not at all.
    """
    root = mounted(root)
    emptied(tiles.sparkSession, root)

    def write(rows) -> None:
        for t in rows:
            folder = os.path.join(root, str(t.z), str(t.x))
            os.makedirs(folder, exist_ok=True)
            path = os.path.join(folder, f"{t.y}.bin")
            part = f"{path}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(t.payload)
            os.replace(part, path)

    tiles.foreachPartition(write)


def read_tile_files(spark: SparkSession, root: str) -> DataFrame:
    """z, x, y, payload of a folder of tile files; filters on the ids that callers add prune after the listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bin").load(root)
    part = lambda i: F.regexp_extract("path", r"/(\d+)/(\d+)/(\d+)\.bin$", i).cast("int")
    return files.select(part(1).alias("z"), part(2).alias("x"), part(3).alias("y"), F.col("content").alias("payload"))


def tile_of(tiles: DataFrame, z: int, x: int, y: int, layout: BitLayout, size: int = TILE) -> DataFrame:
    """z, x, y, data of one tile: its bytes, or an empty tile's where there is none. The filter on the ids reaches the scan of a stored table."""
    spark = tiles.sparkSession
    wanted = spark.createDataFrame([(z, x, y)], "z int, x int, y int")
    found = tiles.filter((F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y)).select("z", "x", "y", "payload")

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            empty = bytes(size * size * layout.bytes_per_pixel)
            yield batch.assign(data=[empty if p is None else gzip.decompress(p) for p in batch.payload]).drop(columns="payload")

    return wanted.join(found, ["z", "x", "y"], "left").mapInPandas(opened, "z int, x int, y int, data binary")


def checked(minzoom: int, maxzoom: int, level: int, workers: int) -> None:
    """Raises ValueError for arguments of a tile run that make no sense."""
    if not 0 <= minzoom <= maxzoom:
        raise ValueError("zooms must be ordered and not negative")
    if not 0 <= level <= 9:
        raise ValueError("gzip levels are 0 to 9")
    if workers < 1:
        raise ValueError("at least one worker is needed")


def tilejson(layout: BitLayout, bounds: tuple[float, float, float, float], minzoom: int, maxzoom: int, size: int = TILE) -> dict:
    """The document that describes a tile set; bounds are west, south, east, north."""
    if not 0 <= minzoom <= maxzoom:
        raise ValueError("zooms must be ordered and not negative")
    about = {"tilejson": "3.0.0", "tiles": ["{z}/{x}/{y}.bin"], "format": "sunset-bitmask", "format_version": FORMAT_VERSION, "scheme": "xyz"}
    about |= {"bounds": list(bounds), "minzoom": minzoom, "maxzoom": maxzoom, "tile_size": size}
    window = {"azimuth_min_deg": layout.azimuth_min, "azimuth_max_deg": layout.azimuth_max, "azimuth_step_deg": layout.step}
    return about | window | {"bit_count": layout.bit_count, "bytes_per_pixel": layout.bytes_per_pixel}


def write_tilejson(document: dict, path: str) -> None:
    with open(mounted(path), "w") as f:
        json.dump(document, f, indent=2)


def read_tilejson(spark: SparkSession, path: str) -> DataFrame:
    """The document as one row; an unknown format version is an error."""
    row = spark.read.schema(TILEJSON).json(path, multiLine=True)
    known = F.coalesce(F.col("format_version") == FORMAT_VERSION, F.lit(False))
    return row.withColumn("format_version", F.when(known, F.col("format_version")).otherwise(F.raise_error(F.lit("unknown format version")).cast("int")))


def grey_png(pixels: np.ndarray) -> bytes:
    """A PNG file of an array of bytes, first row on top."""
    pixels = np.ascontiguousarray(pixels, np.uint8)
    h, w = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), pixels], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def slice_png(visible: np.ndarray) -> bytes:
    """visible with row 0 in the south, as a white on black image with north on top."""
    return grey_png(np.where(visible[::-1], 255, 0))


def slice_tiff(visible: np.ndarray, west: float, north: float, cell: float) -> bytes:
    """visible with row 0 in the south, as a raster of 0 and 1 with north on top; its corner is that of the box."""
    return write_tiff(visible[::-1].astype(np.uint8)[None], west, north, cell)


def rays_png(rays: DataFrame) -> bytes:
    """rays (j, verdicts as an array of booleans) of one slice as an image: a line each, 255 visible, 96 hidden, 0 past its end."""
    rows = rays.select("j", "verdicts").orderBy("j").collect()  # one slice's grid, an image's worth
    out = np.zeros((max(1, len(rows)), max([1, *(len(r.verdicts) for r in rows)])), np.uint8)
    for i, r in enumerate(rows):
        out[i, : len(r.verdicts)] = np.where(np.array(r.verdicts, bool), 255, 96)
    return grey_png(out)
