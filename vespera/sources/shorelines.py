"""Shoreline files by ranges: an index of polygon headers first, then the points of the polygons that are wanted.

A file is a chain: a header says how many points follow, and so where the next header is. One task per file walks the chain and reads
headers alone; the index is a table that can be kept. Points are then read by many tasks, each of a share of the bytes.
Files are opened through pyarrow's file systems, so paths may be URIs of stores that driver and executors reach.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from vespera.sources.geodata import POLYGONS

INDEX = "path string, poly long, at long, n long, west double, south double, east double, north double"
#: A header: eleven big-endian integers, of which the first seven are read; a point has eight bytes. Fixed by the format.
HEADER, POINT = 44, 8
#: Bytes that the walk reads at once, and that a task of the second step is given.
WINDOW, SHARE = 1 << 16, 16 << 20


def _opened(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def longitude(v):
    """Degrees of micro-degrees; those over 180 wrap."""
    return v * 1e-6 - 360.0 * (v * 1e-6 > 180.0)


def headers(file, size: int) -> Iterator[tuple[int, int, int, tuple[float, float, float, float]]]:
    """(number, place of the points, points, bounds) of level 1 polygons; a window holds many small polygons' headers."""
    at, held, begin = 0, b"", 0
    while at + HEADER <= size:
        if not (begin <= at and at + HEADER <= begin + len(held)):
            begin, held = at, file.read_at(min(WINDOW, size - at), at)
        number, n, flag, west, east, south, north = struct.unpack_from(">7i", held, at - begin)
        if at == 0 and (number != 0 or n < 1 or flag & 255 != 1) or n < 0:
            raise ValueError("not a shoreline file")
        if flag & 255 == 1:
            if at + HEADER + POINT * n > size:
                raise ValueError("a polygon that ends too early")
            yield number, at + HEADER, n, (longitude(float(west)), south * 1e-6, longitude(float(east)), north * 1e-6)
        at += HEADER + POINT * n
    if at == 0:
        raise ValueError("file too short for a shoreline header")


def shoreline_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """INDEX of the level 1 polygons of shoreline files."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch.path:
                try:
                    with _opened(path) as file:
                        held = []
                        for number, at, n, bounds in headers(file, file.size()):
                            held.append((path, number, at, n, *bounds))
                            if len(held) == 10_000:
                                yield pd.DataFrame(held, columns=names)
                                held = []
                        yield pd.DataFrame(held, columns=names)
                except (ValueError, OSError) as e:
                    raise ValueError(f"cannot read polygons of {path}: {e}") from e

    names = [c.split(" ")[0] for c in INDEX.split(", ")]
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInPandas(walk, INDEX)


def tile_refs(index: DataFrame) -> DataFrame:
    """index with tile_south and tile_west, a row for each one-degree tile that a polygon's bounds overlap; an edge on a tile's border doesn't reach into the next."""
    tiles = lambda a, b: F.explode(F.sequence(F.floor(a).cast("int"), F.greatest(F.floor(a), F.floor(F.col(b) - 1e-9)).cast("int")))
    return index.withColumn("tile_south", tiles("south", "north")).withColumn("tile_west", tiles("west", "east"))


def of_tiles(index: DataFrame, tiles: DataFrame) -> DataFrame:
    """The polygons of an index that tiles (south, west) need, once each."""
    wanted = tiles.select(F.col("south").alias("tile_south"), F.col("west").alias("tile_west")).distinct()
    return tile_refs(index).join(wanted, ["tile_south", "tile_west"], "left_semi").select(*index.columns).distinct()


def fetched(refs: DataFrame) -> DataFrame:
    """poly, bounds and rings of indexed polygons, from their own ranges of the files; a task gets about SHARE bytes."""
    tasks = max(1, -(-(refs.agg(F.sum("n")).first()[0] or 0) * POINT // SHARE))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, path = None, None
        for batch in batches:
            for r in batch.itertuples():
                if r.path != path:
                    if file is not None:
                        file.close()
                    file, path = _opened(r.path), r.path
                data = file.read_at(POINT * r.n, r.at)
                if len(data) < POINT * r.n:
                    raise ValueError(f"cannot read polygons of {path}: polygon {r.poly} ends too early")
                points = np.frombuffer(data, ">i4").reshape(-1, 2).astype(float)
                x, y = longitude(points[:, 0]), points[:, 1] * 1e-6
                ring = {"x": [*x.tolist(), float(x[0])], "y": [*y.tolist(), float(y[0])]}
                yield pd.DataFrame({"poly": [r.poly], "west": [r.west], "south": [r.south], "east": [r.east], "north": [r.north], "rings": [[ring]]})

    return refs.repartitionByRange(tasks, "path", "at").sortWithinPartitions("path", "at").mapInPandas(read, POLYGONS)
