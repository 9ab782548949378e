"""Elevation rasters as a data source whose partitions are rows of blocks, with filters on tiles and blocks pushed down.

A partition reads the ranges of its file that its blocks need, so no task holds a file, and blocks that filters rule out are neither
read nor decoded. Files are opened through pyarrow's file systems: a path or a URI (file, s3, gs, hdfs) that driver and executors can reach.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from vespera.sources.tiff import NODATA, SCALE, TIEPOINT, Tiff

BLOCK = 512
SCHEMA = "south int, west int, block_r int, block_c int, cells int, r0 int, c0 int, rows int, cols int, pixels binary"
#: Columns that filters are pushed down for.
KEY = ("south", "west", "block_r", "block_c")
COMPARISONS = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b, In: lambda a, b: a in b}


def _opened(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    file = system.open_input_file(place)
    return file, lambda at, size: file.read_at(size, at)


def _listed(path: str) -> list[str]:
    """The .tif files of a folder by name, or the file itself."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.File:
        return [path]
    if info.type != fs.FileType.Directory:
        raise ValueError(f"no elevations at {path}")
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.File and f.extension == "tif")
    return [f"{path.rstrip('/')}/{name}" for name in names]


class Raster:
    """One elevation file: its tile, the cell of its first pixel, and windows of its cells."""

    def __init__(self, path: str):
        self.path = path
        try:
            self.file, read_at = _opened(path)
            self.tiff = Tiff(read_at)
            scale, tie = self.tiff.tags[SCALE], self.tiff.tags[TIEPOINT]
        except (OSError, ValueError, KeyError, struct.error) as e:
            raise ValueError(f"cannot read elevations of {path}: {e}") from e
        _, self.rows, self.cols = self.tiff.shape
        # Files overlap their degree by a few pixels: the tile is that of the middle.
        self.south, self.west = int(np.floor(tie[4] - scale[1] * self.rows / 2)), int(np.floor(tie[3] + scale[0] * self.cols / 2))
        self.cells = round(1 / scale[1])
        self.r0, self.c0 = round((self.south + 1 - tie[4]) / scale[1]), round((tie[3] - self.west) / scale[0])

    def cut(self, block_r: int, block_c: int, block: int, halo: int) -> tuple[int, int, np.ndarray] | None:
        """First row and column (cells of the degree) and heights of a block with halo more cells on each side where the file has them; None where it has none of the block."""
        own = lambda i, first, n: (max(i * block, first, 0), min((i + 1) * block, first + n, self.cells))
        (a, b), (c, d) = own(block_r, self.r0, self.rows), own(block_c, self.c0, self.cols)
        if a >= b or c >= d:
            return None
        a, b, c, d = max(a - halo, self.r0), min(b + halo, self.r0 + self.rows), max(c - halo, self.c0), min(d + halo, self.c0 + self.cols)
        try:
            h = self.tiff.window(a - self.r0, b - self.r0, c - self.c0, d - self.c0, [0])[0].astype(np.float32)
            nodata = self.tiff.tags.get(NODATA)
            if nodata:
                h[h == np.float32(float(nodata[0]))] = 0
        except (OSError, ValueError, struct.error, zlib.error) as e:
            raise ValueError(f"cannot read elevations of {self.path}: {e}") from e
        return a, c, h


@dataclass
class BlockRow(InputPartition):
    """A row of blocks of one file."""

    path: str
    block_r: int
    blocks: list[int]


class ElevationReader(DataSourceReader):
    def __init__(self, path: str, block: int, halo: int):
        self.path, self.block, self.halo = path, block, halo
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            if type(f) in COMPARISONS and len(f.attribute) == 1 and f.attribute[0] in KEY:
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def wanted(self, **values: int) -> bool:
        return all(COMPARISONS[test](values[name], value) for name, test, value in self.tests if name in values)

    def partitions(self) -> list[BlockRow]:
        """From the files' directories alone."""
        out = []
        for path in _listed(self.path):
            r = Raster(path)
            if not self.wanted(south=r.south, west=r.west):
                continue
            count = -(-r.cells // self.block)
            cols = [c for c in range(count) if self.wanted(block_c=c)]
            out += [BlockRow(path, i, cols) for i in range(count) if cols and self.wanted(block_r=i)]
        return out

    def read(self, partition: BlockRow) -> Iterator[tuple]:
        raster = Raster(partition.path)
        for c in partition.blocks:
            if found := raster.cut(partition.block_r, c, self.block, self.halo):
                r0, c0, h = found
                yield raster.south, raster.west, partition.block_r, c, raster.cells, r0, c0, *h.shape, np.ascontiguousarray(h).tobytes()


class ElevationSource(DataSource):
    """Options: path, block (cells on a side), halo (more cells on each side)."""

    @classmethod
    def name(cls) -> str:
        return "elevation_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ElevationReader:
        return ElevationReader(self.options["path"], int(self.options.get("block", BLOCK)), int(self.options.get("halo", 1)))


def read_elevations(spark: SparkSession, path: str, block: int = BLOCK, halo: int = 1) -> DataFrame:
    """SCHEMA of the elevation files under a path: blocks of the degree's cells, pixels (float bytes) from cell (r0, c0) on, without data 0.

    The session's Python data sources get filters from then on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ElevationSource)
    return spark.read.format("elevation_tiles").option("block", block).option("halo", halo).load(path)
