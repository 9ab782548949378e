"""Bit contract vectors that several readers of masks can be held against, and a loader of tiles that counts its misses."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vespera.config import BitLayout
from vespera.sources.files import write_text


def bit_vectors(spark: SparkSession, layouts: dict[str, BitLayout], azimuths: list[float]) -> DataFrame:
    """config, azimuth, bit_index, byte_offset and mask of azimuths under layouts; nulls where an azimuth is outside, and the flag bit of each layout as azimuth null."""
    rows = []
    for name, layout in layouts.items():
        for a in azimuths:
            i = layout.bit_index(a)
            rows.append((name, float(a), i))
        rows.append((name, None, layout.flag_bit))
    out = spark.createDataFrame(rows, "config string, azimuth double, bit_index int")
    return out.withColumns({"byte_offset": F.shiftright("bit_index", 3), "mask": F.call_function("shiftleft", F.lit(1), F.col("bit_index").bitwiseAND(F.lit(7)))})


def write_vectors_header(spark: SparkSession, vectors: DataFrame, path: str) -> None:
    """The vectors as a C++ header: a constant array of a few rows."""
    rows = vectors.orderBy("config", F.col("azimuth").isNull(), "azimuth").collect()
    cell = lambda v: "-1" if v is None else f"{v:g}" if isinstance(v, float) else str(v)
    body = "".join(f'    {{"{r.config}", {cell(r.azimuth)}, {cell(r.bit_index)}, {cell(r.byte_offset)}, {cell(r["mask"])}}},\n' for r in rows)
    write_text(spark, path, f"#pragma once\nstruct BitVector {{ const char* config; double azimuth; int bit_index, byte_offset, mask; }};\nconstexpr BitVector kBitVectors[] = {{\n{body}}};\n")


def frozen(tiles: DataFrame, working: DataFrame, key: tuple[str, str] = ("south", "west")) -> DataFrame:
    """The tiles of a working set; tiles that are missing are left out."""
    return tiles.join(F.broadcast(working.select(*key).distinct()), list(key), "left_semi")  # a strip's one-degree tiles


class TileCache:
    """Tiles that a worker has loaded, the least recently used ones dropped; missed counts the loads, as a Spark accumulator if one is given."""

    def __init__(self, load: Callable[[tuple[int, int]], object], capacity: int = 16, misses=None):
        if capacity < 1:
            raise ValueError("a cache holds at least one tile")
        self.load, self.capacity, self.misses, self.missed, self.held = load, capacity, misses, 0, OrderedDict()

    def __call__(self, key: tuple[int, int]):
        if key not in self.held:
            self.held[key] = self.load(key)
            self.missed += 1
            if self.misses is not None:
                self.misses.add(1)
            if len(self.held) > self.capacity:
                self.held.popitem(last=False)
        self.held.move_to_end(key)
        return self.held[key]
