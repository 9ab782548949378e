"""Mask rasters as DataFrames: a row for each pixel row of a box, written as and read from multi-band TIFF files."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from vespera.config import BitLayout
from vespera.sources.files import mounted, stored
from vespera.sources.geodata import GEO_KEYS, METADATA, SCALE, TIEPOINT, read_tiff

FORMAT_VERSION, STRIP_ROWS = 1, 64
#: Bytes before the first strip.
HEAD = 8
#: Rows of masks: row 0 in the south, mask the row's pixels byte by byte.
ROWS = "name string, row int, mask binary"
CONTRACT = "azimuth_min_deg double, azimuth_max_deg double, azimuth_step_deg double, bit_count int, format_version int, bytes_per_pixel int"


class StripWriter:
    """A TIFF of byte bands, north up, written strip by strip: what is held is one strip, and the directory follows the data."""

    def __init__(self, file, width: int, height: int, layout: BitLayout, west: float, north: float, cell: float, rows: int = STRIP_ROWS):
        self.file, self.width, self.height, self.bands, self.rows = file, width, height, layout.bytes_per_pixel, rows
        self.strips = -(-height // rows)
        self.at, self.size = [[0] * (self.strips * self.bands) for _ in range(2)]
        number = lambda x: f"{x:.10g}"
        about = {"azimuth_min_deg": number(layout.azimuth_min), "azimuth_max_deg": number(layout.azimuth_max), "azimuth_step_deg": number(layout.step), "bit_count": number(layout.bit_count), "format_version": number(FORMAT_VERSION), "AREA_OR_POINT": "Point"}
        items = [f'<Item name="{k}">{v}</Item>' for k, v in about.items()] + [f'<Item name="DESCRIPTION" sample="{b}" role="description">mask_byte_{b}</Item>' for b in range(self.bands)]
        self.about = f"<GDALMetadata>{''.join(items)}</GDALMetadata>\0".encode()
        self.corner = (west - cell / 2, north - cell / 2, cell)
        file.write(struct.pack("<2sHI", b"II", 42, 0))

    def write(self, strip: int, pixels: np.ndarray) -> None:
        """Strip number strip from the north; pixels (row, col, byte) with its northern row first."""
        for band in range(self.bands):
            data = zlib.compress(np.ascontiguousarray(pixels[:, :, band]).tobytes(), 6)
            self.at[band * self.strips + strip], self.size[band * self.strips + strip] = self.file.tell(), len(data)
            self.file.write(data)

    def close(self) -> None:
        west, north, cell = self.corner
        keys = (1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 2, 2048, 0, 1, 4326)
        entries = {
            256: ("I", (self.width,)), 257: ("I", (self.height,)), 258: ("H", (8,) * self.bands), 259: ("H", (8,)), 262: ("H", (1,)), 273: ("I", tuple(self.at)), 277: ("H", (self.bands,)),
            278: ("I", (self.rows,)), 279: ("I", tuple(self.size)), 284: ("H", (2,)), 339: ("H", (1,) * self.bands), SCALE: ("d", (cell, cell, 0.0)), TIEPOINT: ("d", (0.0, 0.0, 0.0, west, north, 0.0)), GEO_KEYS: ("H", keys), METADATA: ("s", self.about),
        }
        ids, rows = {"H": 3, "I": 4, "d": 12, "s": 2}, b""
        for tag in sorted(entries):
            code, values = entries[tag]
            raw = values if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
            if len(raw) <= 4:
                rows += struct.pack("<HHI", tag, ids[code], len(values)) + raw.ljust(4, b"\0")
            else:
                rows += struct.pack("<HHII", tag, ids[code], len(values), self.file.tell())
                self.file.write(raw + b"\0" * (len(raw) % 2))
        directory = self.file.tell()
        self.file.write(struct.pack("<H", len(entries)) + rows + struct.pack("<I", 0))
        self.file.seek(4)
        self.file.write(struct.pack("<I", directory))


def write_masks(rows: DataFrame, boxes: DataFrame, layout: BitLayout, cell: float, folder: str, strip_rows: int = STRIP_ROWS) -> DataFrame:
    """folder/name.tif of every box (name, west, north, width, height): rows (name, row, mask), missing ones as zeros. Returns name and n_rows.

    A box's rows are sorted from the north in one task, which holds a strip at a time; folder is one that all executors share. A
    file appears whole or not at all.
    """
    n, size, folder = boxes.count(), layout.bytes_per_pixel, mounted(folder)

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}

        def begin(r) -> None:
            path = os.path.join(folder, f"{r.name}.tif")
            state.update(name=r.name, path=path, part=f"{path}.{os.getpid()}.part", seen=0, strip=0, held=np.zeros((min(strip_rows, r.height), r.width, size), np.uint8), height=r.height, width=r.width)
            state["file"] = open(state["part"], "w+b")
            state["out"] = StripWriter(state["file"], r.width, r.height, layout, r.west, r.north, cell, strip_rows)

        def flush() -> None:
            state["out"].write(state["strip"], state["held"])
            state["strip"] += 1
            left = state["height"] - state["strip"] * strip_rows
            state["held"] = np.zeros((max(0, min(strip_rows, left)), state["width"], size), np.uint8)

        def finish() -> pd.DataFrame:
            while state["strip"] * strip_rows < state["height"]:
                flush()
            state["out"].close()
            state["file"].close()
            os.replace(state["part"], state["path"])
            out = pd.DataFrame({"name": [state["name"]], "n_rows": [state["seen"]]})
            state.clear()
            return out

        for batch in batches:
            for r in batch.itertuples():
                if state and state["name"] != r.name:
                    yield finish()
                if not state:
                    begin(r)
                if r.mask is None or pd.isna(r.tiff_row):
                    continue
                while r.tiff_row >= (state["strip"] + 1) * strip_rows:
                    flush()
                state["held"][int(r.tiff_row) - state["strip"] * strip_rows] = np.frombuffer(r.mask, np.uint8).reshape(-1, size)
                state["seen"] += 1
        if state:
            yield finish()

    placed = boxes.select("name", "west", "north", "width", "height").join(rows.select("name", "row", "mask"), "name", "left").withColumn("tiff_row", F.col("height") - 1 - F.col("row"))
    dealt = placed.repartitionByRange(max(1, n), "name").sortWithinPartitions("name", "tiff_row")
    return dealt.mapInPandas(written, "name string, n_rows long")


def write_masks_in_strips(rows: DataFrame, boxes: DataFrame, layout: BitLayout, cell: float, folder: str, strip_rows: int = STRIP_ROWS) -> list[str]:
    """What write_masks writes, with a box's strips packed and written by many tasks. Returns the names, in order.

    Packed strips are stored once; a window over their sizes says where each begins in its file, and tasks write them there, in any
    order and, after a lost executor, again. A box's directory comes last, with the rename that makes the file appear whole.
    """
    size, folder = layout.bytes_per_pixel, mounted(folder)
    strips = F.explode(F.sequence(F.lit(0), F.ceil(F.col("height") / strip_rows).cast("int") - 1))
    blank = boxes.select("name", "width", "height", strips.alias("strip"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("binary").alias("mask"))
    north = F.col("height") - 1 - F.col("row")
    known = rows.select("name", "row", "mask").join(F.broadcast(boxes.select("name", "width", "height")), "name").filter((F.col("row") >= 0) & (north >= 0))  # a row for each box
    known = known.select("name", "width", "height", F.floor(north / strip_rows).cast("int").alias("strip"), (north % strip_rows).cast("int").alias("line"), "mask")

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        held = np.zeros((min(strip_rows, int(first.height) - int(first.strip) * strip_rows), int(first.width), size), np.uint8)
        for line, mask in zip(group.line, group["mask"]):
            if mask is not None:
                held[int(line)] = np.frombuffer(mask, np.uint8).reshape(-1, size)
        data = [zlib.compress(np.ascontiguousarray(held[:, :, b]).tobytes(), 6) for b in range(size)]
        return pd.DataFrame({"name": first["name"], "strip": first.strip, "band": np.arange(size, dtype=np.int32), "bytes": [len(d) for d in data], "data": data})

    parts = stored(known.unionByName(blank).groupBy("name", "strip").applyInPandas(packed, "name string, strip int, band int, bytes long, data binary"), "strips")
    before = W.partitionBy("name").orderBy("strip", "band").rowsBetween(W.unboundedPreceding, -1)
    places = parts.select("name", "strip", "band", "bytes").withColumn("at", F.coalesce(F.sum("bytes").over(before), F.lit(0)) + HEAD)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                file = os.open(os.path.join(folder, f"{r.name}.tif.part"), os.O_WRONLY | os.O_CREAT)
                try:
                    os.pwrite(file, r.data, r.at)
                finally:
                    os.close(file)
            yield pd.DataFrame({"n": [len(batch)]})

    def close(group: pd.DataFrame) -> pd.DataFrame:
        box, path = group.iloc[0], os.path.join(folder, f"{group.name.iloc[0]}.tif")
        with open(f"{path}.part", "r+b") as file:
            out = StripWriter(file, int(box.width), int(box.height), layout, box.west, box.north, cell, strip_rows)
            for strip, band, at, n in zip(group.strip, group.band, group["at"], group["bytes"]):
                out.at[band * out.strips + strip], out.size[band * out.strips + strip] = int(at), int(n)
            file.truncate(int((group["at"] + group["bytes"]).max()))
            file.seek(0, os.SEEK_END)
            out.close()
        os.replace(f"{path}.part", path)
        return pd.DataFrame({"name": [box["name"]]})

    parts.join(places.select("name", "strip", "band", "at"), ["name", "strip", "band"]).mapInPandas(write, "n long").agg(F.sum("n")).collect()
    known_boxes = places.join(F.broadcast(boxes.select("name", "west", "north", "width", "height")), "name")
    return sorted(r["name"] for r in known_boxes.groupBy("name").applyInPandas(close, "name string").collect())  # boxes of a manifest


def read_masks(spark: SparkSession, folder: str) -> DataFrame:
    """name, west, north, cell, width, height, the contract's columns, row (0 in the south) and mask of mask rasters."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch.itertuples():
                try:
                    bands, tags = read_tiff(f.content)
                    about = dict(re.findall(r'<Item name="(\w+)">([^<]*)</Item>', tags[METADATA][0].decode()))
                    head = {k: float(about[k]) for k in ("azimuth_min_deg", "azimuth_max_deg", "azimuth_step_deg")} | {k: int(about[k]) for k in ("bit_count", "format_version")}
                    cell, tie = tags[SCALE][0], tags[TIEPOINT]
                except (ValueError, KeyError, struct.error, zlib.error) as e:
                    raise ValueError(f"cannot read the mask {f.path}: {e}") from e
                n, h, w = bands.shape
                name = f.path.rsplit("/", 1)[-1].removesuffix(".tif")
                for r in range(0, h, STRIP_ROWS):
                    part = np.ascontiguousarray(bands[:, r : r + STRIP_ROWS].transpose(1, 2, 0))
                    rows = [{"name": name, "west": tie[3] + cell / 2, "north": tie[4] + cell / 2, "cell": cell, "width": w, "height": h, **head, "bytes_per_pixel": n, "row": h - 1 - (r + k), "mask": line.tobytes()} for k, line in enumerate(part)]
                    yield pd.DataFrame(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(folder).select("path", "content")
    return files.mapInPandas(read, f"name string, west double, north double, cell double, width int, height int, {CONTRACT}, row int, mask binary")


def mask_words(rows: DataFrame, layout: BitLayout) -> DataFrame:
    """name, row, col, w0, ...: the pixels of mask rows with a set bit."""
    size, words = layout.bytes_per_pixel, layout.words

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                full = np.zeros((len(r.mask) // size, words * 4), np.uint8)
                full[:, :size] = np.frombuffer(r.mask, np.uint8).reshape(-1, size)
                values = full.view("<u4")
                at = np.flatnonzero(values.any(axis=1))
                yield pd.DataFrame({"name": r.name, "row": r.row, "col": at.astype(np.int32)} | {f"w{k}": values[at, k].astype(np.int64) for k in range(words)})

    return rows.select("name", "row", "mask").mapInPandas(split, "name string, row int, col int, " + ", ".join(f"w{k} long" for k in range(words)))
