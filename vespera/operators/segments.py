"""Lines of sight without a whole ray in one place: segments, their summaries, and sweeps over blocks of tiles.

A ray is cut where it leaves a tile or block. The summary of a segment is its first land sample; the highest reach from there
on, for when the ray's crossing is that sample; and its peaks, for when the crossing lies in an earlier segment. Reaches fall by the same
amount for every step that the crossing moves back, so of a segment only the samples that could be highest for some crossing are peaks: those
within SLACK of the highest beyond the skipped distance, and the ones as high inside it. Summaries are combined along the ray by a window
over segments; each segment then gets the crossing and the highest reach before it, and its verdicts follow from its own samples.
Reaches are always computed by the formula of the window over whole rays, so both agree in every bit.

A block is a square of a tile's cells with one more row and column on each side, where the tile has some. Slices (a strip and an azimuth) meet the blocks
that their rays can cross in a cogroup, so a task holds one block and the slices' numbers. What is shuffled are blocks, summaries and verdict
bits, never samples. Where there is no block, there is sea at height 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vespera.config import PipelineConfig
from vespera.operators import sweep
from vespera.operators.sweep import _half_away

#: What a sample's level may lie below the highest and still be a peak: far more than rounding, far less than any height matters.
SLACK = 1e-9
BLOCK = 512
KEY = ["south", "west", "block_r", "block_c"]
SLICE = ["box_idx", "strip", "az"]
#: Pixel rows of a slice that are gathered at once.
ROWS = 64


def _heights(h: Column) -> Column:
    return F.coalesce(F.nanvl(h.cast("double"), F.lit(0.0)), F.lit(0.0))


def summaries(samples: DataFrame, spacing: float, curvature: float, skip: float, ray: tuple[str, ...], segment: tuple[str, ...]) -> DataFrame:
    """ray, segment, k_first, k_last, first, own and peaks (k, root of the height) of samples (ray, segment, k, h, water)."""
    root, part = math.sqrt(max(0.0, curvature)), W.partitionBy(*ray, *segment)
    up = F.sqrt(F.greatest(_heights(F.col("h")), F.lit(0.0)))
    out = samples.select(*ray, *segment, "k", up.alias("up"), F.min(F.when(~F.col("water"), F.col("k"))).over(part).alias("first"), F.min("k").over(part).alias("k_first"))
    x = (F.col("k") - F.col("first")) * F.lit(spacing)
    level = F.col("up") - F.col("k") * F.lit(spacing) * F.lit(root)
    beyond = F.col("k") > F.col("k_first") + math.floor(skip / spacing) + 1
    out = out.withColumns({"level": level, "tail": F.max(F.when(beyond, level)).over(part)})
    peak = F.col("tail").isNull() | (F.col("level") >= F.col("tail") - SLACK)
    return out.groupBy(*ray, *segment).agg(
        F.min("k").alias("k_first"), F.max("k").alias("k_last"), F.min("first").alias("first"),
        F.max(F.when((F.col("k") >= F.col("first")) & (x >= skip), F.col("up") - x * F.lit(root))).alias("own"),
        F.collect_list(F.when(peak, F.struct("k", "up"))).alias("peaks"),
    )


def entering(parts: DataFrame, spacing: float, curvature: float, skip: float, ray: tuple[str, ...]) -> DataFrame:
    """parts (summaries) with k0, the ray's crossing, and entering, the highest reach between it and the segment; segments that end before the crossing go."""
    root = math.sqrt(max(0.0, curvature))
    whole, before = W.partitionBy(*ray), W.partitionBy(*ray).orderBy("k_first").rowsBetween(W.unboundedPreceding, -1)
    x = lambda p: (p["k"] - F.col("k0")) * F.lit(spacing)
    far = F.array_max(F.transform(F.filter("peaks", lambda p: x(p) >= skip), lambda p: p["up"] - x(p) * F.lit(root)))
    out = parts.withColumn("k0", F.min("first").over(whole)).filter("k_last >= k0")
    out = out.withColumn("reach", F.when(F.col("k_first") > F.col("k0"), far).otherwise(F.col("own")))
    return out.withColumn("entering", F.greatest(F.lit(0.0), F.coalesce(F.max("reach").over(before), F.lit(0.0)))).drop("reach")


def verdicts(samples: DataFrame, spacing: float, curvature: float, eye: float, skip: float, ray: tuple[str, ...], segment: tuple[str, ...]) -> DataFrame:
    """What terrain.verdicts gives, with no more of a ray in one place than a segment. Segments are contiguous in k."""
    root, part = math.sqrt(max(0.0, curvature)), [*ray, *segment]
    state = entering(summaries(samples, spacing, curvature, skip, ray, segment), spacing, curvature, skip, ray).select(*part, "k0", "entering")
    out = samples.join(state, part).filter("k >= k0").withColumn("x", (F.col("k") - F.col("k0")) * F.lit(spacing))
    h = _heights(F.col("h"))
    reach = F.sqrt(F.greatest(h, F.lit(0.0))) - F.col("x") * F.lit(root)
    so_far = W.partitionBy(*part).orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    highest = F.greatest(F.col("entering"), F.coalesce(F.max(F.when(F.col("x") >= skip, reach)).over(so_far), F.lit(0.0)))
    out = out.withColumn("highest", highest).drop("entering")
    out = out.withColumn("visible", F.sqrt(F.greatest(h + F.lit(eye), F.lit(0.0))) - F.col("x") * F.lit(root) >= F.col("highest"))
    return out.select(*samples.columns, "k0", "x", "highest", "visible")


# Blocks


def pack_blocks(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """KEY, rows, cols and pixels (float bytes) of cells (south, west, r, c, h), a row for each cell; cells that are missing inside a block are 0."""

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        r, c = group.r.to_numpy() % block, group.c.to_numpy() % block
        out = np.zeros((int(r.max()) + 1, int(c.max()) + 1), np.float32)
        out[r, c] = group.h.to_numpy(np.float32)
        return pd.DataFrame([[*[group[k].iloc[0] for k in KEY], *out.shape, out.tobytes()]], columns=[*KEY, "rows", "cols", "pixels"])

    at = cells.withColumns({"block_r": F.floor(F.col("r") / block).cast("int"), "block_c": F.floor(F.col("c") / block).cast("int")})
    return at.groupBy(*KEY).applyInPandas(packed, "south int, west int, block_r int, block_c int, rows int, cols int, pixels binary")  # block * block cells at most


def haloed(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """KEY, r0, c0 (the cell of the first pixel), rows, cols and pixels of elevation blocks with the neighbours' next row and column on each side of a tile's inside."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples():
                h = np.frombuffer(b.pixels, np.float32).reshape(b.rows, b.cols)
                out = []
                for dr in (-1, 0, 1):
                    for dc in (-1, 0, 1):  # what the neighbour in that direction needs of this block
                        if b.block_r + dr < 0 or b.block_c + dc < 0 or dr > 0 and b.rows < block or dc > 0 and b.cols < block:
                            continue  # the tile ends there
                        rows = {-1: slice(0, 1), 0: slice(None), 1: slice(-1, None)}[dr]
                        cols = {-1: slice(0, 1), 0: slice(None), 1: slice(-1, None)}[dc]
                        part = h[rows, cols]
                        r0, c0 = b.block_r * block + (b.rows - 1 if dr > 0 else 0), b.block_c * block + (b.cols - 1 if dc > 0 else 0)
                        out.append([b.south, b.west, b.block_r + dr, b.block_c + dc, not dr and not dc, r0, c0, *part.shape, part.tobytes()])
                yield pd.DataFrame(out, columns=[*KEY, "own", "r0", "c0", "rows", "cols", "pixels"])

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        if not group.own.any():
            return group.iloc[:0][[*KEY, "r0", "c0", "rows", "cols", "pixels"]]  # beyond the tile
        r0, c0 = int(group.r0.min()), int(group.c0.min())
        out = np.zeros((int((group.r0 + group.rows).max()) - r0, int((group.c0 + group.cols).max()) - c0), np.float32)
        for p in group.itertuples():
            out[p.r0 - r0 : p.r0 - r0 + p.rows, p.c0 - c0 : p.c0 - c0 + p.cols] = np.frombuffer(p.pixels, np.float32).reshape(p.rows, p.cols)
        return pd.DataFrame([[*[group[k].iloc[0] for k in KEY], r0, c0, *out.shape, out.tobytes()]], columns=[*KEY, "r0", "c0", "rows", "cols", "pixels"])

    kind = "south int, west int, block_r int, block_c int, {}r0 int, c0 int, rows int, cols int, pixels binary"
    return blocks.select(*KEY, "rows", "cols", "pixels").mapInPandas(pieces, kind.format("own boolean, ")).groupBy(*KEY).applyInPandas(joined, kind.format(""))  # nine pieces a block


def wet_blocks(rows: DataFrame, tiles: DataFrame, cells: int, block: int = BLOCK) -> DataFrame:
    """KEY and wet, the packed bits of each block of tiles (south, west), from water rows (south, west, r, words)."""
    count = -(-cells // block)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples():
                bits = np.zeros(count * block, np.uint8)
                words = np.asarray(b.words, np.int64).astype("<u4").view(np.uint8)
                found = np.unpackbits(words, bitorder="little")[: count * block]
                bits[: len(found)] = found
                parts = bits.reshape(count, block)
                own = np.flatnonzero(parts.any(axis=1))
                yield pd.DataFrame({"south": b.south, "west": b.west, "block_r": b.r // block, "block_c": own.astype(np.int32), "line": b.r % block, "bits": [np.packbits(parts[i]).tobytes() for i in own]})

    def stacked(group: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((block, -(-block // 8)), np.uint8)
        for line, bits in zip(group.line, group.bits):
            if bits is not None:
                out[int(line)] = np.frombuffer(bits, np.uint8)
        return pd.DataFrame([[*[group[k].iloc[0] for k in KEY], out.tobytes()]], columns=[*KEY, "wet"])

    each = F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dry = tiles.select("south", "west").distinct().withColumn("block_r", each).withColumn("block_c", each).select(*KEY, F.lit(None).cast("int").alias("line"), F.lit(None).cast("binary").alias("bits"))
    lines = rows.mapInPandas(cut, "south int, west int, block_r int, block_c int, line int, bits binary")
    return lines.unionByName(dry).groupBy(*KEY).applyInPandas(stacked, "south int, west int, block_r int, block_c int, wet binary")  # block lines at most


def terrain_blocks(elevation: DataFrame, water: DataFrame) -> DataFrame:
    """haloed elevation blocks and wet blocks by KEY: pixels null where no elevation is known, wet null where all is water."""
    return elevation.join(water, KEY, "full_outer")


def slice_blocks(by_azimuth: DataFrame, config: PipelineConfig, cells: int, block: int = BLOCK) -> DataFrame:
    """slices with KEY of each block that their rays can cross, and j_min and j_max, their rays."""
    mpd, s = F.lit(float(config.meters_per_degree_lat)), F.lit(config.spacing_m)
    ends = sweep.rays(by_azimuth, config)
    lat = lambda k: F.col("min_lat") + (F.col("n0") + k * s * F.col("cos_b")) / mpd
    lon = F.col("west") + F.col("k_max") * s * F.col("sin_b") / (mpd * F.col("cos_phi"))
    first, last = lat(F.lit(0)), lat(F.col("k_max"))
    span = ends.groupBy(*SLICE).agg(F.min(F.least(first, last)).alias("lo"), F.max(F.greatest(first, last)).alias("hi"), F.max(lon).alias("right"), F.min("j").alias("j_min"), F.max("j").alias("j_max"))
    out = by_azimuth.join(span, SLICE)
    return _blocks(out, F.col("lo"), F.col("hi"), F.col("west"), F.col("right"), cells, block).drop("lo", "hi", "right").withColumnRenamed("west", "edge").withColumnRenamed("tile_west", "west")


def _blocks(of: DataFrame, lo: Column, hi: Column, left: Column, right: Column, cells: int, block: int) -> DataFrame:
    """of with south, tile_west, block_r and block_c of the blocks that a rectangle of points meets, and perhaps of some beside them."""
    count = -(-cells // block)
    cell = lambda c: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(cells - 1))
    out = of.withColumns({"__lo": lo, "__hi": hi, "__left": left, "__right": right})
    out = out.withColumn("south", F.explode(F.sequence(F.floor("__lo").cast("int"), F.floor("__hi").cast("int")))).withColumn("tile_west", F.explode(F.sequence(F.floor("__left").cast("int"), F.floor("__right").cast("int"))))
    at = lambda c, pad: F.least(F.greatest(F.floor((cell(c) + pad) / block), F.lit(0)), F.lit(count - 1)).cast("int")
    row = lambda lat, pad: at((F.col("south") + 1 - lat) * cells, pad)
    col = lambda lon, pad: at((lon - F.col("tile_west")) * cells, pad)
    out = out.withColumn("block_r", F.explode(F.sequence(row(F.col("__hi"), -1), row(F.col("__lo"), 1)))).withColumn("block_c", F.explode(F.sequence(col(F.col("__left"), -1), col(F.col("__right"), 1))))
    return out.drop("__lo", "__hi", "__left", "__right")


class Block:
    """One block's cells: heights and water at points inside it."""

    def __init__(self, key: tuple, rows: pd.DataFrame, cells: int, block: int):
        self.south, self.west, self.r, self.c = (int(x) for x in key)
        self.cells, self.block, self.pixels, self.wet = cells, block, None, None
        if len(rows):
            b = rows.iloc[0]
            if b.pixels is not None:
                self.r0, self.c0 = int(b.r0), int(b.c0)
                self.pixels = np.frombuffer(b.pixels, np.float32).reshape(int(b.rows), int(b.cols))
            if b.wet is not None:
                self.wet = np.unpackbits(np.frombuffer(b.wet, np.uint8).reshape(block, -1), axis=1)[:, :block].astype(bool)

    def place(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether points lie in the block, and their rows and columns in it."""
        r = np.clip(np.floor((self.south + 1.0 - lat) * self.cells), 0, self.cells - 1).astype(np.int64)
        c = np.clip(np.floor((lon - self.west) * self.cells), 0, self.cells - 1).astype(np.int64)
        inside = (np.floor(lat) == self.south) & (np.floor(lon) == self.west) & (r // self.block == self.r) & (c // self.block == self.c)
        return inside, r - self.r * self.block, c - self.c * self.block

    def water(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        if self.wet is None:
            return np.ones(r.shape, bool)
        return self.wet[np.clip(r, 0, self.block - 1), np.clip(c, 0, self.block - 1)]

    def height(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """Bilinear between the four cells around a point."""
        if self.pixels is None:
            return np.zeros(lat.shape)
        h, (rows, cols) = self.pixels, self.pixels.shape
        y = np.clip((self.south + 1 - lat) * self.cells - 0.5, self.r0, self.r0 + rows - 1)
        x = np.clip((lon - self.west) * self.cells - 0.5, self.c0, self.c0 + cols - 1)
        r, c = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
        ty, tx = y - r, x - c
        r, c = r - self.r0, c - self.c0
        r1, c1 = np.minimum(r + 1, rows - 1), np.minimum(c + 1, cols - 1)
        corner = lambda i, j: h[i, j].astype(np.float64)
        top, bottom = corner(r, c) * (1 - tx) + corner(r, c1) * tx, corner(r1, c) * (1 - tx) + corner(r1, c1) * tx
        return np.nan_to_num((top * (1 - ty) + bottom * ty).astype(np.float32).astype(np.float64), nan=0.0)

    def samples(self, work, config: PipelineConfig) -> tuple[np.ndarray, ...]:
        """Of a slice's rays that cross the block: j; and a row for each with k, lat, lon, whether the sample is in the block, and its row and column there."""
        s, mpd = config.spacing_m, float(config.meters_per_degree_lat)
        along_max = max(x * work.sin_b + y * work.cos_b for x in (0.0, work.width * work.east) for y in (0.0, work.height * work.north))
        j = np.arange(work.j_min, work.j_max + 1)
        n0 = -j * s / work.sin_b
        k_max = np.floor((along_max + s - n0 * work.cos_b) / s)
        # Steps between the block's edges, two more at each end; place() decides.
        cut = self.block / self.cells
        west, north = self.west + self.c * cut, self.south + 1 - self.r * cut
        per_k = s * work.sin_b / (mpd * work.cos_phi)
        low, high = np.full(len(j), (west - work.edge) / per_k), np.full(len(j), (west + cut - work.edge) / per_k)
        up, start = s * work.cos_b / mpd, work.min_lat + n0 / mpd
        if abs(up) > 1e-12:
            a, b = (north - cut - start) / up, (north - start) / up
            low, high = np.maximum(low, np.minimum(a, b)), np.minimum(high, np.maximum(a, b))
        else:
            high = np.where((start > north - cut - 1e-6) & (start < north + 1e-6), high, -9.0)
        low, high = np.maximum(np.floor(low) - 2, 0), np.minimum(np.ceil(high) + 2, k_max)
        met = high >= low
        j, n0, low, high = j[met], n0[met], low[met].astype(np.int64), high[met].astype(np.int64)
        k = low[:, None] + np.arange(int((high - low).max()) + 1 if len(j) else 0)
        lat, lon = work.min_lat + (n0[:, None] + k * s * work.cos_b) / mpd, work.edge + k * s * work.sin_b / (mpd * work.cos_phi)
        inside, r, c = self.place(lat, lon)
        inside &= k <= high[:, None]
        some = inside.any(axis=1)
        return j[some], k[some], lat[some], lon[some], inside[some], r[some], c[some]


def block_summaries(work: DataFrame, blocks: DataFrame, config: PipelineConfig, cells: int, block: int = BLOCK) -> DataFrame:
    """SLICE, j, KEY and the summary of each segment, of slices by block."""
    s, root, skip = config.spacing_m, math.sqrt(config.curvature), config.coast_obstruction_skip_m
    limit, near = config.coast_march_max_km * 1000.0, math.floor(skip / s) + 1
    names = [*SLICE, "j", *KEY, "k_first", "k_last", "first", "own", "peaks"]

    def summed(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        b, out = Block(key, right, cells, block), []
        for w in left.itertuples():
            j, k, lat, lon, inside, r, c = b.samples(w, config)
            if not len(j):
                continue
            land = inside & ~b.water(r, c) & (k * s <= limit)
            up = np.sqrt(np.maximum(b.height(lat, lon), 0))
            far = np.iinfo(np.int64).max
            k_first, k_last = np.where(inside, k, far).min(axis=1), np.where(inside, k, -1).max(axis=1)
            first = np.where(land, k, far).min(axis=1)
            crossed = first < far
            x = (k - np.where(crossed, first, 0)[:, None]) * s
            own = np.where(inside & (x >= 0) & (x >= skip) & crossed[:, None], up - x * root, -np.inf).max(axis=1)
            level = np.where(inside, up - k * s * root, -np.inf)
            tail = np.where(k > k_first[:, None] + near, level, -np.inf).max(axis=1)
            peak = inside & (level >= tail[:, None] - SLACK)
            for i in range(len(j)):
                at = np.flatnonzero(peak[i])
                out.append((w.box_idx, w.strip, w.az, j[i], *key, k_first[i], k_last[i], int(first[i]) if crossed[i] else None, own[i] if own[i] > -np.inf else None, [{"k": int(k[i, p]), "up": float(up[i, p])} for p in at]))
        frame = pd.DataFrame(out, columns=names)
        return frame.astype({"first": "Int64"})

    kind = "box_idx int, strip int, az int, j long, south int, west int, block_r int, block_c int, k_first long, k_last long, first long, own double, peaks array<struct<k:long,up:double>>"
    return work.groupBy(*KEY).cogroup(blocks.groupBy(*KEY)).applyInPandas(summed, kind)


def block_verdicts(work: DataFrame, state: DataFrame, blocks: DataFrame, config: PipelineConfig, cells: int, block: int = BLOCK) -> DataFrame:
    """SLICE, j, k0, k (the first sample judged), n and seen (packed bits) of each segment from the crossing on; state: SLICE, j, KEY, k0, entering."""
    s, root, skip, eye = config.spacing_m, math.sqrt(config.curvature), config.coast_obstruction_skip_m, config.observer_eye_height_m
    states = F.collect_list(F.struct("j", "k0", "entering"))  # a slice's rays through one block
    joined = work.join(state.groupBy(*SLICE, *KEY).agg(states.alias("states")), [*SLICE, *KEY])

    def judged(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        b, out = Block(key, right, cells, block), []
        for w in left.itertuples():
            j, k, lat, lon, inside, _, _ = b.samples(w, config)
            given = {p["j"]: (p["k0"], p["entering"]) for p in w.states}
            own = np.array([i in given for i in j.tolist()], bool)
            if not own.any():
                continue
            j, k, lat, lon, inside = j[own], k[own], lat[own], lon[own], inside[own]
            k0, enter = (np.array([given[i][m] for i in j.tolist()])[:, None] for m in (0, 1))
            x, height = (k - k0) * s, b.height(lat, lon)
            judge = inside & (k >= k0)
            reach = np.where(judge & (x >= skip), np.sqrt(np.maximum(height, 0)) - x * root, 0.0)
            highest = np.maximum(np.maximum.accumulate(np.maximum(reach, 0.0), axis=1), enter)
            seen = np.sqrt(np.maximum(height + eye, 0)) - x * root >= highest
            for i in range(len(j)):
                at = np.flatnonzero(judge[i])
                if len(at):
                    out.append((w.box_idx, w.strip, w.az, j[i], k0[i, 0], k[i, at[0]], len(at), np.packbits(seen[i, at]).tobytes()))
        return pd.DataFrame(out, columns=[*SLICE, "j", "k0", "k", "n", "seen"])

    return joined.groupBy(*KEY).cogroup(blocks.groupBy(*KEY)).applyInPandas(judged, "box_idx int, strip int, az int, j long, k0 long, k long, n int, seen binary")


def gathered(by_azimuth: DataFrame, segments: DataFrame, config: PipelineConfig) -> DataFrame:
    """SLICE, row and seen: packed bits of each pixel row of a slice, each pixel with the verdict of the nearest sample of the nearest ray."""
    s = config.spacing_m

    def rows(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame([], columns=[*SLICE, "row", "seen"])
        w = left.iloc[0]
        parts = right.sort_values(["j", "k"])
        js, first = np.unique(parts.j.to_numpy(), return_index=True)
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(parts.seen, parts.n)]
        flat = np.concatenate([np.zeros(0, bool), *bits])
        size = np.add.reduceat(parts.n.to_numpy(), first) if len(js) else np.zeros(0, np.int64)
        begin, k0 = np.cumsum(size) - size, parts.k0.to_numpy()[first] if len(js) else np.zeros(0, np.int64)
        out = []
        e = np.arange(w.width) * w.east
        for a in range(0, int(w.height), ROWS):
            n = np.arange(a, min(a + ROWS, int(w.height)))[:, None] * w.north
            ray = _half_away((e * w.cos_b - n * w.sin_b) / s).astype(np.int64)
            at = np.minimum(np.searchsorted(js, ray), max(0, len(js) - 1))
            known = js[at] == ray if len(js) else np.zeros(ray.shape, bool)
            seen = np.zeros(ray.shape, bool)
            if known.any():
                dist = (e * w.sin_b + n * w.cos_b) - (-ray * s / w.sin_b * w.cos_b + k0[at] * s)
                index = np.clip(_half_away(dist / s).astype(np.int64), 0, size[at] - 1)
                seen = known & (dist >= -s) & flat[begin[at] + index]
            out += [(*key, a + i, np.packbits(line).tobytes()) for i, line in enumerate(seen)]
        return pd.DataFrame(out, columns=[*SLICE, "row", "seen"])

    return by_azimuth.groupBy(*SLICE).cogroup(segments.groupBy(*SLICE)).applyInPandas(rows, "box_idx int, strip int, az int, row int, seen binary")  # the verdict bits of a slice


def water_rows(of: DataFrame, blocks: DataFrame, config: PipelineConfig, cells: int, block: int = BLOCK) -> DataFrame:
    """box_idx, strip, row, col, n and wet (packed bits): the water of the pixels of strips, by pixel row and block."""
    cpd = float(config.cell_per_degree)
    work = _blocks(of, F.col("min_lat"), F.col("min_lat") + F.col("height") / cpd, F.col("west"), F.col("west") + F.col("width") / cpd, cells, block).withColumnRenamed("west", "edge").withColumnRenamed("tile_west", "west")

    def read(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        b, out = Block(key, right, cells, block), []
        for w in left.itertuples():
            lat, lon = w.min_lat + np.arange(w.height) / cpd, w.edge + np.arange(w.width) / cpd
            own, r, _ = b.place(lat, np.full(len(lat), b.west + (b.c * block + 0.5) / cells))
            mine, _, c = b.place(np.full(len(lon), b.south + 1 - (b.r * block + 0.5) / cells), lon)
            cols = np.flatnonzero(mine)
            if len(cols):
                out += [(w.box_idx, w.strip, int(i), int(cols[0]), len(cols), np.packbits(b.water(np.full(len(cols), r[i]), c[cols])).tobytes()) for i in np.flatnonzero(own)]
        return pd.DataFrame(out, columns=["box_idx", "strip", "row", "col", "n", "wet"])

    return work.groupBy(*KEY).cogroup(blocks.groupBy(*KEY)).applyInPandas(read, "box_idx int, strip int, row int, col int, n int, wet binary")


def sweep_blocks(boxes: DataFrame, config: PipelineConfig, blocks: DataFrame, cells: int, block: int = BLOCK) -> DataFrame:
    """box_idx, strip, row and mask of boxes over terrain blocks (KEY, r0, c0, rows, cols, pixels, wet), as sweep_packed has them."""
    layout = sweep.layout_of(config)
    bits, size = layout.bit_count, layout.bytes_per_pixel
    of = sweep.strips(boxes, config)
    by_azimuth = sweep.slices(of, config)
    work = slice_blocks(by_azimuth, config, cells, block)
    parts = block_summaries(work, blocks, config, cells, block)
    state = entering(parts, config.spacing_m, config.curvature, config.coast_obstruction_skip_m, (*SLICE, "j")).select(*SLICE, "j", *KEY, "k0", "entering")
    seen = gathered(by_azimuth, block_verdicts(work, state, blocks, config, cells, block), config)
    lines = seen.select("box_idx", "strip", "row", "az", F.lit(0).alias("col"), F.lit(0).alias("n"), F.col("seen").alias("line"))
    lines = lines.unionByName(water_rows(of, blocks, config, cells, block).select("box_idx", "strip", "row", F.lit(-1).alias("az"), "col", "n", F.col("wet").alias("line")))
    lines = lines.join(of.select("box_idx", "strip", "width"), ["box_idx", "strip"])

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        width = int(group.width.iloc[0])
        flags, wet = np.zeros((width, size * 8), np.uint8), np.zeros(width, bool)
        for g in group.itertuples():
            line = np.unpackbits(np.frombuffer(g.line, np.uint8), count=g.n if g.az < 0 else width)
            if g.az < 0:
                wet[g.col : g.col + g.n] = line
            else:
                flags[:, g.az] |= line
        flags[:, bits] = 1
        flags[wet] = 0
        mask = np.packbits(flags, axis=1, bitorder="little").tobytes()
        return pd.DataFrame({"box_idx": group.box_idx.iloc[:1].to_numpy(), "strip": group.strip.iloc[:1].to_numpy(), "row": group.row.iloc[:1].to_numpy(), "mask": [mask]})

    return lines.groupBy("box_idx", "strip", "row").applyInPandas(merged, "box_idx int, strip int, row int, mask binary")  # a line for each azimuth and block
