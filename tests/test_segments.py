"""Segments of rays and sweeps over blocks against whole rays and the relational tier."""

import dataclasses
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vespera.config import PipelineConfig
from vespera.operators import segments, sweep, terrain, water

CONFIG = PipelineConfig(0.13, 6371000.0, 2.0, 60.0, 111320.0, 240.0, 300.0, 20.0, 0.1, 200.0, 1, 1, 1, "", "", sample_spacing_arcsec=40.0)
CELLS, BLOCK = 40, 16


def rays(rng, n):
    """Rays of random land, sea, hills, missing heights and cuts; flat ones and ones without land too."""
    out = []
    for j in range(n):
        size, rough = rng.randint(1, 60), rng.choice([0.0, 0.0, 5.0, 300.0])
        cuts = sorted(rng.sample(range(size), min(size, rng.randint(0, 5))))
        wet = rng.choice([0.05, 0.5, 0.95, 1.0])
        for k in range(size):
            h = rng.choice([None, float("nan"), -3.0, 0.0, rough * rng.random(), rough])
            out.append((0, j % 3, j, k, sum(c <= k for c in cuts), h, rng.random() < wet))
    return out


@pytest.mark.parametrize("skip", [0.0, 1236.9, 9000.0])
@pytest.mark.parametrize("curvature", [CONFIG.curvature, 0.0])
def test_segments_are_the_window_bit_for_bit(spark, skip, curvature):
    samples = spark.createDataFrame(rays(random.Random(int(skip)), 150), "strip int, az int, j int, k int, cut int, h double, water boolean").repartition(5)
    s = CONFIG.spacing_m
    key = ["strip", "az", "j", "k", "k0", "x", "highest", "visible"]
    whole = terrain.verdicts(samples, s, curvature, 2.0, skip).select(*key)
    parts = segments.verdicts(samples, s, curvature, 2.0, skip, terrain.RAY, ("cut",)).select(*key)
    assert sorted(whole.collect()) == sorted(parts.collect())


def test_peaks_are_few(spark):
    flat = spark.createDataFrame([(0, 0, 0, k, k // 200, 0.0, k < 30) for k in range(1000)], "strip int, az int, j int, k int, cut int, h double, water boolean")
    got = segments.summaries(flat, CONFIG.spacing_m, CONFIG.curvature, 0.0, terrain.RAY, ("cut",)).collect()
    assert len(got) == 5 and all(len(r.peaks) <= 3 for r in got)


def terrain_of(spark, seed):
    """Cells of two of three tiles of a row and one above; one of them has no heights, one no water at all."""
    rng = np.random.default_rng(seed)
    cells, wet = [], []
    for south, west, known in ((37, -123, True), (37, -122, False), (38, -123, True), (36, -122, True)):
        h = np.maximum(0, rng.normal(5, 30, (CELLS, CELLS))).astype(np.float32) * (rng.random((CELLS, CELLS)) < 0.5)
        sea = rng.random((CELLS, CELLS)) < (0.7 if west == -123 else 0.2)
        sea[:, : CELLS // 4] |= west == -123
        for r in range(CELLS):
            for c in range(CELLS):
                if known:
                    cells.append((south, west, r, c, float(h[r, c])))
                if sea[r, c] and south != 38:
                    wet.append((south, west, r, c))
    tiles = [(37, -123), (37, -122), (38, -123)]
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    return make(cells, "south int, west int, r int, c int, h float"), make(wet, "south int, west int, r int, c int").filter("south <> 36"), make(tiles, "south int, west int")


def test_blocks_have_halos(spark):
    cells, wet, tiles = terrain_of(spark, 1)
    held = {(r.south, r.west, r.r, r.c): r.h for r in cells.collect()}
    for b in segments.haloed(segments.pack_blocks(cells, BLOCK), BLOCK).collect():
        h = np.frombuffer(b.pixels, np.float32).reshape(b.rows, b.cols)
        r0, r1 = max(0, b.block_r * BLOCK - 1), min(CELLS, b.block_r * BLOCK + BLOCK + 1)
        c0, c1 = max(0, b.block_c * BLOCK - 1), min(CELLS, b.block_c * BLOCK + BLOCK + 1)
        assert (b.r0, b.c0, b.rows, b.cols) == (r0, c0, r1 - r0, c1 - c0)
        assert all(h[r - r0, c - c0] == held[b.south, b.west, r, c] for r in range(r0, r1) for c in range(c0, c1))
    bits = segments.wet_blocks(water.pack_rows(wet), tiles, CELLS, BLOCK)
    assert bits.count() == 3 * 9
    wet_cells = {tuple(r) for r in wet.collect()}
    for b in bits.collect():
        m = np.unpackbits(np.frombuffer(b.wet, np.uint8).reshape(BLOCK, -1), axis=1)[:, :BLOCK]
        assert all(m[r, c] == ((b.south, b.west, b.block_r * BLOCK + r, b.block_c * BLOCK + c) in wet_cells) for r in range(BLOCK) for c in range(BLOCK))


@pytest.mark.parametrize("skip, march", [(0.0, 200.0), (2500.0, 28.0)])
def test_a_sweep_over_stored_blocks_is_the_relational_one(spark, tmp_path, skip, march):
    """Several azimuths, rays over tiles that are missing (sea at 0 m) or have no heights, a skip and a march limit that bites."""
    config = dataclasses.replace(CONFIG, coast_obstruction_skip_m=skip, coast_march_max_km=march)
    cells, wet, tiles = terrain_of(spark, 7)
    boxes = spark.createDataFrame([(0, 38.05, -122.9, 37.8, -122.4), (3, 37.2, -122.3, 36.97, -121.8)], "box_idx int, north double, west double, south double, east double")
    rows = water.pack_rows(wet)
    blocks = segments.terrain_blocks(segments.haloed(segments.pack_blocks(cells, BLOCK), BLOCK), segments.wet_blocks(rows, tiles, CELLS, BLOCK))
    blocks.write.parquet(str(tmp_path / "blocks"))

    def look(points):
        return water.water_at(terrain.bilinear(points, cells, CELLS).drop("south", "west"), rows, tiles, CELLS)

    masks = sweep.sweep(boxes, config, look).collect()
    assert sweep.layout_of(config).bit_count == 4
    expected = {(r.box_idx, r.strip, r.row, r.col): r.w0 for r in masks}
    got = {}
    for r in segments.sweep_blocks(boxes, config, spark.read.parquet(str(tmp_path / "blocks")), CELLS, BLOCK).collect():
        got |= {(r.box_idx, r.strip, r.row, c): v for c, v in enumerate(r.mask)}
    assert got == expected
    assert len({v for v in expected.values()}) > 6 and any(v == 0 for v in expected.values())


def test_no_block_is_sea(spark):
    boxes = spark.createDataFrame([(0, 10.1, 20.0, 10.0, 20.1)], "box_idx int, north double, west double, south double, east double")
    none = spark.createDataFrame([], "south int, west int, block_r int, block_c int, r0 int, c0 int, rows int, cols int, pixels binary, wet binary")
    assert {bytes(r.mask) for r in segments.sweep_blocks(boxes, CONFIG, none, CELLS, BLOCK).collect()} == {bytes(6)}
    assert segments.sweep_blocks(boxes.limit(0), CONFIG, none, CELLS, BLOCK).count() == 0
