import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vespera.config import BitLayout, PipelineConfig
from vespera.operators import rasters, sweep
from vespera.sources import geodata, tiles

CONFIG = PipelineConfig(0.13, 6371000.0, 2.0, 60.0, 111320.0, 255.0, 285.0, 15.0, 0.1, 200.0, 1, 1, 1, "", "", sample_spacing_arcsec=40.0)
COAST = -122.43


def lookups():
    """Sent to the workers by value, who can't import this module."""
    coast = COAST
    sea = lambda lat, lon: lon < coast
    hill = lambda lat, lon: np.where((lon > coast + 0.05) & (lon < coast + 0.08), 60.0 + 4000.0 * (lon - coast - 0.05), np.where(lat > 37.6, np.nan, 0.0))
    return hill, sea


def boxes(spark):
    return spark.createDataFrame([(0, 37.75, -122.6, 37.5, -122.2)], "box_idx int, north double, west double, south double, east double")


def look(df):
    lon, lat = F.col("lon"), F.col("lat")
    h = F.when((lon > COAST + 0.05) & (lon < COAST + 0.08), 60.0 + 4000.0 * (lon - COAST - 0.05)).when(lat > 37.6, F.lit(float("nan"))).otherwise(0.0)
    return df.withColumns({"water": lon < COAST, "h": h})


def test_tiers_agree_and_the_hill_hides_what_is_behind(spark):
    layout = sweep.layout_of(CONFIG)
    masks = sweep.sweep(boxes(spark), CONFIG, look).collect()
    got = {(r.strip, r.row, r.col): r.w0 for r in masks}
    assert len(got) == 15 * 24 and layout.bit_count == 3
    packed = {(r.strip, r.row): np.frombuffer(r.mask, np.uint8) for r in sweep.sweep_packed(boxes(spark), CONFIG, *lookups()).collect()}
    assert {(s, r, c): int(v) for (s, r), m in packed.items() for c, v in enumerate(m)} == got
    lon = lambda c: -122.6 + c / 60
    assert all(v == 0 for (_, _, c), v in got.items() if lon(c) < COAST)
    assert all(v & 8 for (_, _, c), v in got.items() if lon(c) >= COAST)
    assert all(v & 2 for (_, _, c), v in got.items() if COAST + 0.03 > lon(c) >= COAST)
    assert not any(v & 2 for (_, _, c), v in got.items() if COAST + 0.1 < lon(c) < COAST + 0.2)
    assert all(v & 2 for (_, _, c), v in got.items() if COAST + 0.056 < lon(c) < COAST + 0.074)  # it rises faster than the earth falls


def test_strips_working_set_and_reach(spark):
    of = sweep.strips(boxes(spark), CONFIG)
    assert [(r.strip, r.height, r.row_off) for r in of.orderBy("strip").collect()] == [(0, 6, 9), (1, 6, 3), (2, 3, 0)]
    assert {(r.lat, r.lon) for r in sweep.working_set(of, CONFIG).collect()} == {(37, -123)}
    row = sweep.marched_km(boxes(spark), CONFIG).first()
    assert row.covers and 36 < row.required_km < 37


def test_march_to_coast(spark):
    points = spark.createDataFrame([(1, 37.6, -123.0), (2, 37.6, -140.0), (3, None, -123.0)], "id int, lat double, lon double")
    got = {r.id: (r.lat, r.lon) for r in sweep.to_coast(points, 90.0, 1.0, 100.0, lookups()[1]).collect()}
    assert got[1][0] == 37.6 and 0 <= got[1][1] - COAST < 3e-6 and got[2] == (37.6, -140.0)
    assert got[3][0] is None


def test_touched_cells_and_clip(spark):
    edges = spark.createDataFrame([(1, 1.2, 1.2, 3.4, 1.2), (1, 3.4, 1.2, 3.4, 3.4), (1, 3.4, 3.4, 1.2, 1.2)], "poly int, x0 double, y0 double, x1 double, y1 double")
    cells = rasters.touched(edges, 8, 8)
    assert {(r.row, r.col) for r in cells.collect()} == {(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)}
    pixels = spark.createDataFrame([(1, 1, 5), (2, 1, 6)], "row int, col int, w0 long")
    assert sorted(tuple(r) for r in rasters.clip(pixels, cells, ["w0"]).select("row", "col", "w0").collect()) == [(1, 1, 5), (2, 1, 0)]


def test_reproject_takes_the_nearest_pixel(spark):
    pixels = spark.range(100).select(F.floor(F.col("id") / 10).alias("row"), (F.col("id") % 10).alias("col"), (F.col("id") + 1).alias("w0"))
    out = rasters.reproject(pixels, 37.0, -122.0, 37.9, -121.1, 10, 6, ["w0"]).collect()
    n = 512 * 64
    assert {r.w0 for r in out} == set(range(1, 101))
    for r in out:
        lon, lat = (r.col + 0.5) / n * 360 - 180, np.degrees(np.arctan(np.sinh((0.5 - (r.row + 0.5) / n) * 2 * np.pi)))
        assert abs(37 + (r.w0 - 1) // 10 / 10 - lat) <= 0.05001 and abs(-122 + (r.w0 - 1) % 10 / 10 - lon) <= 0.05001


def test_tiles_round_trip(spark, tmp_path):
    layout = BitLayout(233, 309, 1)
    rows = [(9, 700, 30, 5, 1 << 31, 1 << 13), (9, 3, 511, 0, 0, 1), (9, 4, 4, 0, 0, 0)]
    pixels = spark.createDataFrame(rows, "z int, row long, col long, w0 long, w1 long, w2 long")
    packed = tiles.pack_tiles(pixels, layout)
    tiles.write_tile_files(packed, str(tmp_path / "t"))
    back = tiles.read_tile_files(spark, str(tmp_path / "t"))
    assert sorted((r.z, r.x, r.y) for r in back.collect()) == [(9, 0, 0), (9, 0, 1)]
    assert sorted(tuple(r) for r in tiles.unpack_tiles(back, layout).collect()) == sorted(rows[:2])
    document = tiles.tilejson(layout, (-123.0, 37.0, -122.0, 38.0), 5, 9)
    tiles.write_tilejson(document, str(tmp_path / "tiles.json"))
    assert tiles.read_tilejson(spark, str(tmp_path / "tiles.json")).first().asDict() == document
    tiles.write_tilejson(document | {"format_version": 2}, str(tmp_path / "tiles.json"))
    with pytest.raises(Exception, match="unknown format version"):
        tiles.read_tilejson(spark, str(tmp_path / "tiles.json")).collect()
    assert tiles.grey_png(np.zeros((2, 3), np.uint8))[:8] == b"\x89PNG\r\n\x1a\n"
    rays = spark.createDataFrame([(1, [True, False]), (0, [True])], "j int, verdicts array<boolean>")
    assert struct.unpack(">II", tiles.rays_png(rays)[16:24]) == (2, 2)


def test_tiff_and_elevations(spark, tmp_path):
    h = np.arange(36, dtype=np.float32).reshape(6, 6)
    (tmp_path / "a.tif").write_bytes(geodata.write_tiff(h[None], -122.0, 38.0, 1 / 6))
    blocks = geodata.elevation_blocks(spark, str(tmp_path), 4)
    cells = {(r.south, r.west, r.r, r.c): r.h for r in geodata.elevation_cells(blocks, 4).collect()}
    assert cells == {(37, -122, r, c): float(h[r, c]) for r in range(6) for c in range(6)}
    mask = np.arange(4 * 5 * 10, dtype=np.uint8).reshape(4, 5, 10)
    bands, tags = geodata.read_tiff(geodata.mask_tiff(mask, BitLayout(233, 309, 1), -122.0, 38.0, 0.5))
    assert (bands.transpose(1, 2, 0)[::-1] == mask).all() and b'"bit_count">77<' in tags[geodata.METADATA][0]
    assert tags[geodata.TIEPOINT][3:5] == (-122.25, 37.75)
    with pytest.raises(ValueError):
        geodata.read_tiff(b"no")


def test_polygons(spark, tmp_path):
    ring = [(359500000, 10), (359900000, 10), (359900000, 20)]
    header = lambda i, level: struct.pack(">11i", i, 3, level, 359500000, 359900000, 10, 20, 0, 0, -1, -1) + struct.pack(">6i", *sum(ring, ()))
    (tmp_path / "s.b").write_bytes(header(0, 1) + header(1, 2))
    got = geodata.shorelines(spark, str(tmp_path / "s.b"))
    assert [(r.poly, round(r.west, 6)) for r in got.collect()] == [(0, -0.5)] and geodata.edges(got).count() == 3
    points = struct.pack("<8d", 0, 0, 0, 2, 2, 2, 0, 0)
    record = struct.pack("<i4d2ii", 5, 0, 0, 2, 2, 1, 4, 0) + points
    (tmp_path / "w.shp").write_bytes(struct.pack(">i", 9994) + b"\0" * 96 + struct.pack(">2i", 1, len(record) // 2) + record)
    shapes = geodata.shapefile(spark, str(tmp_path / "w.shp"))
    assert geodata.edges(geodata.within(shapes, 1, 1, 3, 3)).count() == 3 and geodata.within(shapes, 5, 5, 6, 6).count() == 0
