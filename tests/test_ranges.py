"""Shorelines by ranges of their files, and mask rasters written by several tasks at once."""

import random
import struct

import numpy as np
import pytest

from vespera.config import BitLayout
from vespera.operators import water
from vespera.sources import geodata, masks, shorelines

LAYOUT = BitLayout(233, 309, 1)


def shore(polygons) -> bytes:
    """A shoreline file of (level, points in micro-degrees)."""
    out = b""
    for i, (level, points) in enumerate(polygons):
        x, y = [p[0] for p in points], [p[1] for p in points]
        out += struct.pack(">11i", i, len(points), level, min(x), max(x), min(y), max(y), 0, 0, -1, -1) + struct.pack(f">{2 * len(points)}i", *[v for p in points for v in p])
    return out


def squares(rng, n):
    out = []
    for k in range(n):
        x, y, s = rng.randint(0, 359_000_000), rng.randint(-60_000_000, 60_000_000), rng.choice([1000, 300_000, 1_000_000, 2_500_000])
        ring = [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
        out.append((1 if k == 0 else rng.choice([1, 1, 2]), [p for p in ring for _ in range(rng.choice([1, 5, 4000]))]))
    return out


def test_ranges_give_what_the_whole_file_gives(spark, tmp_path):
    rng = random.Random(5)
    for name in ("a.b", "c.b"):
        (tmp_path / name).write_bytes(shore(squares(rng, 120)))
    for name in ("a.b", "c.b"):
        index = shorelines.shoreline_index(spark, [f"file://{tmp_path}/{name}"])
        whole = geodata.shorelines(spark, str(tmp_path / name))
        assert sorted(shorelines.fetched(index).collect()) == sorted(whole.collect())
    both = shorelines.shoreline_index(spark, [str(tmp_path / "a.b"), str(tmp_path / "c.b")])
    assert both.select("path").distinct().count() == 2
    one = shorelines.shoreline_index(spark, [str(tmp_path / "a.b")])
    refs = {(r.poly, r.tile_south, r.tile_west) for r in shorelines.tile_refs(one).filter("west < east").collect()}
    assert refs == {(r.poly, r.south, r.west) for r in water.tile_index(geodata.shorelines(spark, str(tmp_path / "a.b")).filter("west < east")).collect()}


def test_a_tile_reads_its_own_polygons_alone(spark, tmp_path):
    """The file is cut off behind the wanted polygon, whose neighbours are overwritten, when the index is made."""
    polygons = [(1, [(k * 2_000_000, 0), (k * 2_000_000 + 500_000, 0), (k * 2_000_000, 500_000)] * 50) for k in range(8)]
    data, path = shore(polygons), tmp_path / "a.b"
    path.write_bytes(data)
    index = shorelines.shoreline_index(spark, [str(path)])
    index.write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    size = len(data) // 8
    path.write_bytes(b"\xff" * (3 * size) + data[3 * size : 4 * size])
    wanted = shorelines.of_tiles(index, spark.createDataFrame([(0, 6), (0, 7), (50, 6)], "south int, west int"))
    got = shorelines.fetched(wanted).collect()
    assert [(r.poly, r.rings[0].x[0], len(r.rings[0].x)) for r in got] == [(3, 6.0, 151)]
    with pytest.raises(Exception, match=r"a\.b"):
        shorelines.fetched(index).collect()
    path.write_bytes(b"\0" * 10)
    with pytest.raises(Exception, match="too short"):
        shorelines.shoreline_index(spark, [str(path)]).collect()


def test_strips_of_a_box_by_many_tasks(spark, tmp_path):
    """Bytes equal those of one task; rows that are missing, strips without rows and boxes without rows are zeros."""
    rng, size = np.random.default_rng(6), LAYOUT.bytes_per_pixel
    boxes = spark.createDataFrame([("box_000", -123.0, 38.0, 17, 150), ("box_001", -122.0, 38.0, 5, 64), ("box_002", -121.0, 38.0, 3, 1)], "name string, west double, north double, width int, height int")
    rows = [("box_000", r, rng.integers(0, 256, 17 * size).astype(np.uint8).tobytes()) for r in range(150) if r % 7 and not 30 < r < 100] + [("box_002", 0, bytes(range(3 * size)))]
    table = spark.createDataFrame(rows, "name string, row int, mask binary").repartition(7)
    (tmp_path / "one").mkdir()
    (tmp_path / "many").mkdir()
    masks.write_masks(table, boxes, LAYOUT, 1 / 60, str(tmp_path / "one"), 32).collect()
    assert masks.write_masks_in_strips(table, boxes, LAYOUT, 1 / 60, f"file://{tmp_path}/many", 32) == ["box_000", "box_001", "box_002"]
    for name in ("box_000", "box_001", "box_002"):
        assert (tmp_path / "one" / f"{name}.tif").read_bytes() == (tmp_path / "many" / f"{name}.tif").read_bytes()
    assert sorted(p.name for p in (tmp_path / "many").iterdir()) == ["box_000.tif", "box_001.tif", "box_002.tif"]
    # an earlier, longer part that was left behind changes nothing
    (tmp_path / "many" / "box_002.tif.part").write_bytes(b"x" * 100_000)
    masks.write_masks_in_strips(table, boxes, LAYOUT, 1 / 60, str(tmp_path / "many"), 32)
    assert (tmp_path / "one" / "box_002.tif").read_bytes() == (tmp_path / "many" / "box_002.tif").read_bytes()
    with pytest.raises(ValueError, match="mounted"):
        masks.write_masks_in_strips(table, boxes, LAYOUT, 1 / 60, "s3://bucket/x", 32)


def test_a_rectangle_reads_few_row_groups(spark, tmp_path):
    """The share of row groups whose bounds meet a rectangle, along the curve and in any order; the filter gives the same rows."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from vespera.operators import lattice

    rng = random.Random(7)
    rows = [(k, x := rng.uniform(-179, 178), y := rng.uniform(-89, 88), x + rng.random(), y + rng.random()) for k in range(20_000)]
    table = spark.createDataFrame(rows, "poly long, west double, south double, east double, north double")
    lattice.store_by_curve(table, str(tmp_path / "curve"), 64)
    table.repartition(64).write.parquet(str(tmp_path / "any"))
    shares = {}
    for name in ("curve", "any"):
        groups = [pq.ParquetFile(f).metadata.row_group(i) for f in sorted((tmp_path / name).glob("*.parquet")) for i in range(pq.ParquetFile(f).metadata.num_row_groups)]
        low_high = lambda g, c: (lambda s: (s.min, s.max))(next(g.column(i).statistics for i in range(g.num_columns) if g.column(i).path_in_schema == c))
        met = [g for g in groups if low_high(g, "south")[0] < 41 and low_high(g, "north")[1] > 30 and low_high(g, "west")[0] < -110 and low_high(g, "east")[1] > -125]
        shares[name] = len(met) / len(groups)
    assert len(groups) >= 60 and shares["any"] == 1.0 and shares["curve"] < 0.15
    found = geodata.within(spark.read.parquet(str(tmp_path / "curve")), 30.0, -125.0, 41.0, -110.0)
    assert sorted(r.poly for r in found.collect()) == sorted(k for k, x, y, e, n in rows if y < 41 and n > 30 and x < -110 and e > -125)
    assert "PushedFilters" in found._jdf.queryExecution().executedPlan().toString()
    keys = spark.createDataFrame([(0.0, 0.0), (90.0, 180.0), (-90.0, -180.0), (-45.0, 90.0)], "lat double, lon double").select(lattice.curve_key(F.col("lat"), F.col("lon"), 2)).collect()
    assert [r[0] for r in keys] == [12, 15, 0, 7]
