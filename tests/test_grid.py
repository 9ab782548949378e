import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vespera.config import BitLayout
from vespera.operators import lattice, polygons, rasters, runs, sweep, terrain, water
from vespera.sources import files, geodata, masks, tiles
from vespera.streaming.boxes import run_incrementally

LAYOUT = BitLayout(233, 309, 1)
BOXES = "name string, north double, west double, south double, east double, config_hash string"


def test_trace_shows_seaward_steps_and_reaches(spark):
    rows = [("r", k, 0.0 if k < 3 else float(k), k < 3) for k in range(9)] + [("other", k, 1.0, False) for k in range(4)]
    samples = spark.createDataFrame(rows, "ray string, k int, h double, water boolean")
    judged = terrain.verdicts(samples, 10.0, 1e-6, 0.5, ray=("ray",))
    got = terrain.trace(samples, judged, F.col("ray") == "r", 2, 3, 10.0, 1e-6, 0.5, ray=("ray",), skip=15.0).orderBy("step").collect()
    assert [(r.step, r.side, r.water, r.x) for r in got] == [(-2, "sea", True, -20.0), (-1, "sea", True, -10.0), (0, "land", False, 0.0), (1, "land", False, 10.0), (2, "land", False, 20.0), (3, "land", False, 30.0)]
    assert [r.in_skip for r in got] == [None, None, True, True, False, False] and not any(r.visible for r in got[:2])
    assert all(abs(r.obs_reach - ((r.h + 0.5) ** 0.5 * 1000 - r.x)) < 1e-6 for r in got[2:]) and got[0].max_reach is None


def test_target_ray_is_the_gathers(spark):
    from test_sweep import CONFIG

    of = spark.createDataFrame([(0, 37.6, -122.6, 37.5, -122.2)], "box_idx int, north double, west double, south double, east double")
    one = sweep.slices(sweep.strips(of, CONFIG), CONFIG).filter("strip = 0 AND az = 0").first()
    points = sweep.pixel_points(sweep.strips(of, CONFIG), CONFIG).filter("strip = 0")
    ray = terrain.target_ray(F.col("lat"), F.col("lon"), 37.5, -122.6, 255.0, CONFIG)  # at 270 pixels lie midway between rays
    for r in points.withColumn("j", ray).collect():
        e, n = r.col * one.east, r.row * one.north
        x = (e * one.cos_b - n * one.sin_b) / CONFIG.spacing_m
        assert r.j == np.sign(x) * np.floor(abs(x) + 0.5)


def test_packed_sweep_is_dealt_to_many_tasks(spark):
    from test_sweep import CONFIG, boxes, lookups

    work = sweep.sweep_packed(boxes(spark), CONFIG, *lookups(), tasks=7)
    seen = work.sparkSession._jvm  # the plan keeps the number that was given
    assert seen is not None and "REPARTITION_BY_NUM" in work._jdf.queryExecution().executedPlan().toString()
    one, many = ({(r.strip, r.row): bytes(r.mask) for r in sweep.sweep_packed(boxes(spark), CONFIG, *lookups(), tasks=t).collect()} for t in (1, 5))
    assert one == many


def test_water_words_and_misses(spark):
    cells = spark.createDataFrame([(36, -122, 0, 0), (36, -122, 0, 39), (36, -122, 39, 31), (36, -122, 39, 32)], "south int, west int, r int, c int")
    rows = {r.r: r.words for r in water.pack_rows(cells).collect()}
    assert rows == {0: [1, 128], 39: [1 << 31, 1]}
    points = spark.createDataFrame([(36.999, -121.999), (36.999, -121.001), (36.5, -121.5), (10.0, 10.0), (36.0, -121.19), (37.0, -121.5)], "lat double, lon double")
    assert [r.water for r in water.water_at(points, water.pack_rows(cells), cells.select("south", "west"), 40).orderBy("lat", "lon").collect()] == [True, True, False, True, True, True]


def test_lattice_contracts_and_map_tiles(spark):
    s = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "src int, bit_count int")
    assert [r.src for r in lattice.mismatches(s, ["bit_count"]).collect()] == [2] and lattice.same_contract(s.filter("src < 2"), ["bit_count"]).count() == 2
    with pytest.raises(Exception, match="unlike the first in its bit layout: source 2"):
        lattice.same_contract(s, ["bit_count"]).collect()
    h = lattice.HALF
    r = lattice.base_raster(lattice.tile_range(spark.createDataFrame([(0.0, 0.0, h / 2, h / 2), (-2 * h, -2 * h, 2 * h, 2 * h)], "west double, south double, east double, north double"), 2), 2).collect()
    assert [tuple(r[0][c] for c in ("tx_min", "tx_max", "ty_min", "ty_max", "width", "height")), round(r[0].x_max, 3)] == [(2, 2, 1, 1, 512, 512), round(h / 2, 3)]
    assert [r[1][c] for c in ("tx_min", "tx_max", "ty_min", "ty_max", "width")] == [0, 3, 0, 3, 2048] and abs(r[1].x_min + h) < 1e-6 and abs(r[1].y_min + h) < 1e-6
    x, y = spark.range(1).select(*lattice.metres(F.lit(0.0), F.lit(180.0))).first()
    assert abs(x - h) < 1e-6 and abs(y) < 1e-6


def test_mask_rasters_round_trip_strip_by_strip(spark, tmp_path):
    rng = np.random.default_rng(1)
    pixels = {name: rng.integers(0, 256, (h, w, 10), np.uint8) for name, h, w in (("box_000", 7, 5), ("box_001", 3, 4))}
    rows = [(name, r, m[r].tobytes()) for name, m in pixels.items() for r in range(len(m)) if (name, r) != ("box_000", 4)]
    boxes = spark.createDataFrame([("box_000", -123.0, 38.0, 5, 7), ("box_001", -121.0, 36.5, 4, 3), ("box_002", -120.0, 30.0, 2, 2)], "name string, west double, north double, width int, height int")
    done = masks.write_masks(spark.createDataFrame(rows, masks.ROWS), boxes, LAYOUT, 0.5, str(tmp_path), strip_rows=3)
    assert sorted((r.name, r.n_rows) for r in done.collect()) == [("box_000", 6), ("box_001", 3), ("box_002", 0)]
    back = masks.read_masks(spark, str(tmp_path)).collect()
    pixels["box_000"][4] = 0
    pixels["box_002"] = np.zeros((2, 2, 10), np.uint8)
    assert {(r.name, r.row): bytes(r.mask) for r in back} == {(n, r): m[r].tobytes() for n, m in pixels.items() for r in range(len(m))}
    r = next(r for r in back if r.name == "box_000")
    assert (r.west, r.north, r.cell, r.bit_count, r.format_version, r.bytes_per_pixel, r.azimuth_max_deg) == (-123.0, 38.0, 0.5, 77, 1, 10, 309.0)
    bands, tags = geodata.read_tiff((tmp_path / "box_001.tif").read_bytes())
    assert bands.shape == (10, 3, 4) and b"mask_byte_9" in tags[geodata.METADATA][0] and tags[geodata.TIEPOINT][3:5] == (-121.25, 36.25)
    words = {(r.row, r.col): (r.w0, r.w1, r.w2) for r in masks.mask_words(masks.read_masks(spark, str(tmp_path)).filter("name = 'box_001'"), LAYOUT).collect()}
    data = pixels["box_001"].tobytes()
    assert words[(0, 1)] == tuple(int.from_bytes(data[10 + 4 * k : 10 + min(10, 4 * k + 4)], "little") for k in range(3))


def test_tile_folder_is_emptied_and_missing_tiles_are_empty(spark, tmp_path):
    pixels = spark.createDataFrame([(3, 5, 6, 9, 0, 1)], "z int, row long, col long, w0 long, w1 long, w2 long")
    packed = tiles.pack_tiles(pixels, LAYOUT, 16)
    (tmp_path / "t" / "9").mkdir(parents=True)
    (tmp_path / "t" / "9" / "old.bin").write_bytes(b"x")
    tiles.write_tile_files(packed, str(tmp_path / "t"))
    assert [p.name for p in (tmp_path / "t").rglob("*.bin")] == ["0.bin"]
    full, empty = (tiles.tile_of(packed, 3, x, 0, LAYOUT, 16).first().data for x in (0, 1))
    assert full[(5 * 16 + 6) * 10] == 9 and not any(empty) and len(empty) == 16 * 16 * 10
    assert geodata.read_tiff(tiles.slice_tiff(np.array([[True, False], [False, False]]), 0.0, 1.0, 0.5))[0].tolist() == [[[0, 0], [1, 0]]]
    for bad in ((-1, 2, 6, 1), (3, 2, 6, 1), (1, 2, 10, 1), (1, 2, 6, 0)):
        with pytest.raises(ValueError):
            tiles.checked(*bad)


def test_inputs_sidecars_and_what_is_left_over(spark, tmp_path):
    folder = str(tmp_path)
    for name in ("box_001.tif", "box_000.tif", "box_007.tif", "notes.txt"):
        (tmp_path / name).write_bytes(b"")
    assert [p.rsplit("/", 1)[1] for p in files.expand_inputs(spark, [folder, f"{folder}/notes.txt"])] == ["box_000.tif", "box_001.tif", "box_007.tif", "notes.txt"]
    (tmp_path / "none").mkdir()
    for bad in ("none", "missing"):
        with pytest.raises(ValueError):
            files.expand_inputs(spark, [f"{folder}/{bad}"])
    boxes = spark.createDataFrame([("box_000", 38.0, -123.0, 37.0, -122.0, "h"), ("box_001", 39.0, -123.0, 38.0, -122.0, "h"), ("box_003", 1.0, 0.0, 0.0, 1.0, "h")], BOXES)
    assert files.write_sidecars(spark, boxes, folder) == 3
    (tmp_path / "box_001.tif.json").write_text("{broken")
    ledger = files.read_sidecars(spark, folder)
    assert [r.name for r in ledger.collect()] == ["box_000"]  # malformed, and one without its raster
    assert sorted(r.name for r in runs.due(boxes, ledger).collect()) == ["box_001", "box_003"]
    assert runs.due(boxes, ledger, version=2).count() == 3
    assert files.remove(spark, folder, runs.left_over(files.names_of(spark, folder), 3)) == ["box_003.tif.json", "box_007.tif"]
    numbered = boxes.withColumn("box_idx", F.regexp_extract("name", r"(\d+)", 1).cast("int"))
    a, b = (runs.inputs_hash(numbered, t).first().hash for t in ("x", "y"))
    assert a != b and a.startswith("sha256:") and a == runs.inputs_hash(numbered.orderBy(F.desc("name")), "x").first().hash


def test_manifest_keeps_its_other_members(spark, tmp_path):
    path = tmp_path / "boxes.json"
    path.write_text(json.dumps({"engine": "e", "boxes": []}))
    box = {"top_left": [38, -123.0], "bottom_right": [37, -122]}
    assert files.replace_boxes(spark, str(path), [box]) == 1 and json.loads(path.read_text()) == {"engine": "e", "boxes": [box]}
    for bad in ([{"top_left": [1, 2]}], [{"top_left": [1, True], "bottom_right": [1, 2]}], [{"top_left": [1, float("nan")], "bottom_right": [1, 2]}], [[1]]):
        with pytest.raises(ValueError):
            files.replace_boxes(spark, str(path), bad)
    assert not [p for p in tmp_path.iterdir() if p.name.endswith(".part")]


def test_download_list_is_written_in_first_seen_order(spark, tmp_path):
    lines = ["u/USGS_13_n38w122_20100101.tif", "", "junk", "u/usgs_13_N37W122_20110101.tif ", "v/USGS_13_n38w122_20120101.tif", "w/USGS_13_n38w122_20120101.tif"]
    tiles_of, other = files.download_list(spark.createDataFrame(list(enumerate(lines)), "pos long, line string"))
    files.write_download_list(spark, tiles_of, str(tmp_path / "list.txt"))
    assert (tmp_path / "list.txt").read_text() == "v/USGS_13_n38w122_20120101.tif\nu/usgs_13_N37W122_20110101.tif\n"
    assert [r.url for r in other.collect()] == ["junk"]


def test_polygons(spark):
    line = np.array([[0, 0], [1, 0.05], [2, 0], [3, 1], [4, 0.0]])
    assert polygons.thinned(line, 0.1).tolist() == [True, False, True, True, True]
    rings = spark.createDataFrame([(1, 0, [0.0, 1.0, 2.0, 2.0, 0.0, 0.0], [0.0, 0.00001, 0.0, 2.0, 2.0, 0.0]), (2, 0, [0.0, 1.0, 0.5, 0.0], [0.0, 0.0, 0.0, 0.0])], "poly long, ring int, x array<double>, y array<double>")
    thin = polygons.simplified(rings, 0.01)
    assert {r.poly: len(r.x) for r in thin.collect()} == {1: 5, 2: 4}
    document = json.loads(polygons.with_provenance(polygons.feature_collection(thin.filter("poly = 1"), "n", "s").first().json, 1, "sha256:x"))
    assert document["features"][0]["geometry"] == {"type": "MultiPolygon", "coordinates": [[[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]]]}
    assert document["provenance"] == {"version": 1, "inputs_sha256": "sha256:x"}
    shapes = spark.createDataFrame([(1, 20.0), (2, 50.0), (3, 60.0)], "poly int, south double")
    assert [r.poly for r in polygons.south_of(shapes).collect()] == [1]
    features = spark.createDataFrame([(("United States of America", "Country"), 1), (("United States of America", "Dependency"), 2), (("France", "Country"), 3)], "properties struct<ADMIN:string,TYPE:string>, geometry int")
    assert [r.geometry for r in polygons.country(features).collect()] == [1]
    cells = spark.createDataFrame([(0, 0), (0, 1)], "row int, col int")
    assert rasters.without_cells(cells, cells.filter("col = 1")).collect()[0].col == 0


def test_boxes_enter_the_ledger_after_their_run(spark, tmp_path):
    rows = [("box_000", 38.0, -123.0, 37.0, -122.0, "h"), ("box_001", 39.0, -123.0, 38.0, -122.0, "h")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, BOXES).write.parquet(source)
    ran = []
    go = lambda n, run: run_incrementally(spark.readStream.schema(BOXES).parquet(source), str(tmp_path / "ledger"), str(tmp_path / f"c{n}"), run).awaitTermination()
    with pytest.raises(Exception):
        go(0, lambda todo: 1 / 0)
    assert not (tmp_path / "ledger").exists()
    go(1, lambda todo: ran.extend(r.name for r in todo.collect()))
    go(2, lambda todo: ran.append("again"))
    assert sorted(ran) == ["box_000", "box_001"] and {r.version for r in spark.read.parquet(str(tmp_path / "ledger")).collect()} == {1}


def test_vectors_cache_and_frozen_tiles(spark, tmp_path):
    from vespera.sources import vectors

    rows = vectors.bit_vectors(spark, {"production": LAYOUT, "wide": BitLayout(200, 360, 2)}, [233, 270, 310, 203])
    got = {(r.config, r.azimuth): (r.bit_index, r.byte_offset, r["mask"]) for r in rows.collect()}
    assert got["production", 270.0] == (37, 4, 32) and got["production", 310.0] == (None, None, None) and got["production", None] == (77, 9, 32)
    assert got["wide", 203.0] == (2, 0, 4) and got["wide", None] == (81, 10, 2)
    vectors.write_vectors_header(spark, rows, str(tmp_path / "v.h"))
    assert '{"production", 270, 37, 4, 32},' in (tmp_path / "v.h").read_text()
    loads, counter = [], spark.sparkContext.accumulator(0)
    cache = vectors.TileCache(lambda k: loads.append(k) or k, 2, counter)
    assert [cache(k) for k in ((1, 1), (2, 2), (1, 1), (3, 3), (1, 1), (2, 2))][-1] == (2, 2)
    assert loads == [(1, 1), (2, 2), (3, 3), (2, 2)] and cache.missed == counter.value == 4
    tiles_of = spark.createDataFrame([(1, 1, 5), (2, 2, 6)], "south int, west int, v int")
    assert [r.v for r in vectors.frozen(tiles_of, spark.createDataFrame([(1, 1), (9, 9)], "south int, west int")).collect()] == [5]


def test_rasterised_runs_are_the_cells_of_fill(spark):
    ring = [(36.05, -121.95), (36.05, -121.1), (36.7, -120.4), (36.95, -121.9)]
    edges = spark.createDataFrame([(1, a[1], a[0], b[1], b[0]) for a, b in zip(ring, ring[1:] + ring[:1])], "poly int, x0 double, y0 double, x1 double, y1 double")
    index = water.tile_index(spark.createDataFrame([(1, -121.95, 36.05, -120.4, 37.0)], "poly int, west double, south double, east double, north double"))
    assert {(r.south, r.west) for r in index.collect()} == {(36, -122), (36, -121)}
    rows = {(r.west, r.r, c) for r in water.rasterised(edges, index, 20).collect() for c in range(20) if r.words[c // 32] >> c % 32 & 1}
    inside = set()
    for west in (-122, -121):
        for r in range(20):
            for c in range(20):
                y, x = 37 - (r + 0.5) / 20, west + (c + 0.5) / 20
                crossings = sum((a[0] > y) != (b[0] > y) and x < a[1] + (y - a[0]) * (b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(ring, ring[1:] + ring[:1]))
                if crossings % 2:
                    inside.add((west, r, c))
    assert rows == inside
