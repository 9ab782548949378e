"""Merging by runs, map rows, tiles and pyramids as bytes, against the forms with a row for each pixel."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vespera.config import BitLayout
from vespera.operators import packed, rasters, runs
from vespera.sources import text, tiles

LAYOUT = BitLayout(233, 309, 1)
SIZE = LAYOUT.bytes_per_pixel


def deepest(boxes, row):
    """Winners of a row, pixel by pixel."""
    out = {}
    for src, ro, co, h, w in boxes:
        if ro <= row < ro + h:
            for c in range(w):
                depth = min(row - ro + 0.5, h - (row - ro) - 0.5, w - c - 0.5)
                if co + c not in out or (depth, -src) > out[co + c]:
                    out[co + c] = depth, -src
    return {c: -s for c, (_, s) in out.items()}


def test_runs_are_the_deepest_boxes():
    rng = random.Random(1)
    for _ in range(400):
        boxes = [(i, rng.randint(0, 6), rng.randint(0, 15), rng.randint(1, 12), rng.randint(1, 20)) for i in rng.sample(range(50), rng.randint(1, 7))]
        boxes += [(90, *boxes[0][1:])] if rng.random() < 0.3 else []  # an equal one, and one inside another
        for row in range(18):
            spans = [(s, co, co + w, min(row - ro + 0.5, h - (row - ro) - 0.5)) for s, ro, co, h, w in boxes if ro <= row < ro + h]
            rng.shuffle(spans)
            found = packed.row_runs(spans)
            assert {c: s for a, b, s in found for c in range(a, b + 1)} == deepest(boxes, row)
            assert all(x[1] + 1 < y[0] or x[2] != y[2] for x, y in zip(found, found[1:])) and found == sorted(found)


def masks_of(rng, boxes):
    return {s: rng.integers(0, 256, (h, w, SIZE)).astype(np.uint8) for s, _, _, h, w in boxes}


def test_bytes_from_boxes_to_tiles_equal_the_pixel_forms(spark):
    """Overlaps, a tie, a box inside another, a gap, and tiles with odd neighbours."""
    rng = np.random.default_rng(4)
    boxes = [(0, 0, 0, 10, 9), (1, 4, 3, 12, 12), (2, 4, 3, 12, 12), (5, 6, 6, 4, 4), (7, 18, 0, 3, 20)]
    held = masks_of(rng, boxes)
    held[1][:, 2:5] = 0
    table = spark.createDataFrame(boxes, "src int, row_off int, col_off int, height int, width int")
    rows = spark.createDataFrame([(s, r, m[r].tobytes()) for s, m in held.items() for r in range(len(m))], "src int, row int, mask binary")
    height, width = 21, 20
    merged = packed.merged_rows(rows, table, width, SIZE)
    full = np.zeros((height, width, SIZE), np.uint8)
    for row in range(height):
        for c, s in deepest(boxes, row).items():
            ro, co = next(b[1:3] for b in boxes if b[0] == s)
            full[row, c] = held[s][row - ro, c - co]
    got = {r.row: r.mask for r in merged.collect()}
    assert got == {r: full[r].tobytes() for r in range(height) if r not in (16, 17)}

    words = [f"w{k}" for k in range(LAYOUT.words)]
    values = np.pad(full, ((0, 0), (0, 0), (0, 12 - SIZE))).view("<u4").astype(np.int64)
    pixels = spark.createDataFrame([(r, c, *map(int, values[r, c])) for r in range(height) for c in range(width)], "row int, col int, " + ", ".join(f"{w} long" for w in words))
    slow = rasters.reproject(pixels, 37.0, -122.0, 37.0 + 20 / 60, -122.0 + 19 / 60, 60, 11, words, 16)
    slow_tiles = tiles.pack_tiles(rasters.pyramid(slow, 3, words), LAYOUT, 16)
    fast = packed.tiles_of_rows(packed.reproject_rows(merged, 37.0, -122.0, height, width, 60, 11, SIZE, 16), SIZE, 16)
    fast_tiles = packed.pyramid_payloads(fast, 3, LAYOUT, 16)
    expected = {(r.z, r.x, r.y): bytes(r.payload) for r in slow_tiles.collect()}
    assert len({k[0] for k in expected}) == 4 and {(r.z, r.x, r.y): bytes(r.payload) for r in fast_tiles.collect()} == expected


def test_a_pyramid_reads_each_level_once(spark):
    base = packed.tiles_of_rows(spark.createDataFrame([(5, 3, 0, b"\1" * SIZE * 40)], "z int, row long, col long, mask binary"), SIZE, 16)
    plan = packed.pyramid_payloads(base, 4, LAYOUT, 16)
    assert {r.z for r in plan.collect()} == {1, 2, 3, 4, 5}
    assert plan._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 4


def test_empty_inputs(spark):
    boxes = spark.createDataFrame([], "src int, row_off int, col_off int, height int, width int")
    assert packed.merge_runs(boxes).count() == 0
    rows = spark.createDataFrame([], "z int, row long, col long, mask binary")
    assert packed.pyramid_payloads(packed.tiles_of_rows(rows, SIZE, 16), 2, LAYOUT, 16).count() == 0
    dark = spark.createDataFrame([(3, 5, 7, bytes(SIZE * 30))], "z int, row long, col long, mask binary")
    assert packed.tiles_of_rows(dark, SIZE, 16).count() == 0


def test_manifest_names_keep_their_order(spark, tmp_path):
    import json

    box = {"top_left": [38.0, -123.0], "bottom_right": [37.0, -122.0]}
    for n, last in ((1, "box_000"), (1000, "box_999"), (1001, "box_1000")):
        (tmp_path / f"{n}.json").write_text(json.dumps({"output_dir": "x", "boxes": [box] * n}))
        names = [r.name for r in text.manifest(spark, str(tmp_path / f"{n}.json")).orderBy("box_idx").collect()]
        assert names[-1] == last and names == sorted(names) and len(set(names)) == n
    for bad in ({"boxes": []}, {"output_dir": "x"}, {"boxes": None}):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(Exception, match="at least one box"):
            text.manifest(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "bad.json").write_text(json.dumps({"boxes": [{"top_left": [1.0], "bottom_right": [0.0, 0.0]}]}))
    with pytest.raises(Exception, match="two numbers"):
        text.manifest(spark, str(tmp_path / "bad.json")).collect()


def test_inputs_hash_is_of_a_document_with_blanks(spark):
    import hashlib
    import json

    boxes = [(1, 38.0, -122.5, 37.25, 1e-05), (0, 39.0, -123.0, 38.0, -122.0)]
    got = runs.inputs_hash(spark.createDataFrame(boxes, "box_idx int, north double, west double, south double, east double"), "land").first().hash
    document = json.dumps({"boxes": [list(b[1:]) for b in sorted(boxes)], "us_land_sha256": hashlib.sha256(b"land").hexdigest()}, sort_keys=True)
    assert got == "sha256:" + hashlib.sha256(document.encode()).hexdigest()


def test_a_row_holds_no_more_pieces_than_its_columns_allow(spark, monkeypatch):
    """Thousands of boxes over few columns: the sweep of a row gets the different pieces, and the runs are those of all boxes."""
    few = [(i, i % 2, i % 3, i % 4 + 1, i % 5 + 1) for i in range(60)]
    table = spark.createDataFrame(few, "src int, row_off int, col_off int, height int, width int")
    many = table.crossJoin(spark.range(200)).select((F.col("src") + 60 * F.col("id")).alias("src"), "row_off", "col_off", "height", "width")
    expected = sorted((row, a, b, s) for row in range(6) for a, b, s in packed.row_runs([(s, co, co + w, min(row - ro + 0.5, h - (row - ro) - 0.5)) for s, ro, co, h, w in few if ro <= row < ro + h]))
    assert sorted(tuple(r) for r in packed.merge_runs(many).collect()) == expected
    assert packed.row_pieces(many).count() == packed.row_pieces(table).count()
