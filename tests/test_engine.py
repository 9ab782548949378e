import math

import duckdb
import pytest
from pyspark.sql import functions as F

from vespera.config import PRODUCTION, BitLayout, PipelineConfig
from vespera.functions import bits, geo
from vespera.operators import rasters, terrain
from vespera.plans import file_queries, grid_queries, packed_queries, queries as plans, sweep_queries, vector_queries  # noqa: F401  register their queries
from vespera.sources import text as sources

SF = "/root/testdata/sf0.001"


def test_bit_contract(spark):
    assert (PRODUCTION.bit_count, PRODUCTION.bytes_per_pixel, PRODUCTION.flag_bit) == (77, 10, 77)
    wide = BitLayout(200, 360, 2)
    assert (wide.bit_count, wide.bytes_per_pixel, wide.flag_bit) == (81, 11, 81)
    assert PRODUCTION.bit_index(270) == 37 and wide.bit_index(203) == 2
    rejected = [232.4, 310.0, 100.0]
    assert all(PRODUCTION.bit_index(x) is None for x in rejected)
    rows = spark.createDataFrame([(x,) for x in [270.0, *rejected]], "a double").select(bits.bit_index(F.col("a"), PRODUCTION)).collect()
    assert [r[0] for r in rows] == [37, None, None, None]


def test_config_rules():
    keys = "refraction_coefficient_k earth_radius_m observer_eye_height_m cell_per_degree meters_per_degree_lat azimuth_min_deg azimuth_max_deg azimuth_step_deg strip_height_deg coast_march_max_km worker_threads dem_lru_capacity ocean_lru_capacity dem_dir osm_water_polygons_path"
    text = "no equals sign\n" + "\n".join(f"{k} = 1 # note" for k in keys.split()) + "\nearth_radius_m = 6371000"
    config = PipelineConfig.parse(text)
    assert config.earth_radius_m == 6371000 and config.dem_dir == "1" and config.west_edge_max_land_frac == 0.05
    assert config.curvature == 0  # refraction over one half
    with pytest.raises(KeyError):
        PipelineConfig.parse("dem_dir = x")


C, EYE, S = 5.80757e-8, 2.0, 10.0


def visible(spark, heights, skip=0.0, coast=2):
    rows = [(0, 0.0, 1, k, None if k < coast else heights(k - coast), k < coast) for k in range(coast + 900)]
    df = spark.createDataFrame(rows, "strip int, az double, j long, k long, h double, water boolean")
    return {r.k - coast: r.visible for r in terrain.verdicts(df, S, C, EYE, skip).collect()}


def test_flat_land_sees_to_its_horizon(spark):
    got, reach = visible(spark, lambda i: 0.0), math.sqrt(EYE / C)
    assert all(v == (i * S <= reach) for i, v in got.items() if abs(i * S - reach) > S)


def test_ridge_hides_what_is_behind(spark):
    got = visible(spark, lambda i: 500.0 if i == 150 else 0.0)
    assert got[149] and got[150] and not any(got[i] for i in range(151, 580))


def test_foreshore_skip_and_missing_heights(spark):
    berm = lambda i: 1.5 * EYE if i < 3 else None
    assert not visible(spark, berm)[20] and visible(spark, berm, skip=100.0)[20]
    assert visible(spark, lambda i: float("nan"))[20]


def test_no_land_no_verdicts(spark):
    df = spark.createDataFrame([(0, 0.0, 1, k, 0.0, True) for k in range(5)], "strip int, az double, j long, k long, h double, water boolean")
    assert terrain.verdicts(df, S, C, EYE).count() == 0


def test_merge_midline_and_ties(spark):
    boxes = spark.createDataFrame([(0, 0, 0, 10, 8), (1, 6, 0, 10, 8)], "src int, row_off int, col_off int, height int, width int")
    pixels = boxes.select("src", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("row")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("v", F.col("src") + 7)
    got = {(r.row, r.col): (r.src, r.v) for r in rasters.merge_deepest(pixels, boxes, "v").collect()}
    assert len(got) == 16 * 8 and got[7, 0] == (0, 7) and got[8, 0] == (1, 8)
    assert got[7, 7][0] == got[8, 7][0] == 0  # the eastern edge is equally near: the first wins


def test_fill_with_hole(spark):
    ring = lambda a, b: [(a, a, b, a), (b, a, b, b), (b, b, a, b), (a, b, a, a)]
    edges = spark.createDataFrame([(1, *map(float, e)) for e in ring(0, 8) + ring(2, 6)], "poly int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.row, r.col) for r in rasters.fill(edges, 8, 8).collect()}
    assert got == {(r, c) for r in range(8) for c in range(8)} - {(r, c) for r in range(2, 6) for c in range(2, 6)}


def test_sunset_and_legacy_byte(spark):
    days = spark.sql("select date'2024-06-21' day, 38D lat, 0 n union all select date'2024-12-21', 38D, 1 union all select date'2024-06-21', 80D, 2")
    row = [r.azimuth for r in geo.sunset_azimuths(days).orderBy("n").collect()]
    assert 299 <= row[0] <= 304 and 238 <= row[1] <= 244 and row[2] is None
    assert [r[0] for r in spark.createDataFrame([(270.0,), (200.0,), (360.0,)], "a double").select(bits.legacy_byte(F.col("a"))).collect()] == [112, 0, 255]


def test_dem_discovery(spark):
    names = "USGS_13_n37w122_20100929.tif USGS_13_n38w122_20100929.tif USGS_13_n38w122_20250826.tif USGS_13_n39w123_20250520.tif USGS_13_n39w123_20250520_v2.tif README.txt".split()
    got = {(r.south, r.west): r.name for r in sources.dem_tiles(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {(36, -122): names[0], (37, -122): names[2], (38, -123): names[4]}


def test_manifest_and_clip(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"boxes": [{"top_left": [38, -123], "bottom_right": [37, -122]}]}')
    assert sources.manifest(spark, str(tmp_path / "m.json")).first().asDict() == {"box_idx": 0, "name": "box_000", "north": 38.0, "west": -123.0, "south": 37.0, "east": -122.0}
    (tmp_path / "c.json").write_text('{"type": "Polygon", "coordinates": [[[2, 0], [5, 0], [5, 4], [2, 0]]]}')
    assert sources.clip_rings(spark, str(tmp_path / "c.json")).count() == 4


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = plans.QUERIES[name](spark, SF)
    want = db.execute(plans.SQL[name])
    columns = [c[0] for c in want.description]
    rounded = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = lambda rs: sorted(repr([rounded(v) for v in r]) for r in rs)
    assert sorted(columns) == sorted(df.columns) and rows(df.select(columns).collect()) == rows(want.fetchall())
