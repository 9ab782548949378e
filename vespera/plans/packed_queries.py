"""Queries of masks as bytes, from boxes to map tiles, and of manifests, with SQL over single pixels and boxes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from vespera.config import BitLayout
from vespera.functions import geo
from vespera.operators import lattice, packed, rings, runs
from vespera.plans.queries import _table, query
from vespera.sources import text, tiles


@query("""WITH b AS (SELECT c_custkey AS src, c_custkey * 7 % 400 AS ro, c_custkey * 13 % 90 AS co, 1 + c_custkey % 23 AS h, 1 + c_custkey % 31 AS w FROM customer),
p AS (SELECT src, ro + r AS r, co + c AS c, least(r + 0.5, h - r - 0.5, w - c - 0.5) AS depth FROM b, LATERAL (SELECT unnest(range(0, h)) AS r), LATERAL (SELECT unnest(range(0, w)) AS c)),
m AS (SELECT r, c, arg_max(src, depth * 1000000 - src) AS src FROM p GROUP BY r, c), i AS (SELECT *, c - row_number() OVER (PARTITION BY r, src ORDER BY c) AS island FROM m)
SELECT r::BIGINT AS "row", min(c)::BIGINT AS a, max(c)::BIGINT AS b, src FROM i GROUP BY r, src, island""")
def merge_runs_a3_j7_w4_o5_u1(spark, sf_dir):
    """Runs of lattice rows by the box they lie deepest in, of many boxes that overlap, some of one row or column."""
    k = F.col("c_custkey")
    return packed.merge_runs(_table(spark, sf_dir, "customer").select(k.alias("src"), (k * 7 % 400).alias("row_off"), (k * 13 % 90).alias("col_off"), (k % 23 + 1).alias("height"), (k % 31 + 1).alias("width")))


#: A lattice of 60 points a degree, and the map pixels around it at the zoom of tiles of 16 pixels.
SOUTH, WEST, ROWS, COLS, ZOOM, TILE = 37.0, -123.0, 90, 40, 11, 16
LAYOUT = BitLayout(0.0, 4.0, 1.0)
_N = TILE * 2**ZOOM
_Y = lambda lat: 0.5 - math.log((1 + math.sin(math.radians(lat))) / (1 - math.sin(math.radians(lat)))) / (4 * math.pi)
_MAP_ROWS = math.floor(_Y(SOUTH + ROWS / 60 + 0.1) * _N), math.ceil(_Y(SOUTH - 0.1) * _N)
_MAP_COLS = math.floor((WEST - 0.1 + 180) / 360 * _N), math.ceil((WEST + COLS / 60 + 0.1 + 180) / 360 * _N)


@query(f"""WITH b AS (SELECT n_nationkey AS src, n_nationkey * 3 AS ro, n_nationkey % 5 * 6 AS co, 6 + n_nationkey % 10 AS h, 8 + n_nationkey % 7 AS w FROM nation),
p AS (SELECT src, ro + r AS r, co + c AS c, (src * 7 + r * 3 + c * c) % 64 * ((r + c) % 3) % 64 AS v, least(r + 0.5, h - r - 0.5, w - c - 0.5) AS depth FROM b, LATERAL (SELECT unnest(range(0, h)) AS r), LATERAL (SELECT unnest(range(0, w)) AS c)),
m AS (SELECT r, c, arg_max(v, depth * 1000 - src) AS v FROM p GROUP BY r, c),
y AS (SELECT mr, floor((degrees(atan((exp(t) - exp(-t)) / 2)) - 37) * 60 + 0.5)::BIGINT AS r FROM (SELECT mr, (0.5 - (mr + 0.5) / {_N}::DOUBLE) * 2 * pi() AS t FROM range({_MAP_ROWS[0]}, {_MAP_ROWS[1]}) x(mr))),
x AS (SELECT mc, floor((((mc + 0.5) / {_N}::DOUBLE * 360 - 180) + 123) * 60 + 0.5)::BIGINT AS c FROM range({_MAP_COLS[0]}, {_MAP_COLS[1]}) x(mc)),
z AS (SELECT mr, mc, v FROM m JOIN y USING (r) JOIN x USING (c) WHERE v <> 0), l AS (SELECT unnest(range(0, 4)) AS d)
SELECT ({ZOOM} - d)::INT AS z, (mr >> d::INT)::BIGINT AS "row", (mc >> d::INT)::BIGINT AS col, bit_or(v)::BIGINT AS w0 FROM z, l GROUP BY ALL""")
def packed_tiles_a2_a3_a9_k7_p31(spark, sf_dir):
    """Boxes merged, brought onto the map and reduced to coarser tiles, as bytes throughout; the tiles' pixels at last."""
    k = F.col("n_nationkey")
    boxes = _table(spark, sf_dir, "nation").select(k.alias("src"), (k * 3).alias("row_off"), (k % 5 * 6).alias("col_off"), (k % 10 + 6).alias("height"), (k % 7 + 8).alias("width"))
    lines = boxes.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    value = lambda c: F.lpad(F.hex(((F.col("src") * 7 + F.col("row") * 3 + c * c) % 64 * ((F.col("row") + c) % 3) % 64).cast("long")), 2, F.lit("0"))
    lines = lines.select("src", "row", F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") - 1), value), "")).alias("mask"))
    merged = packed.merged_rows(lines, boxes, COLS, LAYOUT.bytes_per_pixel)
    on_map = packed.reproject_rows(merged, SOUTH, WEST, ROWS, COLS, 60, ZOOM, LAYOUT.bytes_per_pixel, TILE)
    return tiles.unpack_tiles(packed.pyramid_payloads(packed.tiles_of_rows(on_map, LAYOUT.bytes_per_pixel, TILE), 3, LAYOUT, TILE), LAYOUT, TILE)


@query("""WITH m AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN c_nationkey ELSE 100 END AS manifest, c_custkey FROM customer), i AS (SELECT *, row_number() OVER (PARTITION BY manifest ORDER BY c_custkey) - 1 AS k, count(*) OVER (PARTITION BY manifest) AS n FROM m)
SELECT manifest::INT AS manifest, k::INT AS box_idx, 'box_' || lpad(k::VARCHAR, greatest(3, length((n - 1)::VARCHAR))::INT, '0') AS name, c_custkey / 10.0::DOUBLE AS north, 0.0::DOUBLE - c_custkey AS west, c_custkey / 10.0::DOUBLE - 1 AS south, 1.0::DOUBLE - c_custkey AS east FROM i""")
def manifests_s14(spark, sf_dir):
    """Boxes of one manifest of more than a thousand and of some short ones; names sort as the boxes stand."""
    k = F.col("c_custkey")
    corner = lambda lat, lon: F.array(lat.cast("double"), lon.cast("double"))
    box = F.struct(corner(k / F.lit(10.0), -k).alias("top_left"), corner(k / F.lit(10.0) - 1, 1 - k).alias("bottom_right"))
    held = _table(spark, sf_dir, "customer").groupBy(F.when(k % 4 == 0, F.col("c_nationkey")).otherwise(100).cast("int").alias("manifest")).agg(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), box.alias("b")))), lambda x: x["b"]).alias("boxes"))  # as long as a manifest
    return text.named_boxes(held)


@query("""WITH s AS (SELECT s_suppkey AS src, CASE WHEN s_suppkey % 11 = 5 THEN 78 ELSE 77 END AS bits, CASE WHEN s_suppkey % 7 = 3 THEN NULL WHEN s_suppkey % 5 = 4 THEN 'EPSG:3857' ELSE 'EPSG:4326' END AS crs,
  (1 / 10800.0::DOUBLE) * (1 + s_suppkey % 4 * 5e-7::DOUBLE) AS cx, (1 / 10800.0::DOUBLE) * (1 - s_suppkey % 3 * 9e-7::DOUBLE) AS cy FROM supplier), f AS (SELECT * FROM s ORDER BY src LIMIT 1),
w AS (SELECT s.src, CASE WHEN s.bits <> f.bits THEN 'contract' WHEN s.crs IS DISTINCT FROM f.crs THEN 'crs' WHEN abs(s.cx - f.cx) > greatest(abs(s.cx), abs(f.cx)) * 1e-6 OR abs(s.cy - f.cy) > greatest(abs(s.cy), abs(f.cy)) * 1e-6 THEN 'cell' END AS why FROM s, f)
SELECT src, why FROM w WHERE why IS NOT NULL""")
def unlike_sources_j9(spark, sf_dir):
    """Sources that can't be merged with the first one, and why."""
    k = F.col("s_suppkey")
    side = F.lit(1 / 10800)
    s = _table(spark, sf_dir, "supplier").select(k.alias("src"), F.when(k % 11 == 5, 78).otherwise(77).alias("bit_count"), F.when(k % 7 == 3, None).when(k % 5 == 4, "EPSG:3857").otherwise("EPSG:4326").alias("crs"), (side * (1 + k % 4 * F.lit(5e-7))).alias("cell_x"), (side * (1 - k % 3 * F.lit(9e-7))).alias("cell_y"))
    return lattice.unlike(s, ["bit_count"])


@query("""WITH c AS (SELECT n_nationkey, floor(30 + n_nationkey * 1.3::DOUBLE)::INT AS south, floor(-120.5 - n_nationkey * 0.7::DOUBLE)::INT AS west FROM nation) SELECT n_nationkey, south, west, (south + 1)::INT AS n, (-west)::INT AS w FROM c""")
def tile_names_p18(spark, sf_dir):
    k = F.col("n_nationkey")
    south, west = geo.tile_of(30 + k * F.lit(1.3), F.lit(-120.5) - k * F.lit(0.7))
    out = _table(spark, sf_dir, "nation").select("n_nationkey", south.alias("south"), west.alias("west"))
    n, w = geo.north_west_corner(F.col("south"), F.col("west"))
    return out.select("*", n.alias("n"), w.alias("w"))


@query("""WITH b AS (SELECT r_regionkey, n_nationkey AS k, 30 + n_nationkey / 4.0::DOUBLE AS north, -120.0 - n_nationkey::DOUBLE AS west, 29 + n_nationkey / 4.0::DOUBLE AS south, -119.5 - n_nationkey::DOUBLE AS east FROM nation JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT r_regionkey, '{"boxes": [' || string_agg('[' || north || ', ' || west || ', ' || south || ', ' || east || ']', ', ' ORDER BY k) || '], "us_land_sha256": "' || sha256('outline ' || r_regionkey) || '"}' AS doc FROM b GROUP BY r_regionkey)
SELECT r_regionkey, 'sha256:' || sha256(doc) AS hash FROM t""")
def inputs_hashes_p40(spark, sf_dir) -> DataFrame:
    """The freshness key of five lists of boxes."""
    k, out = F.col("n_nationkey"), None
    boxes = _table(spark, sf_dir, "nation").select("n_regionkey", k.cast("int").alias("box_idx"), (30 + k / F.lit(4.0)).alias("north"), (-120.0 - k).alias("west"), (29 + k / F.lit(4.0)).alias("south"), (-119.5 - k).alias("east"))
    for region in range(5):
        one = runs.inputs_hash(boxes.filter(F.col("n_regionkey") == region), f"outline {region}").select(F.lit(region).alias("r_regionkey"), "hash")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH RECURSIVE s AS (SELECT c_custkey AS k FROM customer), cells AS (SELECT DISTINCT k * 7919 % 40 AS r, k * 104729 // 7 % 40 AS c FROM s WHERE k % 10 < 9 UNION SELECT r, c FROM range(10, 20) x(r), range(12, 30) y(c) WHERE NOT (r BETWEEN 13 AND 16 AND c BETWEEN 15 AND 20)),
e AS (SELECT c AS x0, r AS y0, c + 1 AS x1, r AS y1, 0 AS way FROM cells UNION ALL SELECT c + 1, r, c + 1, r + 1, 1 FROM cells UNION ALL SELECT c + 1, r + 1, c, r + 1, 2 FROM cells UNION ALL SELECT c, r + 1, c, r, 3 FROM cells),
b AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.x0 = e.x1 AND o.y0 = e.y1 AND o.x1 = e.x0 AND o.y1 = e.y0)),
n AS (SELECT b.x0, b.y0, b.x1, b.y1, b.way, arg_min(o.way, CASE WHEN o.way = (b.way + 1) % 4 THEN 0 ELSE 1 END) AS then_way FROM b JOIN b o ON o.x0 = b.x1 AND o.y0 = b.y1 GROUP BY ALL),
corners AS (SELECT x1 AS x, y1 AS y, then_way AS way FROM n WHERE then_way <> way),
walk AS (SELECT x, y, way, x AS cx, y AS cy, way AS cway, 0 AS step, 0::BIGINT AS turns, 0.0::DOUBLE AS area FROM corners
  UNION ALL SELECT w.x, w.y, w.way, n.x1, n.y1, n.then_way, step + 1, turns + CASE WHEN n.then_way <> n.way THEN 1 ELSE 0 END, area + (n.x0 * n.y1 - n.x1 * n.y0) / 2.0::DOUBLE FROM walk w JOIN n ON n.x0 = w.cx AND n.y0 = w.cy AND n.way = w.cway
    WHERE (step = 0 OR (w.cx, w.cy, w.cway) <> (w.x, w.y, w.way)) AND ((w.cy << 34) + (w.cx << 2) + w.cway) >= ((w.y << 34) + (w.x << 2) + w.way))
SELECT ((y << 34) + (x << 2) + way)::BIGINT AS ring, turns AS corners, area FROM walk WHERE step > 0 AND (cx, cy, cway) = (x, y, way)""")
def rings_k11_j14(spark, sf_dir):
    """Rings around scattered cells and a block with a hole: their least run, corners and signed areas."""
    k = F.col("c_custkey")
    some = _table(spark, sf_dir, "customer").filter(k % 10 < 9).select((k * 7919 % 40).alias("row"), (F.floor(k * 104729 / 7) % 40).alias("col"))
    block = spark.range(180).select((10 + F.floor(F.col("id") / 18)).alias("row"), (12 + F.col("id") % 18).alias("col")).filter("NOT (row BETWEEN 13 AND 16 AND col BETWEEN 15 AND 20)")
    return rings.areas(rings.ring_points(some.unionByName(block)))
