"""Queries that run the operators of grids, water, boxes and files over the driver's tables, with SQL written from their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vespera.config import PRODUCTION, PipelineConfig
from vespera.operators import editor, lattice, polygons, rasters, runs, sweep, water
from vespera.plans.queries import SAMPLES_SQL, _table, judged, query
from vespera.sources import files, text

#: A coarse grid, so that one azimuth's samples are few.
COARSE = PipelineConfig(0.13, 6371000.0, 2.0, 60.0, 111320.0, 270.0, 270.0, 1.0, 0.1, 200.0, 1, 1, 1, "", "", sample_spacing_arcsec=40.0, strip_tilt_margin_deg=0.65)


@query(SAMPLES_SQL + "SELECT max(n)::BIGINT AS longest FROM (SELECT count(*) AS n FROM v GROUP BY j)")
def longest_ray_a11(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("j").agg(F.count("*").alias("n")).agg(F.max("n").alias("longest"))


_LINES = """WITH l AS (SELECT event_id AS pos, CASE WHEN event_id % 11 = 0 THEN ' notes ' || event_id WHEN event_id % 13 = 0 THEN '  ' ELSE
  'https://host/' || CASE WHEN event_id % 3 = 0 THEN 'usgs_13_N' ELSE 'USGS_13_n' END || (30 + user_id % 10) || 'w' || (100 + user_id % 7) || '_' || strftime(ts, '%Y%m%d') || '.tif ' END AS line FROM events) """


def download_lines(spark, sf_dir) -> DataFrame:
    e, k = _table(spark, sf_dir, "events"), F.col("event_id")
    name = F.concat(F.lit("https://host/"), F.when(k % 3 == 0, "usgs_13_N").otherwise("USGS_13_n"), (30 + F.col("user_id") % 10).cast("string"), F.lit("w"), (100 + F.col("user_id") % 7).cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd"), F.lit(".tif "))
    return e.select(k.alias("pos"), F.when(k % 11 == 0, F.concat(F.lit(" notes "), k.cast("string"))).when(k % 13 == 0, "  ").otherwise(name).alias("line"))


@query(_LINES + """, m AS (SELECT pos, trim(line) AS url, lower(regexp_extract(line, '(?i)USGS_13_([a-z][0-9]+[a-z][0-9]+)_([0-9]{8})[.]tif', 1)) AS tile, regexp_extract(line, '_([0-9]{8})[.]tif', 1) AS d FROM l)
SELECT tile, min(pos) AS first_seen, arg_max(url, (d, -pos)) AS url FROM m WHERE tile <> '' GROUP BY tile""")
def downloads_s16_w7(spark, sf_dir):
    return files.download_list(download_lines(spark, sf_dir))[0]


@query(_LINES + "SELECT pos, trim(line) AS url FROM l WHERE trim(line) LIKE 'notes %'")
def unmatched_downloads_s16(spark, sf_dir):
    return files.download_list(download_lines(spark, sf_dir))[1]


@query("""WITH f AS (SELECT c_custkey AS k, 30 + c_custkey % 15 AS n, 100 + c_custkey % 9 AS w, 20000101 + c_custkey % 28 AS d FROM customer), t AS (SELECT n - 1 AS south, -w AS west, CASE WHEN k % 5 = 0 THEN 0 ELSE d END AS date, 'USGS_13_n' || n || 'w' || w || '_' || CASE WHEN k % 5 = 0 THEN '' ELSE d::VARCHAR END || '_' || k || CASE WHEN k % 17 = 0 THEN '.txt' ELSE '.tif' END AS name FROM f)
SELECT south::INT AS south, west::INT AS west, arg_max(name, (date, name)) AS name FROM t WHERE name LIKE '%.tif' GROUP BY ALL""")
def elevation_files_s2_a8_o5(spark, sf_dir):
    k = F.col("c_custkey")
    date = F.when(k % 5 == 0, "").otherwise((20000101 + k % 28).cast("string"))
    name = F.concat(F.lit("USGS_13_n"), (30 + k % 15).cast("string"), F.lit("w"), (100 + k % 9).cast("string"), F.lit("_"), date, F.lit("_"), k.cast("string"), F.when(k % 17 == 0, ".txt").otherwise(".tif"))
    return text.dem_tiles(_table(spark, sf_dir, "customer").select(name.alias("name")))


_SOURCES = """WITH s AS (SELECT n_nationkey AS src, -123 + n_nationkey % 7 * 0.23::DOUBLE AS west, 38 - n_nationkey % 6 * 0.17::DOUBLE AS north, 10 + n_nationkey % 3 AS height, 12 + n_nationkey % 4 AS width FROM nation) """


def sources(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    return _table(spark, sf_dir, "nation").select(k.alias("src"), (-123 + k % 7 * F.lit(0.23)).alias("west"), (38 - k % 6 * F.lit(0.17)).alias("north"), (10 + k % 3).alias("height"), (12 + k % 4).alias("width"))


@query(_SOURCES + """, o AS (SELECT *, round_even(((SELECT max(north) FROM s) - north) / 0.1::DOUBLE, 0)::BIGINT AS row_off, round_even((west - (SELECT min(west) FROM s)) / 0.1::DOUBLE, 0)::BIGINT AS col_off FROM s)
SELECT src, row_off, col_off, (SELECT max(row_off + height) FROM o)::BIGINT AS out_height, (SELECT max(col_off + width) FROM o)::BIGINT AS out_width FROM o""")
def lattice_p28_a7(spark, sf_dir):
    return lattice.snap(sources(spark, sf_dir), 0.1).select("src", "row_off", "col_off", "out_height", "out_width")


@query("""WITH s AS (SELECT s_suppkey AS src, 233.0::DOUBLE AS lo, 309.0 + CASE WHEN s_suppkey % 5 = 4 THEN 1 ELSE 0 END AS hi, CASE WHEN s_suppkey % 7 = 3 THEN NULL ELSE 77 END AS bits FROM supplier)
SELECT src FROM s WHERE (hi, bits) IS DISTINCT FROM (SELECT (hi, bits) FROM s ORDER BY src LIMIT 1)""")
def contracts_j9(spark, sf_dir):
    """Sources whose contract is not that of the first one; a missing member differs too."""
    k = F.col("s_suppkey")
    s = _table(spark, sf_dir, "supplier").select(k.alias("src"), F.lit(233.0).alias("azimuth_min_deg"), (F.lit(309.0) + F.when(k % 5 == 4, 1).otherwise(0)).alias("azimuth_max_deg"), F.when(k % 7 != 3, 77).alias("bit_count"))
    return lattice.mismatches(s, ["azimuth_min_deg", "azimuth_max_deg", "bit_count"]).select("src")


@query("""WITH b AS (SELECT 30 + n_nationkey * 0.3::DOUBLE AS south, 30.5 + n_nationkey * 0.3::DOUBLE AS north, -120 + n_nationkey % 6 * 0.5::DOUBLE AS west, -119.2 + n_nationkey % 6 * 0.5::DOUBLE AS east FROM nation WHERE n_nationkey < 8),
r AS (SELECT min(west) - 1 AS w, max(east) + 1 AS e, min(south) - 1 AS s, max(north) + 1 AS n FROM b), p AS (SELECT c_custkey AS poly, 20 + c_custkey % 300 * 0.07::DOUBLE AS lat, -130 + c_custkey % 170 * 0.11::DOUBLE AS lon FROM customer)
SELECT poly FROM p, r WHERE lat <= n AND lat + 0.2 >= s AND lon <= e AND lon + 0.3 >= w""")
def ocean_extract_s18_a14_s9(spark, sf_dir):
    k, c = F.col("n_nationkey"), F.col("c_custkey")
    boxes = _table(spark, sf_dir, "nation").filter("n_nationkey < 8").select((30 + k * F.lit(0.3)).alias("south"), (F.lit(30.5) + k * F.lit(0.3)).alias("north"), (-120 + k % 6 * F.lit(0.5)).alias("west"), (F.lit(-119.2) + k % 6 * F.lit(0.5)).alias("east"))
    lat, lon = 20 + c % 300 * F.lit(0.07), -130 + c % 170 * F.lit(0.11)
    shapes = _table(spark, sf_dir, "customer").select(c.alias("poly"), lat.alias("south"), (lat + 0.2).alias("north"), lon.alias("west"), (lon + 0.3).alias("east"))
    return lattice.overlapping(shapes, lattice.rectangle(boxes)).select("poly")


@query("""WITH s AS (SELECT c_custkey, 20037508.342789244 AS h, c_custkey * 37137 % 30000000 - 15000000 + 0.25::DOUBLE AS west, c_custkey * 71993 % 30000000 - 15000000 + 0.25::DOUBLE AS south FROM customer),
t AS (SELECT *, 2 * h / 1024 AS te FROM s), r AS (SELECT c_custkey, greatest(0, floor((west + h) / te))::INT AS tx_min, least(1023, floor((west + 90000 + h - te * 1e-9) / te))::INT AS tx_max, greatest(0, floor((h - south - 50000) / te))::INT AS ty_min, least(1023, floor((h - south - te * 1e-9) / te))::INT AS ty_max FROM t)
SELECT *, (tx_max - tx_min + 1) * 512::BIGINT AS width, (ty_max - ty_min + 1) * 512::BIGINT AS height FROM r""")
def tile_ranges_p29_p30(spark, sf_dir):
    k = F.col("c_custkey")
    west, south = k * 37137 % 30000000 - 15000000 + F.lit(0.25), k * 71993 % 30000000 - 15000000 + F.lit(0.25)
    s = _table(spark, sf_dir, "customer").select("c_custkey", west.alias("west"), south.alias("south"), (west + 90000).alias("east"), (south + 50000).alias("north"))
    return lattice.base_raster(lattice.tile_range(s, 10), 10).select("c_custkey", "tx_min", "tx_max", "ty_min", "ty_max", "width", "height")


_WATER = """WITH w AS (SELECT DISTINCT (36 + p_partkey % 2)::INT AS south, (-122 + p_partkey // 2 % 2)::INT AS west, (p_partkey // 4 % 40)::INT AS r, (p_partkey // 160 % 40)::INT AS c FROM part WHERE p_size % 3 = 0),
i AS (SELECT 36 AS south, -122 AS west, (s_suppkey % 40)::INT AS r, (s_suppkey * 7 % 40)::INT AS c FROM supplier), a AS (SELECT * FROM w UNION SELECT * FROM i) """


def water_cells(spark, sf_dir) -> DataFrame:
    """Cells of 40 by 40 to a degree, of an ocean and of inland water."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    ocean = _table(spark, sf_dir, "part").filter("p_size % 3 = 0").select((36 + k % 2).cast("int").alias("south"), (-122 + F.floor(k / 2) % 2).cast("int").alias("west"), (F.floor(k / 4) % 40).cast("int").alias("r"), (F.floor(k / 160) % 40).cast("int").alias("c"))
    inland = _table(spark, sf_dir, "supplier").select(F.lit(36).alias("south"), F.lit(-122).alias("west"), (s % 40).cast("int").alias("r"), (s * 7 % 40).cast("int").alias("c"))
    return water.all_water(ocean, inland)


@query(_WATER + """, p AS (SELECT c_custkey, 36 + c_custkey % 130 * 0.02::DOUBLE + 0.003 AS lat, -122 + c_custkey * 7 % 110 * 0.02::DOUBLE + 0.004 AS lon FROM customer),
q AS (SELECT *, floor(lat)::INT AS south, floor(lon)::INT AS west FROM p), x AS (SELECT *, least(greatest(floor((south + 1 - lat) * 40), 0), 39)::INT AS r, least(greatest(floor((lon - west) * 40), 0), 39)::INT AS c FROM q)
SELECT c_custkey, CASE WHEN NOT EXISTS (SELECT 1 FROM a WHERE a.south = x.south AND a.west = x.west) THEN true ELSE EXISTS (SELECT 1 FROM a WHERE a.south = x.south AND a.west = x.west AND a.r = x.r AND a.c = x.c) END AS water FROM x""")
def water_lookup_p20_j2(spark, sf_dir):
    """Points off the tiles are sea."""
    cells, k = water_cells(spark, sf_dir), F.col("c_custkey")
    points = _table(spark, sf_dir, "customer").select("c_custkey", (36 + k % 130 * F.lit(0.02) + 0.003).alias("lat"), (-122 + k * 7 % 110 * F.lit(0.02) + 0.004).alias("lon"))
    return water.water_at(points, water.pack_rows(cells), cells.select("south", "west"), 40).select("c_custkey", "water")


@query(_WATER + """SELECT t.south, t.west, r::INT AS "row", c::INT AS col FROM (SELECT 36 AS south, -122 AS west UNION ALL SELECT 40, -120) t, range(0, 40) x(r), range(0, 40) y(c) WHERE (t.south, t.west, r, c) NOT IN (SELECT (south, west, r, c) FROM a)""")
def tile_land_s10_u2_u4(spark, sf_dir):
    """Of a tile with both kinds of water, and of one without any."""
    tiles = spark.createDataFrame([(36, -122), (40, -120)], "south int, west int")
    return water.tile_land(tiles, water_cells(spark, sf_dir).withColumnsRenamed({"r": "row", "c": "col"}), 40)


@query("""WITH o AS (SELECT r, c FROM range(0, 60) x(r), range(0, 60) y(c) WHERE r + c < 90), b AS (SELECT DISTINCT r, c FROM nation, range(0, 60) x(r), range(0, 60) y(c) WHERE r + 0.5 >= n_nationkey * 2 AND r + 0.5 < n_nationkey * 2 + 4 AND c + 0.5 >= n_nationkey % 7 * 8 AND c + 0.5 < n_nationkey % 7 * 8 + 5), w AS (SELECT r, c FROM range(0, 60) x(r), range(0, 60) y(c) WHERE c < 12)
SELECT r::INT AS "row", c::INT AS col FROM (SELECT * FROM o EXCEPT SELECT * FROM b EXCEPT (SELECT * FROM w EXCEPT SELECT * FROM b))""")
def fill_cells_j14_u4(spark, sf_dir):
    """An outline without boxes and ocean."""
    k = F.col("n_nationkey")
    grid = spark.range(3600).select(F.floor(F.col("id") / 60).cast("int").alias("row"), (F.col("id") % 60).cast("int").alias("col"))
    boxes = _table(spark, sf_dir, "nation").select((k * 2.0).alias("south"), (k * 2.0 + 4).alias("north"), (k % 7 * 8.0).alias("west"), (k % 7 * 8.0 + 5).alias("east"))
    held = polygons.rectangles(boxes, 1.0, 0.0, 0.0)
    return polygons.outside(grid.filter("row + col < 90"), held, grid.filter("col < 12"))


_SQUARES = """WITH e AS (SELECT n_nationkey % 2 AS side, n_nationkey % 9 + 0.3::DOUBLE AS a, n_nationkey % 9 + 3.6 + n_nationkey % 4 AS b FROM nation), c AS (SELECT DISTINCT side, r, c FROM e, range(0, 16) x(r), range(0, 16) y(c) WHERE r + 0.5 > a AND r + 0.5 < b AND c + 0.5 > a AND c + 0.5 < b) """


def squares(spark, sf_dir, side: int | None = None) -> DataFrame:
    k = F.col("n_nationkey")
    e = _table(spark, sf_dir, "nation").select(k.alias("poly"), (k % 9 + F.lit(0.3)).alias("a"), (k % 9 + F.lit(3.6) + k % 4).alias("b"))
    e = e.filter(F.col("poly") % 2 == side) if side is not None else e
    a, b = F.col("a"), F.col("b")
    ring = [F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")) for x0, y0, x1, y1 in ((a, a, b, a), (b, a, b, b), (b, b, a, b), (a, b, a, a))]
    return e.select("poly", F.explode(F.array(*ring)).alias("e")).select("poly", "e.*")


@query(_SQUARES + """SELECT DISTINCT r::INT AS "row", c::INT AS col FROM c""")
def dissolved_a10_u1(spark, sf_dir):
    fills = [rasters.fill(squares(spark, sf_dir, side), 16, 16) for side in (0, 1)]
    return polygons.union_cells(*fills)


@query(_SQUARES + """SELECT DISTINCT x.r::INT AS "row", x.c::INT AS col FROM c x JOIN c y ON x.r = y.r AND x.c = y.c WHERE x.side = 0 AND y.side = 1""")
def intersection_u3(spark, sf_dir):
    fills = [rasters.fill(squares(spark, sf_dir, side), 16, 16) for side in (0, 1)]
    return polygons.common_cells(polygons.union_cells(fills[0]), fills[1])


@query("""WITH e AS (SELECT n_nationkey % 9 + 0.3::DOUBLE AS a, n_nationkey % 9 + 3.6 + n_nationkey % 4 AS b FROM nation WHERE n_nationkey < 6), t AS (SELECT DISTINCT r, c FROM e, range(0, 16) x(r), range(0, 16) y(c) WHERE r BETWEEN floor(a) AND floor(b) AND c BETWEEN floor(a) AND floor(b)),
p AS (SELECT p_partkey % 16 AS r, p_partkey // 16 % 16 AS c, bit_or(1::BIGINT << (p_size % 30)) AS w FROM part GROUP BY ALL) SELECT r::INT AS "row", c::INT AS col, CASE WHEN (r, c) IN (SELECT (r, c) FROM t) THEN w ELSE 0 END::BIGINT AS w0 FROM p""")
def clip_j8(spark, sf_dir):
    """Pixels outside the cells that squares touch at all lose their masks."""
    k = F.col("p_partkey")
    pixels = _table(spark, sf_dir, "part").groupBy((k % 16).cast("int").alias("row"), (F.floor(k / 16) % 16).cast("int").alias("col")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p_size") % 30)).alias("w0"))
    return rasters.clip(pixels, rasters.touched(squares(spark, sf_dir).filter("poly < 6"), 16, 16), ["w0"]).select("row", "col", "w0")


@query("""SELECT 'box_' || CASE WHEN length(k::VARCHAR) < 3 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS name, round(greatest(a, b), 6) AS north, round(least(a, b), 6) AS south, round(least(c, d), 6) AS west, round(greatest(c, d), 6) AS east
FROM (SELECT c_custkey AS k, c_acctbal / 200 AS a, c_custkey % 70 / 2.0::DOUBLE AS b, -100 - c_custkey % 9::DOUBLE AS c, -100 - c_custkey % 7::DOUBLE AS d FROM customer)
WHERE round(greatest(a, b), 6) - round(least(a, b), 6) > 1e-4 AND round(greatest(c, d), 6) - round(least(c, d), 6) > 1e-4""")
def drawn_boxes_p39(spark, sf_dir):
    k = F.col("c_custkey")
    corners = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 200).alias("lat_a"), (k % 70 / F.lit(2.0)).alias("lat_b"), (-100 - k % 9).cast("double").alias("lon_a"), (-100 - k % 7).cast("double").alias("lon_b"))
    return editor.drawn(corners).select(editor.box_name(k).alias("name"), "north", "south", "west", "east")


@query("""WITH b AS (SELECT n_nationkey AS box, 30 + n_nationkey % 8 * 0.7::DOUBLE AS s, 30.4 + n_nationkey % 8 * 0.7 + n_nationkey % 5 * 0.6::DOUBLE AS n, -120 + n_nationkey % 6 * 0.9::DOUBLE AS w, -119.5 + n_nationkey % 6 * 0.9 + n_nationkey % 4 * 0.8::DOUBLE AS e FROM nation),
p AS (SELECT c_custkey AS click, 30 + c_custkey % 97 * 0.083::DOUBLE AS lat, -120 + c_custkey % 89 * 0.077::DOUBLE AS lon FROM customer)
SELECT click, arg_min(box, ((n - s) * (e - w), box))::INT AS box FROM p LEFT JOIN b ON lat BETWEEN s AND n AND lon BETWEEN w AND e GROUP BY click""")
def clicked_box_a13_o5(spark, sf_dir):
    k, c = F.col("n_nationkey"), F.col("c_custkey")
    boxes = _table(spark, sf_dir, "nation").select(k.alias("box_idx"), (30 + k % 8 * F.lit(0.7)).alias("south"), (F.lit(30.4) + k % 8 * F.lit(0.7) + k % 5 * F.lit(0.6)).alias("north"), (-120 + k % 6 * F.lit(0.9)).alias("west"), (F.lit(-119.5) + k % 6 * F.lit(0.9) + k % 4 * F.lit(0.8)).alias("east"))
    clicks = _table(spark, sf_dir, "customer").select(c.alias("click"), (30 + c % 97 * F.lit(0.083)).alias("lat"), (-120 + c % 89 * F.lit(0.077)).alias("lon"))
    return editor.clicked(clicks, boxes).select("click", "box")


_SUN = """WITH d AS (SELECT DISTINCT o_orderdate::DATE AS day, 20 + o_custkey % 3 * 24::DOUBLE AS lat FROM orders),
a AS (SELECT *, pi() / 180 AS r, 122.5 * pi() / 180 AS lw, lat * pi() / 180 AS phi, round(datediff('day', DATE '1970-01-01', day) + 20 / 24.0::DOUBLE + 2440587.5 - 2451545 - 0.0009 - 122.5 / 360) AS n FROM d),
b AS (SELECT *, r * (357.5291 + 0.98560028 * (0.0009 + lw / (2 * pi()) + n)) AS m FROM a), c AS (SELECT *, m + r * (1.9148 * sin(m) + 0.02 * sin(2 * m) + 0.0003 * sin(3 * m)) + 102.9372 * r + pi() AS l FROM b),
e AS (SELECT *, asin(sin(l) * sin(23.4397 * r)) AS de FROM c), f AS (SELECT *, (sin(-0.833 * r) - sin(phi) * sin(de)) / (cos(phi) * cos(de)) AS cw FROM e),
g AS (SELECT *, 0.0009 + (CASE WHEN abs(cw) <= 1 THEN acos(greatest(-1, least(1, cw))) END + lw) / (2 * pi()) + n + 0.0053 * sin(m) - 0.0069 * sin(2 * l) AS js FROM f),
h AS (SELECT *, r * (357.5291 + 0.98560028 * js) AS m2 FROM g), i AS (SELECT *, m2 + r * (1.9148 * sin(m2) + 0.02 * sin(2 * m2) + 0.0003 * sin(3 * m2)) + 102.9372 * r + pi() AS l2 FROM h),
j AS (SELECT *, asin(sin(l2) * sin(23.4397 * r)) AS d2, (js * 360.9856235 + 280.16) * r - lw - atan2(sin(l2) * cos(23.4397 * r), cos(l2)) AS hh FROM i),
z AS (SELECT day, lat, (atan2(sin(hh), cos(hh) * sin(phi) - tan(d2) * cos(phi)) / r + 180 + 360) % 360 AS az FROM j),
s AS (SELECT day, lat, CASE WHEN floor(az - 233 + 0.5) BETWEEN 0 AND 76 THEN floor(az - 233 + 0.5)::INT END AS bit FROM z) """


@query(_SUN + "SELECT day, lat, bit FROM s")
def sunset_p34_p37(spark, sf_dir):
    """Three latitudes; at the northernmost the sun does not set in midsummer."""
    return editor.shown(dates(spark, sf_dir), PRODUCTION).select("day", "lat", "bit")


@query(_SUN + "SELECT day, lat, bit, row_number() OVER w = 1 OR bit IS DISTINCT FROM lag(bit) OVER w AS changes FROM s WINDOW w AS (PARTITION BY lat ORDER BY day)")
def recoloured_days_p37(spark, sf_dir):
    return editor.recoloured(dates(spark, sf_dir), PRODUCTION, ["lat"]).select("day", "lat", "bit", "changes")


def dates(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), (20 + F.col("o_custkey") % 3 * F.lit(24.0)).alias("lat")).distinct()


_BOXES = """WITH b AS (SELECT n_nationkey::INT AS box_idx, 30 + n_nationkey * 0.5::DOUBLE AS south, 30.17 + n_nationkey * 0.5 + n_nationkey % 4 * 0.1::DOUBLE AS north, -123 + n_nationkey * 0.4::DOUBLE AS west, -122.7 + n_nationkey * 0.4::DOUBLE AS east FROM nation),
t AS (SELECT *, round((north - south) * 60)::INT AS rows, round((east - west) * 60)::INT AS width FROM b), u AS (SELECT *, unnest(range(0, greatest(ceil((north - south) / 0.1::DOUBLE - 1e-9)::INT, 1))) AS strip FROM t),
v AS (SELECT *, south + strip * 0.1::DOUBLE AS min_lat, round((least(south + strip * 0.1::DOUBLE + 0.1, north) - (south + strip * 0.1::DOUBLE)) * 60)::INT AS height FROM u) """


def boxes(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    return _table(spark, sf_dir, "nation").select(k.cast("int").alias("box_idx"), (30 + k * F.lit(0.5)).alias("south"), (F.lit(30.17) + k * F.lit(0.5) + k % 4 * F.lit(0.1)).alias("north"), (-123 + k * F.lit(0.4)).alias("west"), (F.lit(-122.7) + k * F.lit(0.4)).alias("east"))


@query(_BOXES + "SELECT box_idx, strip::INT AS strip, height, width, (rows - round((min_lat - south) * 60)::INT - height)::INT AS row_off FROM v WHERE height > 0")
def strips_p1_p25(spark, sf_dir):
    return sweep.strips(boxes(spark, sf_dir), COARSE).select("box_idx", "strip", "height", "width", "row_off")


@query(_BOXES + """SELECT DISTINCT box_idx, strip::INT AS strip, la::INT AS lat, lo::INT AS lon FROM v, LATERAL (SELECT unnest(range(floor(min_lat - 0.65)::INT, floor(min_lat + height / 60.0::DOUBLE + 0.65 - 1e-9)::INT + 1)) AS la), LATERAL (SELECT unnest(range(floor(west)::INT, floor(west + width / 60.0::DOUBLE - 1e-9)::INT + 1)) AS lo) WHERE height > 0""")
def working_set_p24_j12_u5(spark, sf_dir):
    return sweep.working_set(sweep.strips(boxes(spark, sf_dir), COARSE), COARSE)


@query("""WITH b AS (SELECT n_nationkey::INT AS box, 37 + n_nationkey * 0.3::DOUBLE AS south, cos(radians(37 + n_nationkey * 0.3::DOUBLE)) AS cp, 40 / 3600.0::DOUBLE * 111320 AS s, sin(radians(90.0::DOUBLE)) AS sb, cos(radians(90.0::DOUBLE)) AS cb, 111320 / 60.0::DOUBLE AS st, sqrt((1 - 2 * 0.13::DOUBLE) / (2 * 6371000.0::DOUBLE)) AS root FROM nation),
p AS (SELECT *, r, c, c * st * cp AS e, r * st AS n FROM b, range(0, 5) x(r), range(0, 18) y(c)), q AS (SELECT *, round((e * cb - n * sb) / s) AS j, e * sb + n * cb AS along FROM p),
y AS (SELECT DISTINCT box, south, cp, s, sb, cb, root, j, -j * s / sb AS n0, greatest(18 * st * cp * sb, 18 * st * cp * sb + 5 * st * cb) AS am FROM q),
k AS (SELECT *, unnest(range(0, floor((am + s - n0 * cb) / s)::INT + 1)) AS k FROM y), l AS (SELECT *, -123 + k * s * sb / (111320 * cp) AS lon FROM k),
m AS (SELECT *, min(CASE WHEN lon >= -122.95 THEN k END) OVER (PARTITION BY box, j) AS k0, CASE WHEN lon >= -122.9 AND lon < -122.85 THEN 40.0 WHEN lon >= -122.78 THEN 4.0 ELSE 0.0 END::DOUBLE AS h FROM l),
o AS (SELECT *, (k - k0) * s AS x FROM m WHERE k >= k0), g AS (SELECT *, sqrt(h + 2) - x * root >= greatest(0, max(sqrt(h) - x * root) OVER (PARTITION BY box, j ORDER BY k ROWS UNBOUNDED PRECEDING)) AS vis, n0 * cb + k0 * s AS ac, max(k) OVER (PARTITION BY box, j) - k0 AS last FROM o)
SELECT q.box AS box_idx, q.r::INT AS "row", q.c::INT AS col, CASE WHEN -123 + q.c / 60.0::DOUBLE < -122.95 THEN 0 ELSE 2 + CASE WHEN coalesce(g.vis, false) THEN 1 ELSE 0 END END::BIGINT AS w0
FROM q LEFT JOIN g ON g.box = q.box AND g.j = q.j AND q.along - g.ac >= -g.s AND g.k - g.k0 = least(greatest(round((q.along - g.ac) / g.s), 0), g.last)""")
def sweep_p2_p10_p15_j4_j15_a1_s22(spark, sf_dir):
    """Boxes to masks through rays and samples, over a coast along a meridian with a ridge and a plateau behind it."""
    k, lon = F.col("n_nationkey"), F.col("lon")
    south = 37 + k * F.lit(0.3)
    of = _table(spark, sf_dir, "nation").select(k.cast("int").alias("box_idx"), south.alias("south"), (south + F.lit(5 / 60)).alias("north"), F.lit(-123.0).alias("west"), F.lit(-123 + 18 / 60).alias("east"))
    height = F.when((lon >= -122.9) & (lon < -122.85), 40.0).when(lon >= -122.78, 4.0).otherwise(0.0)
    masks = sweep.sweep(of, COARSE, lambda df: df.withColumns({"water": lon < -122.95, "h": height}))
    return masks.select("box_idx", "row", "col", "w0")


@query("""SELECT 'box_' || lpad(c_custkey::VARCHAR, 4, '0') || CASE c_custkey % 3 WHEN 0 THEN '.tif' WHEN 1 THEN '.tif.json' ELSE '.txt' END AS name FROM customer WHERE c_custkey >= 40 AND c_custkey % 3 <> 2""")
def left_over_files_j11(spark, sf_dir):
    k = F.col("c_custkey")
    ending = F.when(k % 3 == 0, ".tif").when(k % 3 == 1, ".tif.json").otherwise(".txt")
    return runs.left_over(_table(spark, sf_dir, "customer").select(F.concat(F.lit("box_"), F.lpad(k.cast("string"), 4, "0"), ending).alias("name")), 40)


@query("""WITH p AS (SELECT n_nationkey AS poly, -122.83 + n_nationkey % 5 * 0.37::DOUBLE AS w, 36.11 + n_nationkey % 7 * 0.29::DOUBLE AS s, 0.31 + n_nationkey % 4 * 0.22::DOUBLE AS size FROM nation), c AS (SELECT la, lo, r, c, la + 1 - (r + 0.5) / 40.0::DOUBLE AS y, lo + (c + 0.5) / 40.0::DOUBLE AS x FROM range(35, 40) a(la), range(-124, -119) b(lo), range(0, 40) d(r), range(0, 40) e(c))
SELECT la::INT AS south, lo::INT AS west, count(DISTINCT (r, c))::BIGINT AS n_water FROM c JOIN p ON x > w AND x < w + size AND y > s AND y < s + size GROUP BY la, lo""")
def ocean_tiles_s6_j5_j6_a10(spark, sf_dir):
    """Water cells of the tiles that squares overlap."""
    k = F.col("n_nationkey")
    p = _table(spark, sf_dir, "nation").select(k.alias("poly"), (F.lit(-122.83) + k % 5 * F.lit(0.37)).alias("west"), (F.lit(36.11) + k % 7 * F.lit(0.29)).alias("south"), (F.lit(0.31) + k % 4 * F.lit(0.22)).alias("size"))
    p = p.withColumns({"east": F.col("west") + F.col("size"), "north": F.col("south") + F.col("size")})
    ring = [F.struct(F.col(a).alias("x0"), F.col(b).alias("y0"), F.col(c).alias("x1"), F.col(d).alias("y1")) for a, b, c, d in (("west", "south", "east", "south"), ("east", "south", "east", "north"), ("east", "north", "west", "north"), ("west", "north", "west", "south"))]
    rows = water.rasterised(p.select("poly", F.explode(F.array(*ring)).alias("e")).select("poly", "e.*"), water.tile_index(p), 40)
    wet = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))
    return rows.groupBy("south", "west").agg(F.sum(wet).alias("n_water"))
