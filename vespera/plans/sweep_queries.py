"""Queries of sweeps over several azimuths, by segments of rays and from stored blocks, with SQL that judges whole rays sample by sample."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, Window as W, functions as F

from vespera.operators import segments, sweep, water
from vespera.operators.rasters import accumulate, flag_land
from vespera.plans.grid_queries import COARSE
from vespera.plans.queries import CURVATURE, EYE, SPACING, _table, query, samples

#: Four azimuths, two strips a box, a foreshore that is skipped, and a march that ends before some coasts.
WINDOW = dataclasses.replace(COARSE, azimuth_min_deg=240.0, azimuth_max_deg=300.0, azimuth_step_deg=20.0, coast_obstruction_skip_m=2500.0, coast_march_max_km=14.0)
CELLS, BLOCK = 40, 16

_SEGMENTS = """WITH s AS (
  SELECT l_suppkey AS j, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) - 1 AS k,
    CASE WHEN l_linenumber = 3 THEN NULL ELSE (l_quantity - 25) / 8 END AS h FROM lineitem
), c AS (
  SELECT *, min(CASE WHEN k >= j % 40 THEN k END) OVER (PARTITION BY j) AS k0 FROM s
), x AS (
  SELECT *, (k - k0) * 10.0::DOUBLE AS x, sqrt(greatest(coalesce(h, 0), 0)) AS up FROM c WHERE k >= k0
), v AS (
  SELECT *, greatest(0, coalesce(max(CASE WHEN x >= 35 THEN up - x * 0.001::DOUBLE END) OVER (PARTITION BY j ORDER BY k ROWS UNBOUNDED PRECEDING), 0)) AS highest FROM x
)
SELECT j, min(k0)::BIGINT AS k0, count(*)::BIGINT AS n, coalesce(sum(k) FILTER (sqrt(greatest(coalesce(h, 0) + 0.5, 0)) - x * 0.001::DOUBLE >= highest), 0)::BIGINT AS seen, max(highest) AS highest FROM v GROUP BY j"""


@query(_SEGMENTS)
def segments_w1_w2_a6_p13(spark, sf_dir):
    """Rays of lineitem in segments of seven to thirteen samples, some heights missing, the first 35 m skipped."""
    s = samples(spark, sf_dir).withColumns({"water": F.col("k") < F.col("j") % 40, "cut": F.floor(F.col("k") / (F.col("j") % 7 + 7))})
    holes = _table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    holes = holes.select(F.col("l_suppkey").alias("j"), (F.row_number().over(order) - 1).alias("k"), F.col("l_linenumber").alias("line"))
    s = s.join(holes, ["j", "k"]).withColumn("h", F.when(F.col("line") != 3, F.col("h"))).drop("line")
    out = segments.verdicts(s, SPACING, CURVATURE, EYE, 35.0, ("j",), ("cut",))
    return out.groupBy("j").agg(F.min("k0").cast("long").alias("k0"), F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("visible"), F.col("k"))), F.lit(0)).cast("long").alias("seen"), F.max("highest").alias("highest"))


def _sweep_sql(boxes: str, terrain: str, pixel_water: str) -> str:
    """Masks of boxes (box, south, north, west, east), written from the rules: terrain gives table m its h and water from l (lat, lon), pixel_water gives table pw (box, strip, r, c, wet) from px (lat, lon)."""
    return f"""WITH b AS ({boxes}), g AS (SELECT *, round((north - south) * 60)::INT AS rows, round((east - west) * 60)::INT AS width FROM b),
u AS (SELECT *, unnest(range(0, greatest(ceil((north - south) / 0.1::DOUBLE - 1e-9)::INT, 1))) AS strip FROM g), v AS (SELECT *, south + strip * 0.1::DOUBLE AS min_lat FROM u),
t AS (SELECT *, round((least(min_lat + 0.1::DOUBLE, north) - min_lat) * 60)::INT AS height, cos(radians(min_lat)) AS cp, 40 / 3600.0::DOUBLE * 111320 AS s, 111320 / 60.0::DOUBLE AS st, sqrt((1 - 2 * 0.13::DOUBLE) / (2 * 6371000.0::DOUBLE)) AS root FROM v),
a AS (SELECT i AS az, ((240.0::DOUBLE + i * 20.0 + 180) % 360) * (pi() / 180) AS th FROM range(0, 4) x(i)), sl AS (SELECT *, sin(th) AS sb, cos(th) AS cb FROM t, a WHERE height > 0),
p AS (SELECT *, c * (st * cp) AS e, r * st AS n FROM sl, LATERAL (SELECT unnest(range(0, height)) AS r), LATERAL (SELECT unnest(range(0, width)) AS c)),
q AS (SELECT *, round((e * cb - n * sb) / s)::BIGINT AS j, e * sb + n * cb AS along FROM p),
y AS (SELECT DISTINCT box, strip, az, j, min_lat, west, cp, s, sb, cb, root, -j * s / sb AS n0, greatest(0, height * st * cb, width * (st * cp) * sb, width * (st * cp) * sb + height * st * cb) AS am FROM q),
k AS (SELECT *, unnest(range(0, floor((am + s - n0 * cb) / s)::INT + 1)) AS k FROM y), l AS (SELECT *, min_lat + (n0 + k * s * cb) / 111320.0::DOUBLE AS lat, west + k * s * sb / (111320.0::DOUBLE * cp) AS lon FROM k),
{terrain}, f AS (SELECT *, min(CASE WHEN NOT water AND k * s <= 14000 THEN k END) OVER (PARTITION BY box, strip, az, j) AS k0 FROM m),
o AS (SELECT *, (k - k0) * s AS x FROM f WHERE k >= k0),
w AS (SELECT *, sqrt(greatest(h + 2, 0)) - x * root >= greatest(0, coalesce(max(CASE WHEN x >= 2500 THEN sqrt(greatest(h, 0)) - x * root END) OVER (PARTITION BY box, strip, az, j ORDER BY k ROWS UNBOUNDED PRECEDING), 0)) AS vis,
  n0 * cb + k0 * s AS ac, max(k) OVER (PARTITION BY box, strip, az, j) - k0 AS last FROM o),
px AS (SELECT DISTINCT box, strip, r, c, min_lat + r / 60.0::DOUBLE AS lat, west + c / 60.0::DOUBLE AS lon FROM q), {pixel_water},
z AS (SELECT q.box, q.strip, q.r, q.c, bit_or(CASE WHEN coalesce(w.vis, false) THEN 1::BIGINT << q.az ELSE 0 END) AS bits FROM q LEFT JOIN w ON w.box = q.box AND w.strip = q.strip AND w.az = q.az AND w.j = q.j
  AND q.along - w.ac >= -w.s AND w.k - w.k0 = least(greatest(round((q.along - w.ac) / w.s), 0), w.last) GROUP BY ALL)
SELECT z.box::INT AS box_idx, z.strip::INT AS strip, z.r::INT AS "row", z.c::INT AS col, CASE WHEN wet THEN 0 ELSE bits + 16 END::BIGINT AS w0 FROM z JOIN pw USING (box, strip, r, c)"""


_COAST = "lon < -122.93 + (lat - 37) * 0.02 OR (lat > 40 AND lon < -122.75)"


@query(_sweep_sql(
    "SELECT n_nationkey AS box, 37 + n_nationkey * 0.3::DOUBLE AS south, 37 + n_nationkey * 0.3::DOUBLE + 0.15 AS north, -123.0::DOUBLE AS west, -122.7::DOUBLE AS east FROM nation",
    f"m AS (SELECT *, {_COAST} AS water, CASE WHEN lon >= -122.9 AND lon < -122.86 THEN 25.0 WHEN lon >= -122.8 AND lon < -122.78 THEN 0 WHEN lon >= -122.78 THEN 6.0 ELSE 0.0 END::DOUBLE AS h FROM l)",
    f"pw AS (SELECT *, {_COAST} AS wet FROM px)",
))
def sweep_azimuths_p3_p6_p8_p9_p10_p13_j3_j15(spark, sf_dir):
    """Four azimuths over a slanting coast with a ridge, missing heights behind it and a plateau; rays are judged by the one-degree tiles they cross."""
    k, lon, lat = F.col("n_nationkey"), F.col("lon"), F.col("lat")
    south = 37 + k * F.lit(0.3)
    of = _table(spark, sf_dir, "nation").select(k.cast("int").alias("box_idx"), south.alias("south"), (south + 0.15).alias("north"), F.lit(-123.0).alias("west"), F.lit(-122.7).alias("east"))
    sea = (lon < F.lit(-122.93) + (lat - 37) * F.lit(0.02)) | ((lat > 40) & (lon < -122.75))
    height = F.when((lon >= -122.9) & (lon < -122.86), 25.0).when((lon >= -122.8) & (lon < -122.79), F.lit(None)).when((lon >= -122.79) & (lon < -122.78), F.lit(float("nan"))).when(lon >= -122.78, 6.0).otherwise(0.0)
    strips = sweep.strips(of, WINDOW)
    by_azimuth = sweep.slices(strips, WINDOW)
    walked = sweep.samples(sweep.rays(by_azimuth, WINDOW), WINDOW).withColumns({"water": sea, "h": height})
    return _masks(strips, by_azimuth, walked.withColumns({"south": F.floor("lat").cast("int"), "tile": F.floor("lon").cast("int"), "third": F.floor((F.col("lon") + 123) * 9).cast("int")}), ("south", "tile", "third"), sea)


def _masks(strips: DataFrame, by_azimuth: DataFrame, walked: DataFrame, segment: tuple[str, ...], sea) -> DataFrame:
    limit = F.col("k") * F.lit(WINDOW.spacing_m) <= F.lit(WINDOW.coast_march_max_km * 1000.0)
    judged = segments.verdicts(walked.withColumn("water", F.col("water") | ~limit), WINDOW.spacing_m, WINDOW.curvature, WINDOW.observer_eye_height_m, WINDOW.coast_obstruction_skip_m, sweep.RAY, segment)
    masks = accumulate(sweep.gather(by_azimuth, judged, WINDOW), sweep.layout_of(WINDOW), sweep.PIXEL)
    points = sweep.pixel_points(strips, WINDOW).withColumn("water", sea).select(*sweep.PIXEL, "water")
    return flag_land(masks.join(points, list(sweep.PIXEL)), sweep.layout_of(WINDOW), F.col("water")).select(*sweep.PIXEL, "w0")


_CELLS = """cells AS (SELECT south, west, r, c, coalesce(h, 0)::FLOAT AS h FROM (SELECT 37 AS south, -123 AS west UNION ALL SELECT 38, -123), range(0, 40) x(r), range(0, 40) y(c) LEFT JOIN
  (SELECT 37 + p_partkey % 2 AS ps, p_partkey // 2 % 40 AS pr, p_partkey // 80 % 40 AS pc, max(p_size) AS h FROM part GROUP BY ALL) ON ps = south AND pr = r AND pc = c),
wet AS (SELECT DISTINCT 37 + p_partkey // 3 % 2 AS south, -123 + (p_partkey % 5) // 4 AS west, p_partkey // 6 % 40 AS r, p_partkey // 240 % 40 AS c FROM part WHERE p_partkey % 3 < 2), """
_HEIGHTS = """i AS (SELECT *, floor(lat)::INT AS south, floor(lon)::INT AS tw FROM l), fx AS (SELECT *, least(greatest((south + 1 - lat) * 40 - 0.5, 0), 39.0)::DOUBLE AS fy, least(greatest((lon - tw) * 40 - 0.5, 0), 39.0)::DOUBLE AS fx,
  least(greatest(floor((south + 1.0 - lat) * 40), 0), 39)::INT AS wr, least(greatest(floor((lon - tw) * 40), 0), 39)::INT AS wc FROM i),
h1 AS (SELECT *, floor(fy)::INT AS r0, floor(fx)::INT AS c0, fy - floor(fy) AS ty, fx - floor(fx) AS tx FROM fx),
m AS (SELECT h1.*, coalesce(((((h00.h * (1 - tx) + h01.h * tx) * (1 - ty)) + (h10.h * (1 - tx) + h11.h * tx) * ty))::FLOAT, 0)::DOUBLE AS h, (h1.south, h1.tw) NOT IN ((37, -123), (38, -123), (37, -122)) OR wet.r IS NOT NULL AS water FROM h1
  LEFT JOIN cells h00 ON h00.south = h1.south AND h00.west = tw AND h00.r = r0 AND h00.c = c0 LEFT JOIN cells h01 ON h01.south = h1.south AND h01.west = tw AND h01.r = r0 AND h01.c = least(c0 + 1, 39)
  LEFT JOIN cells h10 ON h10.south = h1.south AND h10.west = tw AND h10.r = least(r0 + 1, 39) AND h10.c = c0 LEFT JOIN cells h11 ON h11.south = h1.south AND h11.west = tw AND h11.r = least(r0 + 1, 39) AND h11.c = least(c0 + 1, 39)
  LEFT JOIN wet ON wet.south = h1.south AND wet.west = tw AND wet.r = wr AND wet.c = wc)"""
_PIXELS = """pi1 AS (SELECT *, floor(lat)::INT AS south, floor(lon)::INT AS tw, least(greatest(floor((floor(lat) + 1.0 - lat) * 40), 0), 39)::INT AS wr, least(greatest(floor((lon - floor(lon)) * 40), 0), 39)::INT AS wc FROM px),
pw AS (SELECT box, strip, pi1.r, pi1.c, (pi1.south, tw) NOT IN ((37, -123), (38, -123), (37, -122)) OR wet.r IS NOT NULL AS wet FROM pi1 LEFT JOIN wet ON wet.south = pi1.south AND wet.west = tw AND wet.r = wr AND wet.c = wc)"""


def part_blocks(spark, sf_dir) -> DataFrame:
    """Terrain blocks: elevations of two tiles and water of three, from part."""
    p, k = _table(spark, sf_dir, "part"), F.col("p_partkey")
    high = p.groupBy((37 + k % 2).cast("int").alias("south"), (F.floor(k / 2) % 40).cast("int").alias("r"), (F.floor(k / 80) % 40).cast("int").alias("c")).agg(F.max("p_size").cast("float").alias("h"))
    grid = spark.range(3200).select((37 + F.floor(F.col("id") / 1600)).cast("int").alias("south"), F.lit(-123).alias("west"), (F.floor(F.col("id") / 40) % 40).cast("int").alias("r"), (F.col("id") % 40).cast("int").alias("c"))
    cells = grid.join(high, ["south", "r", "c"], "left").withColumn("h", F.coalesce("h", F.lit(0.0)))
    wet = p.filter(k % 3 < 2).select((37 + F.floor(k / 3) % 2).cast("int").alias("south"), (F.floor(k % 5 / 4) - 123).cast("int").alias("west"), (F.floor(k / 6) % 40).cast("int").alias("r"), (F.floor(k / 240) % 40).cast("int").alias("c")).distinct()
    tiles = spark.createDataFrame([(37, -123), (38, -123), (37, -122)], "south int, west int")
    return segments.terrain_blocks(segments.haloed(segments.pack_blocks(cells, BLOCK), BLOCK), segments.wet_blocks(water.pack_rows(wet.join(F.broadcast(tiles), ["south", "west"])), tiles, CELLS, BLOCK))


@query(_sweep_sql(
    "SELECT r_regionkey AS box, 37.4 + r_regionkey * 0.3::DOUBLE AS south, 37.4 + r_regionkey * 0.3::DOUBLE + 0.15 AS north, -123.1 + r_regionkey * 0.2::DOUBLE AS west, -122.7 + r_regionkey * 0.2::DOUBLE AS east FROM region",
    _HEIGHTS, _PIXELS,
).replace("WITH b AS", "WITH " + _CELLS + "b AS", 1))
def sweep_blocks_s5_s10_j1_j2_j12_p19_p20_w1(spark, sf_dir):
    """Boxes to masks from blocks of elevation and water; rays leave blocks and tiles, and reach tiles without either."""
    k = F.col("r_regionkey")
    south, west = F.lit(37.4) + k * F.lit(0.3), F.lit(-123.1) + k * F.lit(0.2)
    of = _table(spark, sf_dir, "region").select(k.cast("int").alias("box_idx"), south.alias("south"), (south + 0.15).alias("north"), west.alias("west"), (F.lit(-122.7) + k * F.lit(0.2)).alias("east"))
    masks = segments.sweep_blocks(of, WINDOW, part_blocks(spark, sf_dir), CELLS, BLOCK)
    pixel = F.posexplode(F.split(F.hex("mask"), "(?<=\\G..)")).alias("col", "byte")
    return masks.select("box_idx", "strip", "row", pixel).filter("byte <> ''").select("box_idx", "strip", "row", "col", F.conv("byte", 16, 10).cast("long").alias("w0"))
