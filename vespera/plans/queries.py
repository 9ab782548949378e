"""Queries over the driver's tables, each an instance of engine operators, with their SQL. Names end in the inventory ids they serve."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from vespera.config import PRODUCTION
from vespera.functions import bits, geo
from vespera.operators import rasters, runs, terrain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPACING, CURVATURE, EYE = 10.0, 1e-6, 0.5
SAMPLES_SQL = """
WITH s AS (
  SELECT l_suppkey AS j, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate) - 1 AS k,
    (l_quantity - 25) / 8 AS h FROM lineitem
), c AS (
  SELECT *, k < j % 7 AS water, min(CASE WHEN k >= j % 7 THEN k END) OVER (PARTITION BY j) AS k0 FROM s
), x AS (
  SELECT *, (k - k0) * 10.0::DOUBLE AS x FROM c WHERE k >= k0
), r AS (
  SELECT *, greatest(0, max(sqrt(greatest(h, 0)) - x * 0.001::DOUBLE) OVER (PARTITION BY j ORDER BY k ROWS UNBOUNDED PRECEDING)) AS highest FROM x
), v AS (
  SELECT *, sqrt(greatest(h + 0.5, 0)) - x * 0.001::DOUBLE >= highest AS visible FROM r
)
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain rays from lineitem: a ray for each supplier, its rows in order as samples."""
    order = W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    out = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("j"), (F.row_number().over(order) - 1).alias("k"), ((F.col("l_quantity") - 25) / 8).alias("h"))
    return out.withColumn("water", F.col("k") < F.col("j") % 7)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.verdicts(samples(spark, sf_dir), SPACING, CURVATURE, EYE, ray=("j",))


@query(SAMPLES_SQL + "SELECT j, min(k0)::BIGINT AS k0, count(*)::BIGINT AS n, count(*) FILTER (visible)::BIGINT AS n_visible FROM v GROUP BY j")
def verdicts_a6_w1_w2_p11_p14(spark, sf_dir):
    return judged(spark, sf_dir).groupBy("j").agg(F.min("k0").cast("long").alias("k0"), F.count("*").alias("n"), F.count_if("visible").alias("n_visible"))


@query(SAMPLES_SQL + """, f AS (SELECT j, k, visible, lag(visible) OVER (PARTITION BY j ORDER BY k) AS b FROM v)
SELECT j, count(*) FILTER (b IS NOT NULL AND b <> visible)::BIGINT AS flips FROM f GROUP BY j""")
def transitions_w6(spark, sf_dir):
    return terrain.flips(judged(spark, sf_dir), ("j",))


@query(SAMPLES_SQL + """SELECT c.j, (c.k - c.k0)::INT AS step, CASE WHEN c.k < c.k0 THEN 'sea' ELSE 'land' END AS side, c.water, ((c.k - c.k0) * 10.0)::DOUBLE AS x, CASE WHEN c.k >= c.k0 THEN 'no' ELSE '-' END AS in_skip,
  round(v.highest * 1000, 3) AS max_reach, round((sqrt(greatest(v.h + 0.5, 0)) - v.x * 0.001::DOUBLE) * 1000, 3) AS obs_reach, coalesce(v.visible, false) AS visible
FROM c LEFT JOIN v ON v.j = c.j AND v.k = c.k WHERE c.j = 5 AND c.k - c.k0 BETWEEN -3 AND 40""")
def trace_o6_k13(spark, sf_dir):
    """A ray whose first samples are water, from three steps before its crossing on."""
    out = terrain.trace(samples(spark, sf_dir), judged(spark, sf_dir), F.col("j") == 5, 3, 40, SPACING, CURVATURE, EYE, ray=("j",))
    skip = F.when(F.col("in_skip").isNull(), "-").when(F.col("in_skip"), "yes").otherwise("no").alias("in_skip")
    return out.select("j", "step", "side", "water", "x", skip, F.round("max_reach", 3).alias("max_reach"), F.round("obs_reach", 3).alias("obs_reach"), "visible")


@query(SAMPLES_SQL + "SELECT j, array_to_string(list(CASE WHEN visible THEN '1' ELSE '0' END ORDER BY k), '') AS verdicts FROM v GROUP BY j")
def ray_lists_a12(spark, sf_dir):
    rows = judged(spark, sf_dir).groupBy("j").agg(F.sort_array(F.collect_list(F.struct("k", F.when(F.col("visible"), "1").otherwise("0").alias("v")))).alias("l"))
    return rows.select("j", F.array_join("l.v", "").alias("verdicts"))


_MASKS = """
WITH m AS (
  SELECT l_partkey % 500 AS p, l_suppkey % 90 AS b, l_quantity >= 25 AS v FROM lineitem
), w AS (
  SELECT p, bit_or(CASE WHEN v AND b < 32 THEN 1::BIGINT << b ELSE 0 END) AS w0, bit_or(CASE WHEN v AND b BETWEEN 32 AND 63 THEN 1::BIGINT << (b - 32) ELSE 0 END) AS w1,
    bit_or(CASE WHEN v AND b BETWEEN 64 AND 76 THEN 1::BIGINT << (b - 64) ELSE 0 END) AS w2 FROM m GROUP BY p
), f AS (
  SELECT p, CASE WHEN p % 5 = 0 THEN 0 ELSE w0 END::BIGINT AS w0, CASE WHEN p % 5 = 0 THEN 0 ELSE w1 END::BIGINT AS w1, CASE WHEN p % 5 = 0 THEN 0 ELSE w2 | (1::BIGINT << 13) END::BIGINT AS w2 FROM w
)
"""


def masks(spark, sf_dir) -> DataFrame:
    slices = _table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 500).alias("p"), (F.col("l_suppkey") % 90).cast("int").alias("bit"), (F.col("l_quantity") >= 25).alias("visible"))
    return rasters.flag_land(rasters.accumulate(slices, PRODUCTION, ("p",)), PRODUCTION, F.col("p") % 5 == 0)


@query(_MASKS + "SELECT * FROM f")
def azimuth_masks_a1_p22_p23(spark, sf_dir):
    return masks(spark, sf_dir)


@query(_MASKS + """SELECT p, CASE WHEN (w2 >> 13) & 1 = 0 THEN 'transparent' WHEN p % 90 < 77 AND ((CASE WHEN p % 90 < 32 THEN w0 WHEN p % 90 < 64 THEN w1 ELSE w2 END) >> (p % 90 % 32)::INT) & 1 = 1 THEN 'white' ELSE 'black' END AS colour,
  ((w1 >> 8) & 255)::BIGINT AS byte5 FROM f""")
def colours_p35(spark, sf_dir):
    words = [F.col(f"w{k}") for k in range(3)]
    index = F.when(F.col("p") % 90 < 77, (F.col("p") % 90).cast("int"))
    return masks(spark, sf_dir).select("p", bits.colour(words, PRODUCTION, index).alias("colour"), bits.byte_of(words, 5).alias("byte5"))


@query("""WITH b AS (SELECT 9 AS z, c_custkey % 64 AS "row", (c_custkey // 64) % 64 AS col, bit_or(1::BIGINT << (c_nationkey % 32)) AS w0 FROM customer GROUP BY ALL),
l AS (SELECT unnest(range(0, 5)) AS d) SELECT (z - d)::INT AS z, ("row" >> d::INT)::BIGINT AS "row", (col >> d::INT)::BIGINT AS col, bit_or(w0)::BIGINT AS w0 FROM b, l GROUP BY ALL""")
def pyramid_a2_a9(spark, sf_dir):
    base = _table(spark, sf_dir, "customer").groupBy(F.lit(9).alias("z"), (F.col("c_custkey") % 64).alias("row"), (F.floor(F.col("c_custkey") / 64) % 64).alias("col"))
    return rasters.pyramid(base.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("c_nationkey") % 32)).alias("w0")), 4, ["w0"])


@query("""WITH b AS (SELECT n_nationkey AS src, n_nationkey * 3 AS ro, n_nationkey % 5 * 4 AS co, 6 + n_nationkey % 4 AS h, 8 + n_nationkey % 3 AS w FROM nation),
p AS (SELECT src, ro, co, h, w, r, c, least(r + 0.5, h - r - 0.5, w - c - 0.5) AS depth FROM b, LATERAL (SELECT unnest(range(0, h)) AS r), LATERAL (SELECT unnest(range(0, w)) AS c))
SELECT (ro + r)::INT AS "row", (co + c)::INT AS col, arg_max(src, depth * 1000 - src)::INT AS src, arg_max(src * 100 + r * 10 + c, depth * 1000 - src)::INT AS v FROM p GROUP BY ALL""")
def merge_a3_p27_j7_u1(spark, sf_dir):
    k = F.col("n_nationkey")
    boxes = _table(spark, sf_dir, "nation").select(k.alias("src"), (k * 3).alias("row_off"), (k % 5 * 4).alias("col_off"), (k % 4 + 6).alias("height"), (k % 3 + 8).alias("width"))
    pixels = boxes.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    pixels = pixels.select("src", "row", "col", (F.col("src") * 100 + F.col("row") * 10 + F.col("col")).alias("v"))
    return rasters.merge_deepest(pixels, boxes, "v")


@query("""SELECT c_custkey, (floor(lat))::INT AS south, (floor(lon))::INT AS west, CASE WHEN floor(az - 233 + 0.5) BETWEEN 0 AND 76 THEN floor(az - 233 + 0.5)::INT END AS bit,
  greatest(0, least(255, floor((az - 200) / 160 * 255 + 0.5)))::INT AS legacy
FROM (SELECT c_custkey, 30 + (c_custkey * 37 % 2000) / 100.0::DOUBLE AS lat, -130 + (c_custkey * 91 % 3000) / 100.0::DOUBLE AS lon, 190 + c_custkey % 181 AS az FROM customer)""")
def keys_p18_p21_p36(spark, sf_dir):
    k = F.col("c_custkey")
    c = _table(spark, sf_dir, "customer").select("c_custkey", (30 + k * 37 % 2000 / F.lit(100.0)).alias("lat"), (-130 + k * 91 % 3000 / F.lit(100.0)).alias("lon"), (190 + k % 181).alias("az"))
    south, west = geo.tile_of(F.col("lat"), F.col("lon"))
    return c.select("c_custkey", south.alias("south"), west.alias("west"), bits.bit_index(F.col("az"), PRODUCTION).alias("bit"), bits.legacy_byte(F.col("az")).alias("legacy"))


@query("""SELECT DISTINCT la::INT AS lat, lo::INT AS lon FROM (SELECT 30 + (s_suppkey % 20) * 0.7 - 0.65 AS s, 30 + (s_suppkey % 20) * 0.7 + 0.75 AS n, -125 + s_suppkey % 13 * 0.9 AS w, -125 + s_suppkey % 13 * 0.9 + 1.3 AS e FROM supplier),
LATERAL (SELECT unnest(range(floor(s)::INT, floor(n - 1e-9)::INT + 1)) AS la), LATERAL (SELECT unnest(range(floor(w)::INT, floor(e - 1e-9)::INT + 1)) AS lo)""")
def covered_tiles_j6_u5(spark, sf_dir):
    k = F.col("s_suppkey")
    south, west = 30 + k % 20 * F.lit(0.7), -125 + k % 13 * F.lit(0.9)
    boxes = _table(spark, sf_dir, "supplier").select((south - 0.65).alias("south"), (south + 0.75).alias("north"), west.alias("west"), (west + 1.3).alias("east"))
    return rasters.cover(boxes).select("lat", "lon").distinct()


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders GROUP BY o_custkey")
def newest_a8_w3(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("newest"), "o_orderdate")
    return runs.newest(o, ["o_custkey"], [F.col("o_orderdate"), F.col("newest")]).select("o_custkey", "newest")


@query("""SELECT l_suppkey AS box, count(*)::BIGINT AS n, count(*) FILTER (l_partkey % 20 = 0)::BIGINT AS land, min(CASE WHEN l_partkey % 20 = 0 THEN l_orderkey END) AS land_min,
max(CASE WHEN l_partkey % 20 = 0 THEN l_orderkey END) AS land_max, count(*) FILTER (l_partkey % 20 = 0) <= count(*) * 0.05::DOUBLE AS passes FROM lineitem GROUP BY l_suppkey""")
def west_edge_a4(spark, sf_dir):
    edge = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("box"), F.col("l_orderkey").alias("lat"), (F.col("l_partkey") % 20 != 0).alias("water"))
    return terrain.west_edge(edge, 0.05)


def _boxes(c: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return c.select(F.col("c_name").alias("name"), (k % 50).alias("north"), (k % 70).alias("west"), (k % 50 - 1).alias("south"), (k % 70 + 2).alias("east"), runs.config_hash(F.col("c_mktsegment")).alias("config_hash"))


@query("SELECT c_name AS name, sha256(c_mktsegment) AS config_hash FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_mktsegment <> 'BUILDING')")
def due_boxes_j10_p40_p41(spark, sf_dir):
    boxes = _boxes(_table(spark, sf_dir, "customer"))
    done = _boxes(_table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").withColumn("c_mktsegment", F.when(F.col("c_mktsegment") == "BUILDING", "old").otherwise(F.col("c_mktsegment"))))
    return runs.due(boxes, done).select("name", "config_hash")


@query("SELECT c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def orphans_j11(spark, sf_dir):
    return runs.orphans(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name")), _table(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("name")))


@query("SELECT s_nationkey AS box, s_suppkey AS strip, coalesce(sum(1 + s_suppkey % 9) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_off FROM supplier")
def strip_offsets_w5(spark, sf_dir):
    strips = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("box"), F.col("s_suppkey").alias("strip"), (F.col("s_suppkey") % 9 + 1).alias("rows"))
    return runs.offsets(strips, "rows", "strip", "box").select("box", "strip", "row_off")


@query("""SELECT l_suppkey AS ray, round(least(greatest(d / 10.0, 0), 40))::BIGINT AS idx, count(*)::BIGINT AS n FROM (SELECT l_suppkey, l_partkey % 500 - 30 + 0.25::DOUBLE AS d FROM lineitem) WHERE d >= -10 GROUP BY ALL""")
def nearest_sample_p16(spark, sf_dir):
    d = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ray"), (F.col("l_partkey") % 500 - 30 + F.lit(0.25)).alias("d"))
    return d.withColumn("idx", geo.sample_of(F.col("d"), F.lit(10.0), F.lit(40).cast("long"))).filter("idx IS NOT NULL").groupBy("ray", "idx").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT n_nationkey AS poly, n_nationkey % 7 AS a, 3 + n_nationkey % 5 AS s FROM nation),
c AS (SELECT poly, a, s, r, col FROM e, LATERAL (SELECT unnest(range(0, 16)) AS r), LATERAL (SELECT unnest(range(0, 16)) AS col))
SELECT poly, r::INT AS "row", col::INT AS col FROM c WHERE r + 0.5 > a AND r + 0.5 < a + s AND col + 0.5 > a AND col + 0.5 < a + s AND NOT (r + 0.5 > a + 1 AND r + 0.5 < a + s - 1 AND col + 0.5 > a + 1 AND col + 0.5 < a + s - 1)""")
def fill_mask_p33_j5_o3(spark, sf_dir):
    """Squares with a square hole."""
    k = F.col("n_nationkey")
    e = _table(spark, sf_dir, "nation").select(k.alias("poly"), (k % 7).cast("double").alias("a"), (k % 7 + 3 + k % 5).cast("double").alias("b"))
    ring = lambda lo, hi: [F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")) for x0, y0, x1, y1 in ((lo, lo, hi, lo), (hi, lo, hi, hi), (hi, hi, lo, hi), (lo, hi, lo, lo))]
    edges = e.select("poly", F.explode(F.array(*ring(F.col("a"), F.col("b")), *ring(F.col("a") + 1, F.col("b") - 1))).alias("e")).select("poly", "e.*")
    return rasters.fill(edges, 16, 16)


@query("""SELECT c_custkey, greatest(0, least(4095, floor((lon + 180) / 360 * 4096)))::INT AS x, greatest(0, least(4095, floor((0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 4096)))::INT AS y
FROM (SELECT c_custkey, -60 + (c_custkey * 37 % 12000) / 100.0::DOUBLE + 0.003 AS lat, -170 + (c_custkey * 91 % 30000) / 100.0::DOUBLE + 0.003 AS lon FROM customer)""")
def map_tiles_p32(spark, sf_dir):
    k = F.col("c_custkey")
    c = _table(spark, sf_dir, "customer").select("c_custkey", (-60 + k * 37 % 12000 / F.lit(100.0) + 0.003).alias("lat"), (-170 + k * 91 % 30000 / F.lit(100.0) + 0.003).alias("lon"))
    return c.select("c_custkey", geo.map_tile(geo.unit_x(F.col("lon")), 12).alias("x"), geo.map_tile(geo.unit_y(F.col("lat")), 12).alias("y"))


@query("""WITH t AS (SELECT (p_partkey // 64) % 4 AS x, p_partkey % 2 AS y, (p_partkey // 8) % 8 AS r, p_partkey % 8 AS c, max(p_size) AS value FROM part GROUP BY ALL),
w AS (SELECT unnest(range(0, 16)) AS x, 5 AS y), o AS (SELECT unnest(range(0, 8)) AS "row"), q AS (SELECT unnest(range(0, 8)) AS col)
SELECT w.x::INT AS x, w.y::INT AS y, "row"::INT AS "row", col::INT AS col, value FROM w, o, q JOIN t ON t.x = w.x >> 2 AND t.y = w.y >> 2 AND t.r = (w.y % 4) * 2 + ("row" >> 2) AND t.c = (w.x % 4) * 2 + (col >> 2)""")
def overzoom_p38_j13(spark, sf_dir):
    k = F.col("p_partkey")
    cell = [(F.floor(k / 64) % 4).cast("int").alias("x"), (k % 2).cast("int").alias("y"), (F.floor(k / 8) % 8).cast("int").alias("row"), (k % 8).cast("int").alias("col")]
    tiles = _table(spark, sf_dir, "part").groupBy(*cell).agg(F.max("p_size").alias("value"))
    wanted = spark.range(16).select(F.col("id").cast("int").alias("x"), F.lit(5).alias("y"))
    return rasters.overzoom(tiles, wanted, 2, 8)


@query("""WITH cells AS (SELECT 36 AS south, -122 AS west, r, c, (r * 10 + c * 3)::DOUBLE AS h FROM (SELECT unnest(range(0, 10)) AS r), LATERAL (SELECT unnest(range(0, 10)) AS c)),
p AS (SELECT c_custkey, 36 + (c_custkey % 100) / 100.0::DOUBLE + 0.003 AS lat, -122 + (c_custkey * 7 % 100) / 100.0::DOUBLE + 0.004 AS lon FROM customer),
f AS (SELECT c_custkey, least(greatest((37 - lat) * 10 - 0.5, 0), 9) AS fy, least(greatest((lon + 122) * 10 - 0.5, 0), 9) AS fx FROM p)
SELECT c_custkey, round(fy * 10 + fx * 3, 2) AS h FROM f""")
def bilinear_p19_j1(spark, sf_dir):
    """A tilted plane, which bilinear sampling must give back."""
    k = F.col("c_custkey")
    cells = spark.range(100).select(F.lit(36).alias("south"), F.lit(-122).alias("west"), F.floor(F.col("id") / 10).cast("int").alias("r"), (F.col("id") % 10).cast("int").alias("c"))
    cells = cells.withColumn("h", (F.col("r") * 10 + F.col("c") * 3).cast("float"))
    points = _table(spark, sf_dir, "customer").select("c_custkey", (36 + k % 100 / F.lit(100.0) + 0.003).alias("lat"), (-122 + k * 7 % 100 / F.lit(100.0) + 0.004).alias("lon"))
    return terrain.bilinear(points, cells, 10).select("c_custkey", F.round(F.col("h").cast("double"), 2).alias("h"))
