"""Queries of polygons as vectors, with SQL over the cells and points of rectangles on whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vespera.operators import overlay
from vespera.plans.queries import _table, query

_RECTANGLES = """a AS (SELECT n_nationkey AS k, n_nationkey * 7 % 30 AS x, n_nationkey * 11 % 30 AS y, 3 + n_nationkey % 5 AS w, 2 + n_nationkey % 7 AS h FROM nation), b AS (SELECT s_suppkey AS k, s_suppkey * 5 % 33 AS x, s_suppkey * 17 % 31 AS y, 2 + s_suppkey % 4 AS w, 3 + s_suppkey % 3 AS h FROM supplier WHERE s_suppkey % 4 = 1),
cell AS (SELECT x, y FROM range(0, 45) x(x), range(0, 45) y(y)), inside AS (SELECT c.x, c.y, EXISTS (SELECT 1 FROM a WHERE c.x >= a.x AND c.x < a.x + w AND c.y >= a.y AND c.y < a.y + h AND NOT (k % 3 = 0 AND c.x > a.x AND c.x < a.x + w - 1 AND c.y > a.y AND c.y < a.y + h - 1)) AS ia,
  EXISTS (SELECT 1 FROM b WHERE c.x >= b.x AND c.x < b.x + w AND c.y >= b.y AND c.y < b.y + h) AS ib FROM cell c), r AS (SELECT 'union' AS how, x, y FROM inside WHERE ia OR ib UNION ALL SELECT 'intersection', x, y FROM inside WHERE ia AND ib UNION ALL SELECT 'difference', x, y FROM inside WHERE ia AND NOT ib)"""


def _rings(table: DataFrame, key: Column, hole: Column | None) -> DataFrame:
    """poly and edges of rectangles (x, y, w, h); with a hole, one cell from each side, where hole says so."""
    ring = lambda x, y, w, h: [F.struct(p[0].alias("x0"), p[1].alias("y0"), q[0].alias("x1"), q[1].alias("y1")) for c in [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]] for p, q in zip(c, c[1:] + c[:1])]
    x, y, w, h = (F.col(c).cast("double") for c in ("x", "y", "w", "h"))
    outer = F.array(*ring(x, y, w, h))
    edges = outer if hole is None else F.when(hole, F.concat(outer, F.array(*ring(x + 1, y + 1, w - 2, h - 2)))).otherwise(outer)
    return table.select(key.cast("long").alias("poly"), F.explode(edges).alias("e")).select("poly", "e.*")


def rectangles(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Edges of two tables of polygons, one for each key; a key that comes twice is one polygon, which the even-odd rule would empty."""
    k, s = F.col("n_nationkey"), F.col("s_suppkey")
    a = _table(spark, sf_dir, "nation").select("n_nationkey").distinct().select("n_nationkey", (k * 7 % 30).alias("x"), (k * 11 % 30).alias("y"), (k % 5 + 3).alias("w"), (k % 7 + 2).alias("h"))
    b = _table(spark, sf_dir, "supplier").filter(s % 4 == 1).select("s_suppkey").distinct().select("s_suppkey", (s * 5 % 33).alias("x"), (s * 17 % 31).alias("y"), (s % 4 + 2).alias("w"), (s % 3 + 3).alias("h"))
    return _rings(a, k, (k % 3 == 0) & (F.col("w") > 2) & (F.col("h") > 2)), _rings(b, s, None)


@query(f"WITH {_RECTANGLES} SELECT how, count(*)::DOUBLE AS area FROM r GROUP BY how")
def overlay_areas_s10_u3_u4_a10(spark, sf_dir):
    """Areas of set operations on rectangles, some with holes, that overlap, share edges and touch at corners."""
    pieces, edges = overlay.compared(*rectangles(spark, sf_dir)), None
    for how in overlay.HOW:
        one = overlay.picked(pieces, how).withColumn("how", F.lit(how))
        edges = one if edges is None else edges.unionByName(one)
    return edges.groupBy("how").agg(overlay.area(edges).alias("area"))  # what holds nothing has no row


@query(f"WITH {_RECTANGLES}, p AS (SELECT c_custkey, c_custkey * 37 % 401 * 0.1::DOUBLE + 0.03 AS px, c_custkey * 53 % 397 * 0.1::DOUBLE + 0.07 AS py FROM customer) SELECT c_custkey FROM p JOIN r ON how = 'difference' AND x = floor(px) AND y = floor(py)")
def overlay_points_s10_u4(spark, sf_dir):
    """The points that lie in one set of polygons and not in another, by the edges of the difference."""
    a, b = rectangles(spark, sf_dir)
    k = F.col("c_custkey")
    points = _table(spark, sf_dir, "customer").select("c_custkey", (k * 37 % 401 * F.lit(0.1) + 0.03).alias("x"), (k * 53 % 397 * F.lit(0.1) + 0.07).alias("y"))
    return overlay.holding(points, overlay.overlay(a, b, "difference")).select("c_custkey")


@query("""WITH c AS (SELECT n_nationkey AS poly, 2.0::DOUBLE + n_nationkey % 5 AS s FROM nation) SELECT poly, s * s / 2 AS area, 2::BIGINT AS rings, 6::BIGINT AS corners FROM c WHERE poly % 2 = 0 UNION ALL SELECT poly, s * s, 1, 4 + 0 FROM c WHERE poly % 2 = 1""")
def repaired_p43(spark, sf_dir):
    """Bow ties and squares with a spike and repeated points: their areas, rings and corners after repair."""
    k, s = F.col("n_nationkey"), F.lit(2.0) + F.col("n_nationkey") % 5
    tie = [(0, 0), (1, 1), (1, 0), (0, 1)]
    spike = [(0, 0), (1, 0), (1, 0), (1, 1), (1, 3), (1, 1), (0, 1)]
    edge = lambda p, q: F.struct(*[(s * v + F.col("at")).alias(n) for n, v in (("x0", p[0]), ("y0", p[1]), ("x1", q[0]), ("y1", q[1]))])
    ring = lambda c: F.array(*[edge(p, q) for p, q in zip(c, c[1:] + c[:1])])
    e = _table(spark, sf_dir, "nation").withColumn("at", (k * 4).cast("double")).select(k.cast("long").alias("poly"), F.explode(F.when(k % 2 == 0, ring(tie)).otherwise(ring(spike))).alias("e")).select("poly", "e.*")
    edges = overlay.repaired(e)
    points = overlay.linked(edges, ["poly"]).groupBy("poly").agg(F.countDistinct("ring").alias("rings"), F.count("*").alias("corners"))
    return edges.groupBy("poly").agg(overlay.area(edges).alias("area")).join(points, "poly")
