"""Set operations on polygons and repair of rings against the even-odd rule at random points, and against known areas."""

import random

import pytest
from pyspark.sql import functions as F

from vespera.operators import overlay

EDGES = "poly long, x0 double, y0 double, x1 double, y1 double"


def edges_of(polygons):
    """polygons: lists of rings, each a list of points that need not be closed."""
    return [(p, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for p, rings in enumerate(polygons) for r in rings for a, b in zip(r, r[1:] + r[:1])]


def inside(rings, x, y):
    odd = False
    for r in rings:
        for (x0, y0), (x1, y1) in zip(r, r[1:] + r[:1]):
            if (y0 > y) != (y1 > y) and x < x0 + (y - y0) / (y1 - y0) * (x1 - x0):
                odd = not odd
    return odd


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def scribble(rng, n, size=20.0, whole=False):
    at = (lambda: rng.randint(0, 20)) if whole else lambda: rng.uniform(0, size)
    return [(at(), at()) for _ in range(n)]


def polygons(rng, kind):
    if kind == "whole":  # corners on whole numbers: shared edges, touching corners, collinear stretches
        return [[square(rng.randint(0, 12), rng.randint(0, 12), rng.randint(1, 8))] for _ in range(5)] + [[square(0, 0, 9), square(2, 2, 5)]]
    return [[scribble(rng, rng.randint(3, 7))] for _ in range(4)] + [[square(1.5, 2.5, 12.0), square(3.0, 4.0, 6.0)]]


def winding_ok(found):
    """Every point has as many edges in as out."""
    ends = {}
    for x0, y0, x1, y1 in found:
        ends[x0, y0] = ends.get((x0, y0), 0) + 1
        ends[x1, y1] = ends.get((x1, y1), 0) - 1
    return not any(ends.values())


@pytest.mark.parametrize("kind", ["whole", "any"])
@pytest.mark.parametrize("how", overlay.HOW)
def test_points_of_set_operations(spark, how, kind):
    rng = random.Random(f"{how}{kind}")
    a, b = polygons(rng, kind), polygons(rng, kind)
    found = overlay.overlay(spark.createDataFrame(edges_of(a), EDGES), spark.createDataFrame(edges_of(b), EDGES), how).cache()
    rows = [tuple(r) for r in found.collect()]
    assert winding_ok(rows) and len(rows) == len(set(rows))
    points = [(rng.uniform(-1, 22), rng.uniform(-1, 22)) for _ in range(3000)]
    got = {tuple(r) for r in overlay.holding(spark.createDataFrame(points, "x double, y double"), found).collect()}
    both = lambda x, y: (any(inside(p, x, y) for p in a), any(inside(p, x, y) for p in b))
    wanted = {"union": lambda i, j: i or j, "intersection": lambda i, j: i and j, "difference": lambda i, j: i and not j}[how]
    assert got == {p for p in points if wanted(*both(*p))}
    if kind == "whole":
        cells = sum(wanted(*both(x + 0.5, y + 0.5)) for x in range(22) for y in range(22))
        assert found.agg(overlay.area(found)).first()[0] == cells


def test_repair_of_bow_ties_spikes_and_repeated_points(spark):
    cases = [
        [[(0, 0), (4, 4), (4, 0), (0, 4)]],  # a bow tie
        [[(0, 0), (4, 0), (4, 4), (2, 4), (2, 9), (2, 4), (0, 4)]],  # a spike
        [[(0, 0), (0, 0), (3, 0), (3, 0), (3, 3), (0, 3), (0, 3)]],
        [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (4, 0), (4, 4), (0, 4)]],  # twice around: nothing is inside
        [[(5, 0), (5, 0)]],
        [[(0, 0), (6, 0), (6, 6), (0, 6)], [(0, 0), (3, 0), (3, 3), (0, 3)]],  # a hole in the corner
        [[(0, 0), (2, 4), (4, 0), (0, 3), (4, 3)]],  # a star
        [scribble(random.Random(3), 40)],
    ]
    found = overlay.repaired(spark.createDataFrame(edges_of(cases), EDGES)).cache()
    area = {r.poly: r.a for r in found.groupBy("poly").agg(overlay.area(found).alias("a")).collect()}
    assert area[0] == 8.0 and area[1] == 16.0 and area[2] == 9.0 and 3 not in area and 4 not in area and area[5] == 27.0
    rng = random.Random(9)
    for p in range(len(cases)):
        points = [(rng.uniform(-1, 21), rng.uniform(-1, 21)) for _ in range(400)] + [(rng.uniform(0, 6), rng.uniform(0, 6)) for _ in range(400)]
        own = found.filter(F.col("poly") == p)
        assert {tuple(r) for r in overlay.holding(spark.createDataFrame(points, "x double, y double"), own).collect()} == {q for q in points if inside(cases[p], *q)}
    points = overlay.linked(found, ["poly"]).collect()
    rings = {}
    for r in sorted(points, key=lambda r: (r.poly, r.ring, r.seq)):
        rings.setdefault((r.poly, r.ring), []).append((r.x, r.y))
    edges = {(p, *a, *b) for (p, _), ring in rings.items() for a, b in zip(ring, ring[1:] + ring[:1])}
    assert edges == {tuple(r) for r in found.collect()}
    assert len([1 for p, _ in rings if p == 0]) == 2 and all(len(set(r)) == len(r) for (p, _), r in rings.items() if p < 6)


def test_crowded_squares_are_divided(spark, monkeypatch):
    rng = random.Random(4)
    a = [[scribble(rng, 3, 1.0)] for _ in range(40)] + [[square(-500, -500, 1000)]]
    table = spark.createDataFrame(edges_of(a), EDGES)
    plain = sorted(tuple(r) for r in overlay.repaired(table.withColumn("poly", F.lit(0)), ["poly"]).collect())
    monkeypatch.setattr(overlay, "CROWD", 4)
    assert sorted(tuple(r) for r in overlay.repaired(table.withColumn("poly", F.lit(0)), ["poly"]).collect()) == plain


def test_union_of_one_table_and_empty_ones(spark):
    a = spark.createDataFrame(edges_of([[square(0, 0, 2)], [square(1, 0, 2)], [square(3, 0, 2)]]), EDGES)
    out = overlay.overlay(a, None, "union")
    assert out.agg(overlay.area(out)).first()[0] == 10.0
    assert overlay.overlay(a, a.limit(0), "intersection").count() == 0 and overlay.overlay(a.limit(0), None, "union").count() == 0
    with pytest.raises(ValueError):
        overlay.overlay(a, None, "difference")


def test_copies_of_polygons_meet_others_once(spark, monkeypatch):
    """A hundred copies of three rectangles, as larger tables have them: no more pairs are compared than of one copy, and how often pieces are covered stays."""
    one = [[square(0, 0, 4)], [square(1, 0, 4)], [square(2, 2, 5)[::-1]]]
    compared, met = [], overlay._met
    monkeypatch.setattr(overlay, "_met", lambda placed, key: compared.append(placed.count()) or met(placed, key))
    few = overlay.compared(spark.createDataFrame(edges_of(one[:1]), EDGES), spark.createDataFrame(edges_of(one[1:]), EDGES)).collect()
    n = compared[-1]
    many = overlay.compared(spark.createDataFrame(edges_of(one[:1] * 100), EDGES), spark.createDataFrame(edges_of(one[1:] * 100), EDGES)).collect()
    assert compared[-1] == n and len(many) == len(few)
    assert {(*r[:4], *r[4:]) for r in many} == {(*r[:4], *[100 * c for c in r[4:]]) for r in few}
