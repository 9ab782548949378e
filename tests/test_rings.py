"""Rings around cells: filling them gives the cells back, polygons are the cells that hang together by their sides, holes have owners."""

import random

import pytest
from pyspark.sql import functions as F

from vespera.operators import polygons, rasters, rings


def parts(cells):
    """The sets of cells that hang together by sides."""
    left, out = set(cells), []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            r, c = todo.pop()
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.remove(n)
                    part.add(n)
                    todo.append(n)
        out.append(frozenset(part))
    return set(out)


def filled(spark, table, size):
    """The cells of each polygon by the even-odd rule."""
    edges = [(r.poly, *map(float, e)) for r in table.collect() for e in zip(r.x, r.y, r.x[1:], r.y[1:])]
    found = rasters.fill(spark.createDataFrame(edges, "poly long, x0 double, y0 double, x1 double, y1 double"), size, size).collect()
    return {p: frozenset((r.row, r.col) for r in found if r.poly == p) for p in {r.poly for r in found}}


def nested(n):
    """Square in square in square, n deep: polygons in the holes of others."""
    return {(r, c) for r in range(4 * n) for c in range(4 * n) if min(r, c, 4 * n - 1 - r, 4 * n - 1 - c) % 2 == 0}


def snake(n):
    """One long winding way: a ring of many corners."""
    return {(r, c) for r in range(n) for c in range(n) if r % 2 == 0 or c == (n - 1 if r % 4 == 1 else 0)}


CASES = {"nested": nested(3), "snake": snake(17), "corners": {(r, c) for r in range(8) for c in range(8) if (r + c) % 2}, "one": {(0, 0)}, "holes that touch": {(r, c) for r in range(5) for c in range(5)} - {(1, 1), (2, 2), (3, 1)}} | {
    f"random {k}": {(r, c) for r in range(14) for c in range(14) if random.Random(k * 1000 + r * 20 + c).random() < share} for k, share in enumerate((0.35, 0.6, 0.8))
}


@pytest.mark.parametrize("name", CASES)
def test_filled_rings_are_the_cells(spark, name):
    cells = CASES[name]
    table = rings.polygons_of(spark.createDataFrame(sorted(cells) * 2, "row int, col int")).cache()
    assert set(filled(spark, table, 24).values()) == parts(cells)
    for r in table.collect():
        area = sum(a * d - c * b for a, b, c, d in zip(r.x, r.y, r.x[1:], r.y[1:])) / 2
        assert (area > 0) == (r.ring == 0) and (r.x[0], r.y[0]) == (r.x[-1], r.y[-1])
        turns = [(b - a, d - c) for a, b, c, d in zip(r.x, r.x[1:], r.y, r.y[1:])]
        assert all((x == 0) != (y == 0) for x, y in turns) and all((a[0] == 0) != (b[0] == 0) for a, b in zip(turns, turns[1:]))


def test_no_cells_degrees_and_a_document(spark):
    none = spark.createDataFrame([], "row int, col int")
    assert rings.polygons_of(none).count() == 0
    table = rings.polygons_of(spark.createDataFrame([(2, 3)], "row int, col int"), 0.5, -123.0, 37.0)
    r = table.first()
    assert (r.x, r.y) == ([-121.5, -121.0, -121.0, -121.5, -121.5], [38.0, 38.0, 38.5, 38.5, 38.0])
    assert '"MultiPolygon"' in polygons.feature_collection(table, "a", "b").first().json
    assert rings.areas(rings.ring_points(none)).agg(F.count("*")).first()[0] == 0
