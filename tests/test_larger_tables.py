"""Queries on tables whose rows repeat places, as larger tables' do, against their SQL."""

import duckdb
import pytest

from vespera.operators import overlay
from vespera.plans import file_queries, queries as plans, vector_queries


def differences(spark, folder, query, tables):
    """Rows that a query has and its SQL has not, and those it lacks, counting repeats; and how many SQL has."""
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    got = query(spark, str(folder))
    rows, names = [tuple(r) for r in got.collect()], ", ".join(f'"{c}"' for c in got.columns)
    expected = con.execute(f"SELECT {names} FROM ({plans.SQL[query.__name__]})").fetchall()
    left = list(expected)
    extra = [r for r in rows if r not in left or left.remove(r)]
    return extra, left, len(expected)


def test_shorelines_of_squares_that_repeat(spark, tmp_path):
    """Squares come again after 359 * 120 customers, in another file or the same; the land of a place has one row."""
    customers = [(k + i * 43_080, (k + i * 2) % 25) for k in range(1, 900) for i in range(3)]
    tables = {"customer": (customers, "c_custkey long, c_nationkey int"), "supplier": ([(k,) for k in range(7200)], "s_suppkey long")}
    extra, missing, n = differences(spark, tmp_path, file_queries.shoreline_ranges_s6_s7, tables)
    assert not extra and not missing and n > 5


def test_areas_of_rectangles_that_repeat(spark, tmp_path, monkeypatch):
    """Rectangles come again after 4,092 suppliers: areas are the SQL's, and no more edges of different polygons are compared than without copies."""
    compared, met = [], overlay._met

    def counted(placed, key):
        if not key:  # of different polygons
            compared.append(placed.count())
        return met(placed, key)

    monkeypatch.setattr(overlay, "_met", counted)
    tables = lambda n: {"nation": ([(k,) for k in range(25)], "n_nationkey int"), "supplier": ([(k + i * 4092,) for i in range(n) for k in range(120)], "s_suppkey long")}
    counts = []
    for n in (1, 20):
        compared.clear()
        extra, missing, rows = differences(spark, tmp_path, vector_queries.overlay_areas_s10_u3_u4_a10, tables(n))
        assert not extra and not missing and rows == 3
        counts.append(sum(compared))
    assert counts[0] == counts[1] > 0


@pytest.mark.parametrize("nations, suppliers, sets", [([0], [5], 2), ([], [1, 5], 1), ([], [], 0), ([*range(25)] * 2, [*range(60)] * 2, 3)])
def test_areas_of_sets_that_are_empty_and_of_keys_that_repeat(spark, tmp_path, nations, suppliers, sets):
    """A set that holds nothing has no row, and a key that comes twice is one polygon."""
    tables = {"nation": ([(k,) for k in nations], "n_nationkey int"), "supplier": ([(k,) for k in suppliers], "s_suppkey long")}
    assert differences(spark, tmp_path, vector_queries.overlay_areas_s10_u3_u4_a10, tables) == ([], [], sets)
