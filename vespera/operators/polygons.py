"""Sets of polygons on the grid's cells, and the few operations that stay on vectors."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from vespera.operators.rasters import without_cells

CELL = ("row", "col")


def union_cells(*parts: DataFrame, key: tuple[str, ...] = CELL) -> DataFrame:
    """The cells that any part holds, once each: what dissolving polygons leaves of them."""
    out = parts[0].select(*key)
    for part in parts[1:]:
        out = out.unionByName(part.select(*key))
    return out.distinct()


def common_cells(cells: DataFrame, other: DataFrame, key: tuple[str, ...] = CELL) -> DataFrame:
    """The cells of both: an intersection."""
    return cells.join(other.select(*key).distinct(), list(key), "left_semi")


def outside(outline: DataFrame, boxes: DataFrame, ocean: DataFrame, key: tuple[str, ...] = CELL) -> DataFrame:
    """Cells of an outline that neither boxes nor the ocean hold. The boxes are cut out of the ocean first, so only the ocean outside them is looked at."""
    return without_cells(outline, boxes, without_cells(ocean, boxes, key=key), key=key)


def rectangles(boxes: DataFrame, cell: float, south: float, west: float) -> DataFrame:
    """row, col of the cells whose centres lie in boxes (north, west, south, east); row 0 in the south."""
    steps = lambda c, origin, edge: F.ceil((F.col(c) - F.lit(origin)) / F.lit(cell) - 0.5).cast("int") - edge
    out = boxes.withColumns({"a": steps("south", south, 0), "b": steps("north", south, 1), "c": steps("west", west, 0), "d": steps("east", west, 1)}).filter("a <= b AND c <= d")
    return out.withColumn("row", F.explode(F.sequence("a", "b"))).withColumn("col", F.explode(F.sequence("c", "d"))).select("row", "col").distinct()


def country(features: DataFrame, admin: str = "United States of America", kind: str = "Country") -> DataFrame:
    """The features (properties with ADMIN and TYPE, geometry) of a country."""
    return features.filter((F.col("properties.ADMIN") == admin) & (F.col("properties.TYPE") == kind))


def south_of(polygons: DataFrame, limit: float = 50.0) -> DataFrame:
    """polygons (south, ...) without those that lie north of a latitude altogether."""
    return polygons.filter(F.col("south") < limit)


def thinned(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points (n, 2) of a line stay so that none left out is farther than the tolerance from it: the farthest of a stretch divides it."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stretches = [(0, len(points) - 1)]
    while stretches:
        a, b = stretches.pop()
        if b - a < 2:
            continue
        p, d = points[a + 1 : b] - points[a], points[b] - points[a]
        long = float(d @ d)
        t = np.clip(p @ d / long, 0, 1) if long else np.zeros(len(p))
        far = np.linalg.norm(p - t[:, None] * d, axis=1)
        k = int(np.argmax(far))
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            stretches += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplified(rings: DataFrame, tolerance: float) -> DataFrame:
    """rings (poly, ring, x, y: arrays of a closed ring) with fewer points. Rings of which nothing but a line would stay keep all points."""

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                points = np.column_stack([r.x, r.y])
                half = int(np.argmax(np.linalg.norm(points - points[0], axis=1))) if len(points) else 0
                keep = np.r_[thinned(points[: half + 1], tolerance)[:-1], thinned(points[half:], tolerance)] if 0 < half < len(points) - 1 else np.ones(len(points), bool)
                keep = keep if keep.sum() >= 4 else np.ones(len(points), bool)
                out.append({"poly": r.poly, "ring": r.ring, "x": points[keep, 0].tolist(), "y": points[keep, 1].tolist()})
            yield pd.DataFrame(out, columns=["poly", "ring", "x", "y"])

    return rings.select("poly", "ring", "x", "y").mapInPandas(thin, "poly long, ring int, x array<double>, y array<double>")


def feature_collection(rings: DataFrame, name: str, source: str, places: int = 4) -> DataFrame:
    """One row, json: a GeoJSON feature collection with one MultiPolygon of rings (poly, ring, x, y), its coordinates rounded.

    An outline is a document of one reader; it is meant for simplified ones.
    """
    pair = F.transform(F.arrays_zip("x", "y"), lambda p: F.array(F.round(p["x"], places), F.round(p["y"], places)))
    polys = rings.groupBy("poly").agg(F.sort_array(F.collect_list(F.struct("ring", pair.alias("c")))).alias("r")).select("poly", F.col("r.c").alias("c"))
    geometry = polys.agg(F.sort_array(F.collect_list(F.struct("poly", "c"))).alias("p")).select(F.struct(F.lit("MultiPolygon").alias("type"), F.col("p.c").alias("coordinates")).alias("g"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(name).alias("name"), F.lit(source).alias("source")).alias("properties"), F.col("g").alias("geometry"))
    return geometry.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("json"))


def with_provenance(document: str, version: int, inputs_hash: str) -> str:
    """A feature collection that says what it was made from."""
    return json.dumps(json.loads(document) | {"provenance": {"version": version, "inputs_sha256": inputs_hash}}, separators=(",", ":"))
