"""Incremental runs: which boxes are due, which outputs are orphans, which downloads are newest."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

BOUNDS = ["north", "west", "south", "east"]
LEDGER_VERSION = 1


def config_hash(text):
    return F.sha2(text, 256)


def inputs_hash(boxes: DataFrame, outline: str) -> DataFrame:
    """One row, hash: of the bounds of boxes (box_idx, north, west, south, east) in order and of an outline's text, as a JSON document with a blank behind each comma and colon."""
    rows = boxes.agg(F.sort_array(F.collect_list(F.struct("box_idx", *BOUNDS))).alias("b"))  # a manifest, as a person draws it
    land = hashlib.sha256(outline.encode()).hexdigest()

    @F.arrow_udf("string")
    def hashed(bounds: pa.Array) -> pa.Array:
        documents = [json.dumps({"boxes": b, "us_land_sha256": land}, sort_keys=True) for b in bounds.to_pylist()]
        return pa.array(["sha256:" + hashlib.sha256(d.encode()).hexdigest() for d in documents], pa.string())

    return rows.select(hashed(F.transform("b", lambda x: F.array(*[x[c].cast("double") for c in BOUNDS]))).alias("hash"))


def entered(boxes: DataFrame, version: int = LEDGER_VERSION) -> DataFrame:
    """boxes as the ledger holds them after their run."""
    return boxes.select("name", *BOUNDS, "config_hash", F.lit(version).alias("version"))


def due(boxes: DataFrame, ledger: DataFrame, version: int = LEDGER_VERSION) -> DataFrame:
    """boxes (name, bounds, config_hash) that the ledger of finished runs doesn't have in the same shape and version."""
    same = [boxes[c].eqNullSafe(ledger[c]) for c in ["name", *BOUNDS, "config_hash"]]
    if "version" in ledger.columns:
        same.append(ledger["version"] == version)
    on = same[0]
    for s in same[1:]:
        on = on & s
    return boxes.join(ledger, on, "left_anti")


def orphans(outputs: DataFrame, boxes: DataFrame) -> DataFrame:
    return outputs.join(boxes, "name", "left_anti")


def left_over(files: DataFrame, count: int) -> DataFrame:
    """The files (name) of boxes, rasters or sidecars, whose index is beyond a manifest of count boxes."""
    index = F.regexp_extract("name", r"^box_(\d+)\.tif(?:\.json)?$", 1)
    return files.filter((index != "") & (index.cast("long") >= count)).orderBy("name")


def newest(items: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key: the first in order, by a partial aggregate rather than a sort of each key's rows."""
    rest = [c for c in items.columns if c not in key]
    return items.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b")).select(*key, "b.*")


def offsets(strips: DataFrame, rows: str, order: str, box: str) -> DataFrame:
    """strips with row_off: rows of the strips before them in their box."""
    before = W.partitionBy(box).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return strips.withColumn("row_off", F.coalesce(F.sum(rows).over(before), F.lit(0)).cast("long"))
