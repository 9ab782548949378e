"""Small text and JSON inputs: manifests, download lists, clip polygons, tile directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vespera.config import PipelineConfig

CORNER = "array<double>"


def load_config(spark: SparkSession, path: str) -> PipelineConfig:
    return PipelineConfig.parse(spark.read.text(path, wholetext=True).first()[0])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """box_idx, name, north, west, south, east of a JSON manifest; one without boxes, and boxes without two full corners, are an error."""
    raw = spark.read.schema(f"boxes array<struct<top_left:{CORNER},bottom_right:{CORNER}>>").json(path, multiLine=True)
    some = F.when(F.coalesce(F.size("boxes"), F.lit(0)) > 0, F.col("boxes")).otherwise(F.raise_error(F.lit("a manifest needs at least one box")))
    return named_boxes(raw.select(some.alias("boxes")))


def named_boxes(manifests: DataFrame) -> DataFrame:
    """box_idx, name and corners of manifests (boxes, other columns that stay). Names have as many digits as the last index, three at least, so that their order is that of the boxes."""
    others = [c for c in manifests.columns if c != "boxes"]
    digits = F.greatest(F.length((F.size("boxes") - 1).cast("string")), F.lit(3))
    box = manifests.select(*others, digits.alias("digits"), F.posexplode("boxes").alias("box_idx", "b"))
    bad = (F.coalesce(F.size("b.top_left"), F.lit(0)) != 2) | (F.coalesce(F.size("b.bottom_right"), F.lit(0)) != 2)
    corner = lambda c, i: F.when(bad, F.raise_error(F.lit("a box corner needs two numbers"))).otherwise(F.get(f"b.{c}", F.lit(i))).cast("double")
    return box.select(
        *others, "box_idx", F.concat(F.lit("box_"), F.lpad(F.col("box_idx").cast("string"), F.col("digits"), F.lit("0"))).alias("name"),
        corner("top_left", 0).alias("north"), corner("top_left", 1).alias("west"), corner("bottom_right", 0).alias("south"), corner("bottom_right", 1).alias("east"),
    )


def clip_rings(spark: SparkSession, path: str) -> DataFrame:
    """poly, ring, seq, lon, lat of the polygons of a GeoJSON file."""
    text = spark.read.text(path, wholetext=True)
    ring = "array<array<array<double>>>"
    one = F.from_json("value", f"type string, geometry struct<type:string,coordinates:string>, coordinates string, features array<struct<geometry:struct<type:string,coordinates:string>>>")
    geometry = F.when(F.col("g.type") == "FeatureCollection", F.col("g.features.geometry")).when(F.col("g.type") == "Feature", F.array("g.geometry")).otherwise(
        F.array(F.struct(F.col("g.type").alias("type"), F.col("g.coordinates").alias("coordinates")))
    )
    each = text.select(one.alias("g")).select(F.explode(geometry).alias("x")).select("x.type", "x.coordinates")
    polys = F.when(F.col("type") == "MultiPolygon", F.from_json("coordinates", f"array<{ring}>")).when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", ring))).otherwise(
        F.raise_error(F.lit("only polygons can clip"))
    )
    flat = each.select(F.explode(polys).alias("rings")).withColumn("poly", F.monotonically_increasing_id())
    return flat.select("poly", F.posexplode("rings").alias("ring", "points")).select("poly", "ring", F.posexplode("points").alias("seq", "p")).select("poly", "ring", "seq", F.get("p", F.lit(0)).alias("lon"), F.get("p", F.lit(1)).alias("lat"))


def dem_tiles(names: DataFrame) -> DataFrame:
    """south, west and name of the newest DEM file of each tile, of names (name); the greatest name of equally new ones."""
    pattern = r"(?i)^USGS_13_n(\d+)w(\d+)_(\d*).*\.tif$"
    part = lambda i: F.regexp_extract("name", pattern, i)
    found = names.filter(F.col("name").rlike(pattern)).select((part(1).cast("int") - 1).alias("south"), (-part(2).cast("int")).alias("west"), "name", F.coalesce(part(3).try_cast("long"), F.lit(0).cast("long")).alias("date"))
    return found.groupBy("south", "west").agg(F.max_by("name", F.struct("date", "name")).alias("name"))
