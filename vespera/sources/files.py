"""Files that a run reads or leaves beside its tables: input lists, download lists, sidecars, manifests, documents.

Paths go through Spark's file layer, so they may lie wherever it can read and write.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from vespera.operators.runs import BOUNDS, LEDGER_VERSION

SIDECAR = "version int, north double, west double, south double, east double, config_hash string"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; only a local master may go without that setting and gets a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.getConf().get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vespera-")
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    fs, place = _place(spark, path)
    fs.mkdirs(place)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a table in a new shared folder: it is made once, and its lineage ends there."""
    path = scratch(df.sparkSession, label) + "/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mounted(path: str) -> str:
    """A path or file URI as a path for programs; other URIs are an error."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"files are written to mounted folders, not to {path}")
    return path.removeprefix("file://")


def expand_inputs(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files as they are, folders as their .tif files by name: the order decides ties of a merge. What is missing or has none is an error."""
    out = []
    for path in paths:
        fs, place = _place(spark, path)
        if not fs.exists(place):
            raise ValueError(f"input does not exist: {path}")
        if not fs.getFileStatus(place).isDirectory():
            out.append(path)
            continue
        found = sorted(s.getPath().getName() for s in fs.listStatus(place) if s.isFile() and s.getPath().getName().endswith(".tif"))
        if not found:
            raise ValueError(f"input folder has no .tif files: {path}")
        out += [f"{path.rstrip('/')}/{name}" for name in found]
    return out


def names_of(spark: SparkSession, folder: str) -> DataFrame:
    """name of every file of a folder; none of a folder that is missing."""
    fs, place = _place(spark, folder)
    found = [(s.getPath().getName(),) for s in fs.listStatus(place) if s.isFile()] if fs.exists(place) else []
    return spark.createDataFrame(found, "name string")


def remove(spark: SparkSession, folder: str, names: DataFrame) -> list[str]:
    """Deletes the files (name) of a folder and returns their names in order."""
    gone = sorted(r.name for r in names.collect())  # files of a folder
    for name in gone:
        fs, place = _place(spark, f"{folder.rstrip('/')}/{name}")
        fs.delete(place, False)
    return gone


def emptied(spark: SparkSession, folder: str) -> str:
    """The folder with nothing in it."""
    fs, place = _place(spark, folder)
    fs.delete(place, True)
    fs.mkdirs(place)
    return folder


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A file that appears whole or not at all: it is written beside its place and then renamed."""
    fs, place = _place(spark, path)
    part = spark._jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs.setWriteChecksum(False)  # other programs may edit the file, and would not its checksum
    try:
        out = fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
    finally:
        fs.setWriteChecksum(True)
    if fs.exists(place):
        fs.delete(place, False)
    if not fs.rename(part, place):
        raise OSError(f"could not rename {part} to {place}")


def download_list(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tile, first_seen and url of each tile's newest download, by first place), (pos, url of lines that name no tile).

    lines: pos, line. Of equally new downloads the first one stays; blank lines are neither.
    """
    pattern = r"(?i)USGS_13_([a-z]\d+[a-z]\d+)_(\d{8})\.tif"
    named = lines.select("pos", F.trim(F.regexp_replace("line", r"\s", " ")).alias("url")).filter("url <> ''")
    part = lambda i: F.regexp_extract("url", pattern, i)
    found = named.withColumns({"tile": F.lower(part(1)), "date": part(2)})
    tiles = found.filter("tile <> ''").groupBy("tile").agg(F.min("pos").alias("first_seen"), F.max_by("url", F.struct("date", -F.col("pos"))).alias("url"))
    return tiles.orderBy("first_seen"), found.filter("tile = ''").select("pos", "url")


def write_download_list(spark: SparkSession, tiles: DataFrame, path: str) -> None:
    """The urls of tiles by first place, a line each: a list as short as that of the elevation tiles."""
    write_text(spark, path, "".join(f"{r.url}\n" for r in tiles.orderBy("first_seen").collect()))


def write_sidecars(spark: SparkSession, boxes: DataFrame, folder: str, version: int = LEDGER_VERSION) -> int:
    """name.tif.json beside the raster of each box (name, bounds, config_hash) that has been run."""
    rows = boxes.select("name", *BOUNDS, "config_hash").collect()  # boxes of a manifest
    for r in rows:
        write_text(spark, f"{folder.rstrip('/')}/{r.name}.tif.json", json.dumps({"version": version} | {c: r[c] for c in (*BOUNDS, "config_hash")}))
    return len(rows)


def read_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """name, version, bounds and config_hash of a folder's sidecars whose raster is there; what is no such document is left out."""
    text = spark.read.format("binaryFile").option("pathGlobFilter", "box_*.tif.json").load(folder)
    name = F.regexp_extract("path", r"([^/]*)\.tif\.json$", 1)
    doc = text.select(name.alias("name"), F.from_json(F.col("content").cast("string"), SIDECAR, {"mode": "PERMISSIVE"}).alias("d")).select("name", "d.*")
    rasters = names_of(spark, folder).select(F.regexp_extract("name", r"^(.*)\.tif$", 1).alias("name"))
    return doc.filter("version IS NOT NULL").join(rasters, "name", "left_semi")


def replace_boxes(spark: SparkSession, path: str, boxes: list[dict]) -> int:
    """Puts boxes into a manifest; its other members stay as they are. Boxes that aren't two corners of two numbers are an error."""
    for i, box in enumerate(boxes):
        corners = box.values() if isinstance(box, dict) and set(box) == {"top_left", "bottom_right"} else [None]
        for c in corners:
            if not (isinstance(c, list) and len(c) == 2 and all(isinstance(x, (int, float)) and not isinstance(x, bool) and x == x for x in c)):
                raise ValueError(f"box {i} needs exactly top_left and bottom_right, each a pair of numbers")
    document = json.loads(spark.read.text(path, wholetext=True).first()[0])
    write_text(spark, path, json.dumps(document | {"boxes": boxes}, indent=2) + "\n")
    return len(boxes)
