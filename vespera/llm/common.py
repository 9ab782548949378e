"""What the text operators share: shared storage, bounded Arrow batches, clash-free columns."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Arrow batches stop at this many bytes or rows, so that a worker holds little of a partition.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1024

#: Stands for a null id inside keys: sorts before every real id.
NULL_ID = -(2**63)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: A key that more than one in HOT of all rows have is frequent. So there are fewer than HOT frequent keys, whatever the input.
HOT = 10_000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds on Arrow batches to these where they are higher. Plans read them when they run, so they stay lowered."""
    for key, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = (spark.conf.get(key) or "").strip().lower().rstrip("b")
        if not held.isdigit() or not 0 < int(held) <= bound:
            spark.conf.set(key, str(bound))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Only a local master may go without; it gets a temporary folder, and keeps it for the session.
    """
    conf = spark.sparkContext.getConf()
    if path := conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = "spark.vespera.sharedDir"
    if not (path := spark.conf.get(key, None)):
        spark.conf.set(key, path := "file://" + tempfile.mkdtemp(prefix="vespera-"))
    return path


#: Paths of the tables that durable() has written, by application.
_WRITTEN: dict[str, list[str]] = {}


def durable(df: DataFrame, label: str) -> DataFrame:
    """df as a table written in the shared folder: lineage ends there and lost executors lose nothing. release() removes it."""
    path = kept_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, known to release()."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def short_shuffles(spark: SparkSession):
    """Inside, Spark deletes the shuffle files of a query when that has run, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, held)


def release(spark: SparkSession) -> int:
    """Deletes what the operators have written in the shared folder and returns the number of paths. For when all results are stored: DataFrames that operators returned can't be read afterwards."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)


def spread_join(rows: DataFrame, facts: DataFrame, on: list[str], total: int, n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined on keys with facts, which has one small row for each key and in n how many of the total rows have it.

    Facts of frequent keys are broadcast, fewer than HOT of them, so that their rows stay where they are; the others are
    shuffled. Both are read twice. Keys must not be null.
    """
    hot = F.col(n) * HOT > total
    found, mark = facts.drop(n), unused(rows, "hot")
    frequent = F.broadcast(facts.filter(hot).drop(n).withColumn(mark, F.lit(True)))
    other = rows.join(F.broadcast(facts.filter(hot).select(*on)), on, "left_anti").join(facts.filter(~hot).drop(n), on, how)
    return rows.join(frequent, on).drop(mark).select(*rows.columns, *[c for c in found.columns if c not in on]).unionByName(other)


def unused(df: DataFrame, name: str) -> str:
    """name behind underscores, as many as make it no column of df: for a column that is dropped again."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """df without the columns an operator is about to add: the operator's columns win over clashing ones."""
    return df.drop(*names)


def id_key(c: Column | str) -> Column:
    """An id as a join key: null ids count as one id that sorts first."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(NULL_ID).cast("long"))


def real_id(c: Column) -> Column:
    """The id that a key made by id_key stands for."""
    return F.when(c != F.lit(NULL_ID).cast("long"), c)


def at_work(docs: DataFrame) -> DataFrame:
    """docs in as many partitions at least as there are cores to work on them: a small file is one partition, however much work its texts are. Inputs of more partitions stay where they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
