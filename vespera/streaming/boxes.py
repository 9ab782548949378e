"""Boxes as they arrive: each micro-batch runs what the ledger doesn't have yet, then enters it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from vespera.operators.runs import due, entered


def run_incrementally(boxes: DataFrame, ledger_path: str, checkpoint: str, run: Callable[[DataFrame], None]):
    """A query over a stream of boxes; a box enters the ledger only after its run has succeeded."""
    fields = "name string, north double, west double, south double, east double, config_hash string, version int"

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        try:
            ledger = spark.read.schema(fields).parquet(ledger_path)
        except Exception as e:  # the first run has none
            if "PATH_NOT_FOUND" not in str(e):
                raise
            ledger = spark.createDataFrame([], fields)
        todo = due(df, ledger).persist()
        try:
            if todo.limit(1).count():
                run(todo)
                entered(todo).write.mode("append").parquet(ledger_path)
        finally:
            todo.unpersist()

    return boxes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
