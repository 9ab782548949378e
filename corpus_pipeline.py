"""A corpus pipeline of five operators: each stage takes the documents that the one before it kept.

STAGES: (name, function of spark, docs and sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vespera.llm import decontaminate, line_dedup, near_copies, pieces, quality
from vespera.llm.common import durable, table

#: Stages use XXH64, the closure of links and a vocabulary file, which SQL has not; tests compare run() with a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go."""
    return quality.quality_rules(docs).filter("kept").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that recur across documents; n_chars follows."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their 5-word shingles one stays, that with the least doc_id."""
    return near_copies.drop_near_copies(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).filter("NOT contaminated").select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids that a model is trained on, for each document."""
    return pieces.encode_pieces(docs).select("doc_id", "lang", "source", "n_ids", "ids")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("near-dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pieces", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
