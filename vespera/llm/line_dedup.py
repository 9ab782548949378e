"""Line dedup: lines that recur across documents stay only in the document with the largest id.

Lines are exploded with their positions as hashes of their normalised form, distinct documents are counted
per hash, hashes over the threshold give up the positions that hold them, and each text is put together
again from the lines at the positions that stay. All of it is DataFrame functions; texts move once, to meet
the positions they lose, and the lists of positions are the side that is hashed.

A line that is found everywhere is one key with a large part of all rows: its counts are combined before
they are shuffled, and the verdicts on such keys are broadcast (see spread_join).

Null and empty texts have one empty line and become the empty text. Rows that share a doc_id are one
document, and null ids are one document whose id is less than all others; repeated rows lose the same
lines. A line is known by a 128-bit hash, a row by its doc_id and a 64-bit hash of its text. Input columns
that clash with the operator's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vespera.llm.common import LOWER, UPPER, durable, id_key, spread_join, unused, without

STRIP = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
COLUMNS = ("n_lines", "n_dropped")


def exploded(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, row, pos, h1, h2: the lines whose keys are long enough."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(id_key("doc_id").alias("doc"), F.xxhash64(t).alias("row"), F.posexplode(F.split(t, "\n", -1)).alias("pos", "line"))
    lines = lines.filter(F.octet_length("line") >= min_chars).withColumn("key", F.btrim("line", F.lit(STRIP))).filter(F.length("key") >= min_chars)
    key = F.when(F.octet_length("key") == F.length("key"), F.lower("key")).otherwise(F.translate("key", UPPER, LOWER))  # both lower A-Z only
    return lines.select("doc", "row", "pos", key.alias("key")).select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def _put_together(text: Column, lines: str, gone: str) -> Column:
    """The lines that are not at the ascending positions gone: the runs between those, one after the other."""
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1) + 1)
    end = lambda i: F.coalesce(F.get(gone, i), F.size(lines))
    runs = F.transform(F.sequence(F.lit(0), F.size(gone)), lambda i: F.slice(lines, begin(i) + 1, end(i) - begin(i)))
    return F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.flatten(runs), "\n"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs (doc_id, text, ...) with text rebuilt, and n_lines before and n_dropped."""
    lines, key = durable(exploded(docs, "text", min_chars), "lines"), ["h1", "h2"]
    often = lines.groupBy(*key, "doc").agg(F.count("*").alias("n")).groupBy(*key).agg(F.count("*").alias("docs"), F.max("doc").alias("keeper"), F.sum("n").alias("n"))
    often = durable(often.filter(F.col("docs") >= min_docs).select(*key, "keeper", "n"), "often")
    lost = spread_join(lines, often, key, lines.count()).filter(F.col("doc") != F.col("keeper"))
    out = without(docs, COLUMNS)
    doc, row, gone, cut = (unused(out, c) for c in ("doc", "row", "gone", "lines"))
    gaps = lost.groupBy(F.col("doc").alias(doc), F.col("row").alias(row)).agg(F.sort_array(F.collect_set("pos")).alias(gone))
    names, t = out.columns, F.coalesce(F.col("text"), F.lit(""))
    out = out.withColumns({doc: id_key("doc_id"), row: F.xxhash64(t)}).join(gaps.hint("shuffle_hash"), [doc, row], "left")
    out = out.withColumn(cut, F.when(F.col(gone).isNotNull(), F.split(t, "\n", -1)))
    n_lines = (F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).cast("long")
    kept = _put_together(t, cut, gone).alias("text")
    return out.select(*[kept if c == "text" else c for c in names], n_lines.alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"))
