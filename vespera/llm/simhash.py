"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two segments of 32 bits. Two fingerprints at 4 or fewer differing bits agree
in the first segment but for 2 bits, or in the second but for 1 (else they differ in 3 + 2 = 5 bits).
The tables therefore hold small Hamming balls: both sides list all values within 1 bit of the first
segment, so that any two within 2 bits meet; one side lists those of the second. Matches are checked
by the whole distance. Links connect documents to components, found by iterative joins.

Equal fingerprints are one node, however many documents share them. A bucket with more than
MAX_BUCKET fingerprints emits no pairs: its members link through the values within 2 bits of them,
which gives the same components (two fingerprints share such a value exactly if they are within 4 bits)
with rows in proportion to the members.

Spark takes an exploded table for as small as what it is made of, and would broadcast it where that is below
spark.sql.autoBroadcastJoinThreshold; so joins of such tables are merge joins by a hint.

Null texts have no words, and texts without words have fingerprint 0. Rows with the same doc_id but
several texts keep a row each and are one node apiece. A null doc_id stays null and names a component
only if no other id is in it. Only doc_id and the text column of the input are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from vespera.llm.common import bounded_batches, durable, spread_join, unused

SHINGLE, SEED, MAX_BITS = 4, 42, 4
MAX_BUCKET = 2048
SEGMENT = (1 << 32) - 1


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """A hash for each of the text's shingles, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six separators
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k, joined, ends = min(k, n), b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts, stops, digest = [0, *ends[: n - k].tolist()], (ends[k - 1 :] - 1).tolist(), xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n - k + 1)


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # very long texts a piece at a time
        total += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, k))


def _fingerprints(k: int):
    @F.arrow_udf("long")
    def fingerprints(text: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), k) for t in text], np.uint64).view(np.int64), pa.int64())

    return fingerprints


def _ball(bits: int) -> list[int]:
    return [0, *(1 << i for i in range(bits))]


def _probes(fps: DataFrame, near_second: bool) -> DataFrame:
    """fp and the keys under which it is listed; bit 32 of a key tells the segment."""
    first, second = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(SEGMENT))
    masks = lambda ball: F.array(*[F.lit(m).cast("long") for m in ball])
    a = F.transform(masks(_ball(32)), lambda m: first.bitwiseXOR(m))
    b = F.transform(masks(_ball(32) if near_second else [0]), lambda m: second.bitwiseXOR(m).bitwiseOR(F.lit(1 << 32)))
    return fps.select("fp", F.explode(F.concat(a, b)).alias("key"))


def _through_centres(fps: DataFrame) -> DataFrame:
    """Links of the members of crowded buckets, by way of the values within 2 bits of them."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.transform(F.sequence(i, F.lit(63)), lambda j: bit(i).bitwiseOR(bit(j)))))
    near = F.transform(pairs, lambda mask: F.col("fp").bitwiseXOR(mask))
    listed = fps.select("fp", F.explode(F.concat(F.array("fp"), near)).alias("centre"))
    least = listed.groupBy("centre").agg(F.min("fp").alias("least"))
    return listed.join(least.hint("merge"), "centre").filter("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v"))


def links(fps: DataFrame, max_bits: int = MAX_BITS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """u < v: pairs of distinct fingerprints within max_bits (4 at most), or links that connect the same ones."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the tables serve 0 to 4 differing bits")
    if max_bits < MAX_BITS:
        max_bucket = 2**62  # centres serve 4 bits only
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")  # 65 rows come of each
    left, right = _probes(fps, True), _probes(fps, False)
    crowded = durable(right.groupBy("key").count().filter(F.col("count") > max_bucket).select("key"), "crowded")
    if crowded.limit(1).count():
        members = right.join(crowded, "key").select("fp").union(left.join(crowded, "key").select("fp")).distinct()
        extra = _through_centres(members)
        left, right = left.join(crowded, "key", "left_anti"), right.join(crowded, "key", "left_anti")
    else:
        extra = None
    r = right.withColumnRenamed("fp", "other")
    # A pair within 2 bits of the first segment meets there under one of two keys, or under the whole ball if those are equal: one
    # meeting counts. The second segment's ball finds a pair once, and counts if the first has not.
    apart = F.shiftrightunsigned(F.col("fp").bitwiseXOR(F.col("other")), 32)
    first = F.col("key") <= SEGMENT
    own = F.when(apart == 0, F.col("key") == F.shiftrightunsigned("fp", 32)).otherwise(F.col("key") <= F.col("key").bitwiseXOR(apart))
    once = F.when(first, own).otherwise(F.bit_count(apart) > 2)
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits
    pairs = left.join(r.hint("merge"), "key").filter((F.col("fp") < F.col("other")) & close & once).select(F.col("fp").alias("u"), F.col("other").alias("v"))
    if extra is not None:
        pairs = pairs.union(extra.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    return pairs.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that edges (u, v) reach. Empty of nodes without edges.

    Each round points nodes at their least neighbour, follows the pointers to their ends, and contracts the
    edges to those ends, of which there are at most half as many as nodes; so rounds shrink quickly.
    """
    edges, labels = durable(edges.select("u", "v"), "edges"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v"), F.count("*").alias("degree"))
        ends = durable(least.select("node", F.least("node", "v").alias("up"), "degree"), "ends")
        nodes, links = ends.count(), 2 * edges.count()
        while True:
            pointed = ends.groupBy("up").agg(F.count("*").alias("n")).join(ends.select(F.col("node").alias("up"), F.col("up").alias("next")), "up")
            moved = spread_join(ends, durable(pointed, "pointed"), ["up"], nodes)  # many may point at one node
            moved = durable(moved.select("node", F.col("up").alias("old"), F.col("next").alias("up"), "degree"), "ends")
            ends = moved.select("node", "up", "degree")
            if not moved.filter("old <> up").limit(1).count():
                break
        if labels is None:
            labels = ends.select("node", F.col("up").alias("label"))
        else:
            counts = labels.groupBy("label").agg(F.count("*").alias("n"))
            ups = durable(counts.join(ends.select(F.col("node").alias("label"), "up"), "label"), "ups")
            labels = spread_join(labels, ups, ["label"], labels.count(), how="left")
            labels = durable(labels.select("node", F.coalesce("up", "label").alias("label")), "labels")
        to = lambda c: ends.select(F.col("node").alias(c), F.col("up").alias(f"{c}_end"), F.col("degree").alias("n"))
        left = spread_join(edges, to("u"), ["u"], links)
        left = spread_join(left, to("v"), ["v"], links).filter("u_end <> v_end")  # a node with many neighbours is a key of many edges
        edges = durable(left.select(F.least("u_end", "v_end").alias("u"), F.greatest("u_end", "v_end").alias("v")).distinct(), "edges")
        if not edges.limit(1).count():
            return labels


def row_digest(docs: DataFrame) -> Column:
    """Tells rows of one id apart: a digest of all columns, nulls included."""
    return F.xxhash64(*[c for name in docs.columns for c in (F.col(name), F.col(name).isNull())])


def _labelled(docs: DataFrame, row: Column, text: str, shingle: int, max_bits: int, max_bucket: int) -> DataFrame:
    """doc_id, row, fp, label (the least fingerprint that links reach), component_id."""
    bounded_batches(docs.sparkSession)
    marked = durable(docs.select(F.col("doc_id"), row.alias("row"), _fingerprints(shingle)(F.col(text)).alias("fp")), "fingerprints")
    nodes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least_doc"), F.count("*").alias("n")), "nodes")
    labels = components(links(nodes.select("fp"), max_bits, max_bucket))
    named = durable(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "named")
    heads = named.groupBy("label").agg(F.min("least_doc").alias("component_id"), F.count("*").alias("n"))
    found = durable(spread_join(named.select("fp", "label", F.col("n").alias("docs")), durable(heads, "heads"), ["label"], named.count()), "found")
    return spread_join(marked, found.withColumnRenamed("docs", "n"), ["fp"], marked.count())


def simhash_components(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id that links reach)."""
    found = _labelled(docs, F.lit(0).cast("long"), text, shingle, max_bits, max_bucket)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_label(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """docs with one row of each label of labelled (doc_id, row: their row_digest, label): the least real doc_id, then the least digest."""
    counts = labelled.groupBy("label", "doc_id", "row").agg(F.count("*").alias("n"))
    least = counts.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n")).alias("h"))
    row, own, head, n = (unused(docs, c) for c in ("row", "id", "head", "n"))
    heads = durable(least.select(F.col("h.doc_id").alias(own), F.col("h.row").alias(head), F.col("h.n").alias(n)), "heads")
    rows = docs.withColumn(row, row_digest(docs))
    of = lambda h: rows.join(h, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(row) == F.col(head)), "left_semi").drop(row)
    if not heads.filter(F.col(n) > 1).limit(1).count():
        return of(heads)
    return of(heads.filter(F.col(n) == 1)).union(of(heads.filter(F.col(n) > 1)).dropDuplicates())


def drop_near_duplicates(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """docs with one row of each component: the one whose doc_id names it, or any one if no row has an id. Repeated rows of it become one."""
    return one_per_label(docs, durable(_labelled(docs, row_digest(docs), text, shingle, max_bits, max_bucket).select("doc_id", "row", "label"), "components"))
