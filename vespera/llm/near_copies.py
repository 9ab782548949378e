"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

First by SimHash (simhash.py): texts get a fingerprint of their 5-word shingles, the multi-index tables give the fingerprints
within 4 bits, and the texts behind them are linked if their sets are that similar. Fingerprints miss most pairs of 0.8 to 0.9,
so an exact join follows, and no pair is missed: under one order of all shingles, two sets of such similarity share one of the
first n // 5 + 1 shingles of each (n: its size). Any order serves; this one has the hashes of frequent shingles last, since few
sets should share a first one. Which count as frequent is estimated from the shingles of one set in SAMPLE; that decides how
long lists of sets with a common shingle are, not what is found. A shingle whose bit in a map of LATE bits is set by a frequent one is
late with it.

At a shingle that two sets share, at positions p and q, their overlap is at most 1 + min(n - p - 1, m - q - 1) if it is the first
one. That and bitmaps of the sets rule out most pairs. The others are compared whole, as sets of XXH64 values.

Equal sets are one node. Of the sets that share a shingle, all are compared with the smallest first; then those that neither
this nor SimHash has connected with each other.

Words are op7's: ASCII case is folded, ASCII white space separates. A text of fewer than 5 words is one shingle; texts
without words are equal. Only links of 0.8 or more count, but a component's ends may be less alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from vespera.llm import simhash
from vespera.llm.common import bounded_batches, durable, short_shuffles
from vespera.llm.simhash import SEED, components, one_per_label, row_digest

SHINGLE = 5
#: A shingle is frequent if by the estimate so many sets have it.
FREQUENT, SAMPLE = 64, 8
LATE = 1 << 23
#: A bitmap has so many bits a shingle at least, and so many 64-bit words: a power of 2.
BITS, LEAST_WORDS = 4, 8


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The hashes of the text's shingles, ascending."""
    return np.unique(simhash.shingle_hashes(text, k).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *arrays]), pa.int64()))


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit for each shingle, several for one bit. A set has as many shingles that another lacks as bits, at least."""
    words = max(LEAST_WORDS, 1 << max(0, BITS * len(s) - 1).bit_length() >> 6)
    bits = np.zeros(64 * words, np.uint8)
    bits[s.view(np.uint64) % np.uint64(64 * words)] = 1
    return np.packbits(bits).view(np.int64)


def _digest(s: np.ndarray) -> np.ndarray:
    return np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64)


def _marks():
    """node (a digest of the set), n (its size), fp (the text's fingerprint), bits (the set's bitmap), sketch (folded to the least size), some: the whole set for one node in SAMPLE."""

    @F.arrow_udf("struct<node:long,n:int,fp:long,bits:array<long>,sketch:array<long>,some:array<long>>")
    def marks(text: pa.Array) -> pa.Array:
        hashes = [simhash.shingle_hashes(t.as_py(), SHINGLE) for t in text]
        sets = [np.unique(h.view(np.int64)) for h in hashes]
        nodes = np.array([_digest(s) for s in sets], np.int64)
        fps = np.array([simhash.majority(h) for h in hashes], np.uint64).view(np.int64)
        some = [s if node % SAMPLE == 0 else s[:0] for s, node in zip(sets, nodes)]
        bits = [bitmap(s) for s in sets]
        sketches = [np.bitwise_or.reduce(b.reshape(-1, LEAST_WORDS)) for b in bits]
        return pa.StructArray.from_arrays([pa.array(nodes), pa.array(list(map(len, sets)), pa.int32()), pa.array(fps), _lists(bits), _lists(sketches), _lists(some)], names=["node", "n", "fp", "bits", "sketch", "some"])

    return marks


def _firsts(late: np.ndarray):
    """node, first: the shingles that similar sets share one of, those of late bits last."""

    @F.arrow_udf("struct<node:long,first:array<long>>")
    def firsts(text: pa.Array) -> pa.Array:
        sets = [shingle_set(t.as_py()) for t in text]
        first = []
        for s in sets:
            at = s.view(np.uint64) % np.uint64(LATE)
            last = (late[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            first.append(np.concatenate([s[~last], s[last]])[: len(s) // 5 + 1])
        return pa.StructArray.from_arrays([pa.array(np.array([_digest(s) for s in sets], np.int64)), _lists(first)], names=["node", "first"])

    return firsts


def _sets():
    @F.arrow_udf("array<long>")
    def sets(text: pa.Array) -> pa.Array:
        return _lists([shingle_set(t.as_py()) for t in text])

    return sets


def _texts(docs: DataFrame, rows: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """node, __t: the texts of nodes, by a row (doc_id, row) of each."""
    rows = durable(rows.join(nodes, "node"), "rows")  # of known size: a small one is broadcast
    keyed = docs.select(F.col("doc_id").alias("__id"), row_digest(docs).alias("__row"), F.col(text).alias("__t"))
    found = keyed.join(rows, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row"))).select("node", "__t", "members")
    return found.filter("members = 1").union(found.filter("members > 1").dropDuplicates(["node"])).select("node", "__t")


def _possible(a: str, b: str) -> Column:
    """Whether sets can be similar whose first shared shingle is at these positions: 9 times their overlap is 4 times the sum of their sizes."""
    n, m, i, j = (F.col(f"{x}.{c}") for c in ("n", "pos") for x in (a, b))
    return 9 * (1 + F.least(n - i - 1, m - j - 1)) >= 4 * (n + m)


def _alike(a: str, b: str) -> Column:
    """Whether sets can be similar by their sketches: neither has more in common than its size less what the other lacks."""
    lacks = lambda x, y: sum(F.bit_count(F.get(F.col(f"{x}.sketch"), F.lit(w)).bitwiseAND(F.bitwise_not(F.get(F.col(f"{y}.sketch"), F.lit(w))))) for w in range(LEAST_WORDS))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return 9 * F.least(n - lacks(a, b), m - lacks(b, a)) >= 4 * (n + m)


def _close() -> Column:
    """The same by whole bitmaps, for u and v.

    Sets of sizes that allow it have bitmaps of one size, or of one and its double, which is then folded.
    """
    words = F.least(F.size("u_bits"), F.size("v_bits"))
    bits = lambda c, w: F.get(F.col(c), w).bitwiseOR(F.when(F.size(c) > words, F.get(F.col(c), w + words)).otherwise(F.lit(0).cast("long")))
    at = F.sequence(F.lit(0), words - 1)
    lacks = lambda x, y: F.aggregate(F.transform(at, lambda w: F.bit_count(bits(x, w).bitwiseAND(F.bitwise_not(bits(y, w))))), F.lit(0), lambda s, c: s + c)
    n, m = F.col("u_n"), F.col("v_n")
    sizes = 5 * F.least(n, m) >= 4 * F.greatest(n, m)
    return F.when(sizes, 9 * F.least(n - lacks("u_bits", "v_bits"), m - lacks("v_bits", "u_bits")) >= 4 * (n + m)).otherwise(False)


def _of(df: DataFrame, c: str) -> DataFrame:
    return df.select(*[F.col(x).alias(c if x == "node" else f"{c}_{x}") for x in df.columns])


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """The pairs u, v of nodes whose sets are similar. Bitmaps rule out most pairs before whole sets are read."""
    bits = nodes.select("node", "n", "bits")
    pairs = durable(pairs.join(_of(bits, "u"), "u").join(_of(bits, "v"), "v").filter(_close()).select("u", "v"), "close")
    needed = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    sets = durable(_texts(docs, rows, needed, text).select("node", _sets()(F.col("__t")).alias("set")), "sets")
    both = F.size(F.array_intersect("u_set", "v_set"))
    return durable(pairs.join(_of(sets, "u"), "u").join(_of(sets, "v"), "v").filter(9 * both >= 4 * (F.size("u_set") + F.size("v_set"))).select("u", "v"), "similar")


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """u, v: nodes whose fingerprints the multi-index tables link, one node for each fingerprint; and that node with the others of its fingerprint."""
    heads = durable(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")), "fingerprints")
    head = lambda c: heads.select(F.col("fp").alias(f"{c}_fp"), F.col("head").alias(c))
    links = simhash.links(heads.select("fp")).withColumnsRenamed({"u": "u_fp", "v": "v_fp"})
    linked = links.join(head("u"), "u_fp").join(head("v"), "v_fp").select("u", "v")
    return linked.union(nodes.select("node", "fp").join(heads.filter("n > 1"), "fp").filter("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v")))


def _late(nodes: DataFrame, frequent: int) -> np.ndarray:
    """A map of LATE bits, those of frequent shingles set: 1 MB whatever the input, eight of its bytes a row until here."""
    often = nodes.select(F.explode("some").alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") * SAMPLE >= frequent)
    at = F.col("key").bitwiseAND(F.lit(LATE - 1).cast("long"))
    word, bit = F.shiftright(at, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    found = often.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    late = np.zeros(LATE >> 6, np.int64)
    late[found["word"].to_numpy()] = found["bits"].to_numpy()
    return late.view(np.uint8)  # little-endian: bit i is in byte i >> 3


def near_copies(docs: DataFrame, text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, row (its row_digest), label: a number for each component of similar texts."""
    with short_shuffles(docs.sparkSession):
        return _near_copies(docs, text, frequent)


def _near_copies(docs: DataFrame, text: str, frequent: int) -> DataFrame:
    bounded_batches(docs.sparkSession)
    marked = durable(docs.select("doc_id", row_digest(docs).alias("row"), _marks()(F.col(text)).alias("s")).select("doc_id", "row", "s.*"), "marks")
    members = marked.select("doc_id", "row", "node")
    rows = durable(members.groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("r"), F.count("*").alias("members")).select("node", "r.doc_id", "r.row", "members"), "nodes")
    equal = durable(rows.filter("members > 1").select("node"), "equal")
    once = lambda df: df.join(equal, "node", "left_anti").union(df.join(equal, "node", "left_semi").dropDuplicates(["node"]))  # noqa: E731  a row for each node
    nodes = durable(once(marked.select("node", "n", "fp", "bits", "sketch")), "sets")
    late = _late(once(marked.filter(F.size("some") > 0).select("node", "some")), frequent)
    firsts = durable(docs.select(_firsts(late)(F.col(text)).alias("s")).select("s.*"), "firsts")
    postings = once(firsts).select("node", F.posexplode("first").alias("pos", "key"))
    keys = durable(postings.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "shared")
    shared = durable(postings.join(keys.hint("merge"), "key", "left_semi"), "postings")
    shared = durable(shared.join(nodes.select("node", "n"), "node").select("key", "node", "n", "pos"), "postings")
    hubs = shared.groupBy("key").agg(F.min(F.struct("n", "node", "pos")).alias("hub"))
    starred = durable(shared.join(hubs, "key"), "starred")
    stars = starred.select("key", "hub", F.struct("node", "n", "pos").alias("own")).filter("hub.node <> own.node")
    stars = stars.filter(_possible("hub", "own")).select(F.col("hub.node").alias("u"), F.col("own.node").alias("v"))
    ordered = lambda df: df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = durable(ordered(_by_fingerprint(nodes).union(stars)), "pairs")
    similar = _verified(pairs, nodes, docs, rows, text)
    labels = components(similar)
    named = starred.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("c")).filter("x <> y AND c > 2").select("key")
    left = durable(named.join(mixed, "key").select("key", "node", "pos", "label").join(nodes.select("node", "n", "sketch"), "node"), "mixed")
    a, b = left.alias("a"), left.alias("b")
    apart = (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label"))
    rest = a.join(b, (F.col("a.key") == F.col("b.key")) & apart & _possible("a", "b") & _alike("a", "b")).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    more = _verified(durable(rest.join(pairs, ["u", "v"], "left_anti"), "pairs"), nodes, docs, rows, text)
    if more.limit(1).count():
        labels = components(similar.union(more))
    return members.join(labels, "node", "left").select("doc_id", "row", F.coalesce("label", "node").alias("label"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component of near copies: that with the least doc_id."""
    with short_shuffles(docs.sparkSession):
        return one_per_label(docs, durable(near_copies(docs, **options), "labels"))
