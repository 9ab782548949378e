"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every WINDOW - K + 1 consecutive k-grams of words the least hash is kept, so any span of WINDOW
words that a document shares with a benchmark item has a kept k-gram in common with it. Documents and
items are joined on those fingerprints; each hit is checked word by word and extended to both sides,
and counts if it reaches WINDOW words. Items shorter than WINDOW words are matched whole.

Null, empty and wordless texts have no words; such items match nothing. Words compare after A-Z are
lowered and nothing else. Rows with equal doc_id and text get equal results, one row each. Items that
share an item_id count once. Input columns that clash with the operator's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vespera.llm.common import HOT, LOWER, UPPER, durable, id_key, spread_join, unused, without

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, K = 10, 5
COLUMNS = ("n_words", "n_hit", "n_items", "item_ids", "contaminated")
#: The benchmark's fingerprints are broadcast up to this many, with the words around them up to so many bytes, and shuffled beyond.
BROADCAST_PRINTS, BROADCAST_BYTES = 200_000, 64 << 20
#: A kept k-gram is packed as 32 bits of hash above 31 bits of position.
POSITION = 31
#: Parts that the hits of a frequent fingerprint are dealt to beyond these bounds.
SALTS = 64


def words(text: Column) -> Column:
    lowered = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))  # both lower A-Z only
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), SEPARATORS), lambda w: w != "")


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _packed(h: Column, k: int) -> Column:
    """The k-grams of words, given by their hashes, as packed hash and position in order. h is a column, not an expression: it is read for every word."""
    n = F.size(h) - k
    at = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    gram = lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])
    return F.transform(at, lambda i: F.shiftleft(F.shiftrightunsigned(gram(i), 32), POSITION).bitwiseOR(i.cast("long")))


def _winnowed(grams: Column, n: int) -> Column:
    """The least packed k-gram of every n consecutive ones, once each. grams is a column, not an expression: it is read once for every place."""
    at = F.when(F.size(grams) >= n, F.sequence(F.lit(0), F.size(grams) - n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.least(*[F.get(grams, i + j) for j in range(n)])))


def _with_prints(texts: DataFrame, window: int, k: int) -> DataFrame:
    """texts with __kept, the winnowed k-grams of the words whose hashes are __h."""
    return texts.withColumn("__g", _packed(F.col("__h"), k)).withColumn("__kept", _winnowed(F.col("__g"), window - k + 1)).drop("__g")


def _prints(words_of: DataFrame, keys: list[str], lengths: list[int], whole: bool) -> DataFrame:
    """keys, kind (0: winnowed, else the words of a short item), hash, pos; documents also get a row of kind -1 each."""
    tagged = lambda values, kind: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v")))
    lists = [tagged(F.col("__kept"), 0)]
    short = [tagged(_packed(F.col("__h"), n), n) for n in lengths]
    if whole:
        short = [F.when(F.size("__h") == n, x).otherwise(F.slice(x, 1, 0)) for n, x in zip(lengths, short)]
        end = []
    else:
        end = [F.array(F.struct(F.lit(-1).alias("kind"), F.size("__h").cast("long").alias("v")))]
    rows = words_of.select(*keys, F.explode(F.concat(*lists, *short, *end)).alias("__p"))
    v = F.col("__p.v")
    return rows.select(*keys, F.col("__p.kind").alias("kind"), F.shiftright(v, POSITION).cast("long").alias("hash"), v.bitwiseAND(F.lit((1 << POSITION) - 1)).cast("int").alias("pos"))


def _run(most: int, differ) -> Column:
    """How many of differ(0), differ(1), ... are false before the first that is not; most at most."""
    return (F.array_position(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda j: (j == most) | F.coalesce(differ(j), F.lit(True))), F.lit(True)) - 1).cast("int")


def _extended(w: Column, hit: Column, window: int, k: int) -> Column:
    """hit (pos, kind, gram, before, after, item_id) as item_id, start, end: start is null where words differ or the span is too short."""
    pos, kind, size = hit["pos"], hit["kind"], F.size(hit["gram"])
    reach = window - k
    same = F.forall(F.sequence(F.lit(0), size - 1), lambda j: F.coalesce(F.get(w, pos + j) == F.get(hit["gram"], j), F.lit(False)))
    left = _run(reach, lambda j: F.get(w, pos - 1 - j) != F.get(hit["before"], j))
    right = _run(reach, lambda j: F.get(w, pos + size + j) != F.get(hit["after"], j))
    start, end = F.when(kind > 0, pos).otherwise(pos - left), F.when(kind > 0, pos + size).otherwise(pos + size + right)
    return F.struct(hit["item_id"].alias("item_id"), F.when(same & ((kind > 0) | (end - start >= window)), start).alias("start"), end.alias("end"))


def _salted(hits: DataFrame, marks: DataFrame) -> DataFrame:
    """hits joined with marks on kind and hash, with the hits of frequent fingerprints in SALTS parts and their marks in each of these."""
    total, key = hits.count(), ["kind", "hash"]
    frequent = F.broadcast(durable(hits.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") * HOT > total).select(*key, F.lit(True).alias("__hot")), "frequent"))  # fewer than HOT
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64("__doc", "__text", "pos"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    each = marks.join(frequent, key, "left").withColumn("__salt", F.explode(parts)).drop("__hot")
    return hits.join(frequent, key, "left").withColumn("__salt", salt).drop("__hot").join(each, [*key, "__salt"]).drop("__salt")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """docs with n_words, n_hit, n_items, item_ids (sorted as strings) and contaminated."""
    items = benchmark.select(F.col("item_id"), words(F.col("text")).alias("__w")).filter(F.size("__w") > 0).distinct()
    items = _with_prints(items.withColumn("__h", _hashes(F.col("__w"))), window, k)
    lengths = sorted(r.n for r in items.select(F.size("__w").alias("n")).filter(F.col("n") < window).distinct().collect())  # under ten values
    marks = _prints(items.withColumn("__at", F.col("__w")), ["item_id", "__at"], lengths, whole=True)
    size = F.when(F.col("kind") > 0, F.col("kind")).otherwise(F.lit(k))
    reach = window - k
    marks = marks.select(
        "kind", "hash", "item_id", F.slice("__at", F.col("pos") + 1, size).alias("gram"),
        F.reverse(F.slice("__at", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(reach)))).alias("before"),
        F.slice("__at", F.col("pos") + size + 1, F.lit(reach)).alias("after"),
    ).distinct()
    marks = durable(marks, "marks")
    keys = durable(marks.select("kind", "hash").distinct(), "prints")
    small = keys.limit(BROADCAST_PRINTS + 1).count() <= BROADCAST_PRINTS

    # The first pass finds which fingerprints of a document the benchmark has; kind -1 carries its word count.
    source = docs.select(id_key("doc_id").alias("__doc"), F.xxhash64(text).alias("__text"), _hashes(words(F.col(text))).alias("__h"))
    source = _with_prints(source, window, k)
    own = _prints(source, ["__doc", "__text"], lengths, whole=False)
    if small:
        known = F.broadcast(keys.withColumn("__known", F.lit(True)))
        found = own.join(known, ["kind", "hash"], "left").filter("kind = -1 OR __known")
    else:  # fingerprints that many documents have stay where they are, the others are shuffled
        known = durable(own.groupBy("kind", "hash").agg(F.count("*").alias("n")).join(keys, ["kind", "hash"]), "known")
        total = known.agg(F.sum("n")).first()[0] or 0
        found = spread_join(own.filter("kind >= 0"), known, ["kind", "hash"], total).unionByName(own.filter("kind = -1"))
    found = durable(found.select("__doc", "__text", "kind", "hash", "pos"), "found")
    counts = found.filter("kind = -1").groupBy("__doc", "__text").agg(F.max(F.col("pos").cast("long")).alias("n_words"))

    # The second takes the words of those documents alone, and extends their hits.
    around = sum(F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w) + 8), F.lit(0).cast("long")) for c in ("gram", "before", "after"))
    held = marks.agg(F.count("*").alias("n"), F.sum(around).alias("bytes")).first()
    light = held.n <= BROADCAST_PRINTS and (held.bytes or 0) <= BROADCAST_BYTES  # then a k-gram that many documents have isn't gathered
    hits = found.filter("kind >= 0").distinct()
    hits = hits.join(F.broadcast(marks), ["kind", "hash"]) if light else _salted(durable(hits, "hits"), marks)
    hits = hits.groupBy("__doc", "__text").agg(F.collect_list(F.struct("pos", "kind", "gram", "before", "after", "item_id")).alias("__hits"))
    texts = docs.select(id_key("doc_id").alias("__doc"), F.xxhash64(text).alias("__text"), F.col(text).alias("__t"))
    spans = hits.join(texts, ["__doc", "__text"]).withColumn("__w", words(F.col("__t")))
    spans = spans.withColumn("__s", F.filter(F.transform("__hits", lambda h: _extended(F.col("__w"), h, window, k)), lambda s: s["start"].isNotNull()))
    # No filter on __s here: it would be pushed below the projections and read the text's words anew for every hit.
    spans = spans.select(
        "__doc", "__text",
        F.size(F.array_distinct(F.flatten(F.transform("__s", lambda s: F.sequence(s["start"], s["end"] - 1))))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform("__s", lambda s: s["item_id"].cast("string")))).alias("item_ids"),
    ).dropDuplicates(["__doc", "__text"])
    result = counts.join(spans, ["__doc", "__text"], "left")
    out = without(docs, COLUMNS)
    doc, row = unused(out, "doc"), unused(out, "row")
    result = result.withColumnsRenamed({"__doc": doc, "__text": row})
    return out.withColumns({doc: id_key("doc_id"), row: F.xxhash64(text)}).join(result, [doc, row]).select(
        *out.columns, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"),
    )
