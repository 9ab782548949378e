"""Importance resampling towards a target: the documents whose words are likelier in the target are likelier drawn.

Every feature (a run of words) falls in a bucket by its hash. Two counting jobs, whose tasks send one number for each
bucket they met, give an array of gains, one for each bucket; a document's weight is the mean gain of its features, taken
from that array. With Gumbel noise that depends on the doc_id alone, the highest scores are a sample without
replacement in proportion to the weights' exponentials.

The draw is a radix selection. A row's key is (score from the top, doc_id, hash of the text, row number), four whole numbers. Digit
by digit, from the most significant that differs, a job counts the rows that agree with the k-th key so far by their next digit,
2**DIGIT counts at most; the bucket that holds the k-th row goes on. That ends at one row, whose key is
the exact k-th. Rows up to it, and no others, are sorted by ranges and ranked.

Null texts have no words; a document without features weighs 0. A null id counts as the empty text in the noise and sorts
before all ids. Rows of one id and score follow each other by a hash of the text; rows that are wholly alike may take each other's
ranks. Empty tables give empty results; an empty target counts 0 everywhere. Input columns that clash with the operator's are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vespera.llm.common import at_work, bounded_batches, durable, id_key, without
from vespera.llm.sharding import ranked

RUNS, BUCKETS, SEED, MIN_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Bits that a job of the selection tells apart.
DIGIT = 12
COLUMNS = ("n_features", "weight", "score", "rank")
#: Columns of the key, each a long; unique together.
KEY = ["high", "id", "text", "row"]
SIGN = 1 << 63
#: Bytes of words (digits, letters, other scripts) as lower case, all others as spaces.
_WORDS = bytes(c + 32 if 65 <= c < 91 else c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def feature_buckets(words: list[bytes], runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all runs of 1 to runs consecutive words, repeats included."""
    features = [words, *([b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] for n in range(2, runs + 1))]
    return np.fromiter((crc32(f) for part in features for f in part), np.int64, sum(map(len, features))) % buckets


def bucket_counts(docs: DataFrame, text: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall in each bucket; a task sends a row for each bucket at most."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held += np.bincount(feature_buckets(split_words(t), runs, buckets), minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["bucket", "n"])

    found = docs.select(F.col(text).cast("binary")).mapInArrow(tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's floored 1000-fold log ratio of its smoothed shares in target and corpus."""
    n, whole, aim = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (whole + n) / ((s + 1) * (aim + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Floored 1000-fold Gumbel noise of an id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("long")


def weighed(docs: DataFrame, target: DataFrame, text: str = "text", runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """own (a struct of docs' columns but the text), n_words, n_features, weight, score and the KEY columns, stored."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, text, runs, buckets), bucket_counts(target, text, runs, buckets)))  # a number a bucket

    @F.arrow_udf("struct<n_words:long,n_features:long,weight:long>")
    def scored(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            words = split_words(t)
            found = shared.value[feature_buckets(words, runs, buckets)]
            out.append((len(words), len(found), int(found.sum()) // len(found) if len(found) else 0))
        return pa.StructArray.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["n_words", "n_features", "weight"])

    own = F.struct(*[c for c in docs.columns if c != text])
    out = docs.select(own.alias("own"), F.xxhash64(F.col(text)).alias("text"), scored(F.col(text).cast("binary")).alias("w"))
    score = F.col("w.weight") + noise(F.col("own.doc_id"), seed)
    out = out.select("own", "w.*", score.alias("score"), F.bitwise_not(score).alias("high"), id_key("own.doc_id").alias("id"), "text", F.monotonically_increasing_id().alias("row"))
    return durable(out, "weighed")


def kth_key(rows: DataFrame, key: list[str], k: int, digit: int = DIGIT) -> tuple[int, ...]:
    """The k-th least key (k from 1) of rows, whose key columns are longs: radix selection from the highest digit that differs."""
    found: list[int] = []
    for name in key:
        x = F.col(name)
        low, high = rows.agg(F.min(x), F.max(x)).first()
        bits = ((low + SIGN) ^ (high + SIGN)).bit_length()  # above these all agree
        low = ((low + SIGN) >> bits << bits) - SIGN
        while bits:
            width = min(digit, bits)
            bits -= width
            place = F.shiftrightunsigned(x.bitwiseXOR(F.lit(-SIGN)), bits).bitwiseAND(F.lit((1 << width) - 1))
            for at, n in sorted((r["at"], r["n"]) for r in rows.groupBy(place.alias("at")).agg(F.count("*").alias("n")).collect()):  # 2**digit rows at most
                if k <= n:
                    break
                k -= n
            low += at << bits
            rows = rows.filter(x.between(F.lit(low), F.lit(low + (1 << bits) - 1)))
            if n == 1:
                return tuple(rows.select(*key).first())
        found.append(low)
    return tuple(found)


def upto(key: list[str], bound: tuple[int, ...]) -> Column:
    """Whether a row's key is at most bound."""
    out = F.lit(True)
    for name, value in reversed(list(zip(key, bound))):
        out = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & out)
    return out


def resample(docs: DataFrame, target: DataFrame, text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """docs without text, with n_features, weight, score and rank: 1, 2, ... for the drawn percent of the documents of min_words or more, else null."""
    docs = at_work(without(docs, COLUMNS))
    rows = weighed(docs, target, text, **options)
    fit = F.col("n_words") >= min_words
    k = rows.filter(fit).count() * percent // 100
    columns = ["own.*", "n_features", "weight", "score"]
    if not k:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = fit & upto(KEY, kth_key(rows.filter(fit), KEY, k))
    first = ranked(rows.filter(drawn), KEY, "drawn").select(*columns, (F.col("rank") + 1).alias("rank"))
    return first.union(rows.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
