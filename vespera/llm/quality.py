"""Quality rules, judged per document and per host.

Base rules look at one text. Host rules aggregate base failures by host, shrink each host's failure
rate towards the corpus with an empirical beta prior, and join the verdict back to the documents: a host
goes where its rate stands out from the prior and most of its documents fail.

Null and empty texts have no words and fail the base rules. A null host is a host of its own. Repeated
rows are judged like any other row. Input columns that clash with the operator's are replaced.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vespera.llm.common import bounded_batches, durable, unused, without

SYMBOLS = b"#*$%&|<>"
SEPARATORS = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COLUMNS = (*COUNTS, "base_failed", "host_rate", "kept")
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A host goes when its shrunk failure rate is over the prior's mean by this many of the prior's standard deviations (bad
#: hosts widen it themselves). That
#: limit is kept between these rates: where most of its documents fail, those that pass are not trusted either, and a prior
#: so wide that no rate stands out from it excuses no host that fails nearly always.
MAX_SPREAD, LEAST_RATE, MOST_RATE = 2.0, 0.5, 0.9
#: Verdicts are broadcast up to this many rejected hosts, and joined by a shuffle beyond.
BROADCAST_HOSTS = 50_000


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words found at two or more places."""
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    often, covered, upto = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered += i + window - max(i, upto)
            upto = i + window
    return covered


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()  # bytes split at exactly the six separators
    seen: set[bytes] = set()
    dup = 0
    if raw.count(b"\n"):
        for line in raw.split(b"\n"):
            if line in seen:
                dup += bool(line.split(None, 1))
            else:
                seen.add(line)
    chars = len(text) - sum(raw.count(bytes([c])) for c in SEPARATORS)
    return len(words), chars, sum(raw.count(bytes([c])) for c in SYMBOLS), dup, repeated_words(words)


def _measures():
    fields = [pa.field(c, pa.int64()) for c in COUNTS]

    @F.arrow_udf("struct<" + ",".join(f"{c}:long" for c in COUNTS) + ">")
    def measures(text: pa.Array) -> pa.Array:
        columns = zip(*(measure(t.as_py()) for t in text)) if len(text) else [[] for _ in COUNTS]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=fields)

    return measures


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of the base rules and base_failed."""
    bounded_batches(docs.sparkSession)
    out = without(docs, COLUMNS)
    names, m = out.columns, unused(out, "measures")
    out = out.withColumn(m, _measures()(F.col(text))).select(*names, *[F.col(m)[c].alias(c) for c in COUNTS])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_rates(judged: DataFrame, host: str = "source") -> tuple[DataFrame, float]:
    """(host, host_docs, host_failed, host_rate: failure rates shrunk with a beta prior fitted to all hosts), and the rate from which a host goes.

    The prior's mean is the corpus rate. Its variance is that of the hosts' own rates less what sampling alone puts into
    them, mean * (1 - mean) / documents of a host; its strength is mean * (1 - mean) / variance - 1, between 1 and 1,000
    pseudo-documents, and 1,000 where sampling explains all of the spread.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")
    )
    hosts = durable(hosts, "hosts")
    rate = F.col("host_failed") / F.col("host_docs")
    total = hosts.agg(F.sum("host_failed").alias("f"), F.sum("host_docs").alias("n"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("host_docs")).alias("w")).first()
    mean = total.f / total.n if total.n else 0.0
    binomial = mean * (1 - mean)
    spread = max(0.0, total.v - binomial * total.w) if total.n else 0.0
    strength = min(1000.0, max(1.0, binomial / spread - 1)) if spread else 1000.0
    limit = min(MOST_RATE, max(LEAST_RATE, mean + MAX_SPREAD * (binomial / (strength + 1)) ** 0.5))
    return hosts.withColumn("host_rate", (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))), limit


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", max_host_rate: float | None = None) -> DataFrame:
    """docs with the base counts, base_failed, host_rate (of rejected hosts, else null) and kept.

    max_host_rate: the rate from which hosts go; None: that of the fitted prior, see host_rates. The rules run once for
    the hosts' counts and once for the rows, so no text is shuffled or stored.
    """
    out = without(docs, COLUMNS)
    of, key = unused(out, "host"), unused(out, "key")
    host_of = F.col(host) if host in docs.columns else F.lit(None).cast("string")
    rates, limit = host_rates(base_rules(docs.select(F.col(text).alias("text"), host_of.alias("host"))), "host")
    bad = rates.filter(F.col("host_rate") >= (limit if max_host_rate is None else max_host_rate)).select(F.col("host").alias(of), "host_rate")
    small = bad.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    judged = base_rules(docs, text).withColumn(key, host_of)
    out = judged.join(F.broadcast(bad) if small else bad, F.col(key).eqNullSafe(F.col(of)), "left")
    return out.drop(key, of).withColumn("kept", ~F.col("base_failed") & F.col("host_rate").isNull())
