"""Toxicity by the nearest labelled examples.

Texts are TF-IDF vectors over all words of a bounded sample of labelled documents, none over MAX_EXAMPLE characters. A word's weight is
(1 + ln tf) * idf * |delta|: idf from document frequencies over all documents, and delta the smoothed log
ratio of the word's document frequencies in the two classes, as in Delta TF-IDF. No word of the sample
is left out, and any other word has a delta of zero. Examples are kept in an inverted index whose
postings are cut into blocks with the greatest weight of each, so that blocks and examples that cannot
reach the best K are skipped while the K largest cosines stay exact. The neighbours' votes, weighted by squared cosine
and by how often their class occurs, are their evidence.

A logistic curve maps votes to scores. It is fitted on the examples, each voted on by the others, so a
score estimates the chance of label 1.

Only the text enters a score. Null and empty texts have no words; a text without neighbours gets the
score of a vote at the rate of label 1, and every text 0 if nothing is labelled. Of several labels of a
doc_id the largest holds, of several texts the least; null labels and null ids are not learnt from, and
a null id is not held out. Ties between equal cosines go to the smaller example number. Rows are scored
independently, so repeated rows get equal scores. Columns that clash with the operator's are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vespera.llm.common import bounded_batches, durable, unused, without

#: Bounds of the labelled sample, by class.
MAX_TOXIC, MAX_CLEAN = 1000, 2000
#: Longer labelled documents are no examples, so that the driver holds a bounded number of words.
MAX_EXAMPLE = 100_000
#: Examples that a class frequency is smoothed with; neighbours; examples in a block of the index.
SMOOTHING, K, BLOCK, THRESHOLD = 5.0, 16, 64, 0.7
COLUMNS = ("held_out", "score", "predicted", "evidence")
#: Terms that one in so many examples has are common, and how many of these are held as dense rows.
COMMON, COMMON_TERMS = 8, 1024
#: Bytes that belong to words: digits, lower-case letters and all of other scripts.
_SPACED = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))
#: Votes that a worker remembers, for copies of texts.
REMEMBERED = 5_000


def split_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SPACED).split()


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of consecutive ranges, one range after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class BlockMaxIndex:
    """Exact top-k cosine over sparse unit vectors.

    Terms that one in COMMON examples has are rows of a dense matrix, COMMON_TERMS at most: one product gives what they add to
    every cosine. Postings of the others stand in blocks of examples, each with its greatest weight. No cosine falls as terms
    are added, so the k-th greatest sum so far rules out the blocks whose bounds stay below it.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        """vectors: terms and weights of each example."""
        self.n, self.blocks, self.block = len(vectors), -(-len(vectors) // block), block
        term = np.concatenate([np.empty(0, np.int64), *[t for t, _ in vectors]])
        example = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        weight = np.concatenate([np.empty(0), *[w for _, w in vectors]])
        held = np.bincount(term, minlength=n_terms)
        common = np.argsort(-held, kind="stable")[:COMMON_TERMS]
        common = common[held[common] * COMMON >= max(1, self.n)]
        self.row = np.full(n_terms, -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n))
        dense = self.row[term] >= 0
        self.dense[self.row[term[dense]], example[dense]] = weight[dense]
        term, example, weight = term[~dense], example[~dense], weight[~dense]
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order].astype(np.int32), weight[order]
        number = self.example // block
        starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (number[1:] != number[:-1])]) if len(term) else np.empty(0, np.int64)
        self.begin, self.length, self.number = starts, np.diff(np.r_[starts, len(term)]), number[starts]
        self.most = np.maximum.reduceat(self.weight, starts) if len(starts) else np.empty(0)
        self.first = np.searchsorted(term[starts], np.arange(n_terms + 1))  # a term's blocks

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """(cosine, example) of the k greatest cosines over 0, best first; equal ones by example. skip: an example that is left out."""
        if not self.n:
            return []
        row = self.row[terms]
        query = np.zeros(len(self.dense))
        query[row[row >= 0]] = weights[row >= 0]
        cosine = query @ self.dense
        if skip >= 0:
            cosine[skip] = 0.0
        least = float(np.partition(cosine, self.n - k)[self.n - k]) * (1 - 1e-9) if self.n > k else 0.0
        rare, scale = terms[row < 0], weights[row < 0]
        size = self.first[rare + 1] - self.first[rare]
        parts, scale = _spread(self.first[rare], size), np.repeat(scale, size)
        bound = np.maximum.reduceat(cosine, np.arange(0, self.n, self.block)) + np.bincount(self.number[parts], self.most[parts] * scale, self.blocks)
        keep = bound[self.number[parts]] >= least
        own = parts[keep]
        places = _spread(self.begin[own], self.length[own])
        cosine += np.bincount(self.example[places], self.weight[places] * np.repeat(scale[keep], self.length[own]), self.n)
        if skip >= 0:
            cosine[skip] = 0.0
        if self.n > k:
            least = max(least, float(np.partition(cosine, self.n - k)[self.n - k]))
        near = np.flatnonzero((cosine >= least) & (cosine > 0))
        near = near[np.lexsort((near, -cosine[near]))[:k]]
        return list(zip(cosine[near].tolist(), near.tolist()))


class NearestExamples:
    """The fitted model: words, their weights, examples (doc_id, label, terms, counts), class weights, and the curve from votes to scores."""

    def __init__(self, words: list[bytes], weight: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]], class_weight: tuple[float, float], k: int = K):
        self.words, self.weight, self.k, self.class_weight = {w: i for i, w in enumerate(words)}, weight, k, class_weight
        # Examples whose heaviest words are alike share blocks, whose bounds are the tighter for it.
        vectors = [self.vector(t, n) for _, _, t, n in examples]
        heaviest = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        order = sorted(range(len(examples)), key=lambda i: (examples[i][1], heaviest[i], examples[i][0]))
        self.labels = [(examples[i][0], examples[i][1]) for i in order]
        vectors = [vectors[i] for i in order]
        self.index = BlockMaxIndex(vectors, len(words))
        mass = [sum(class_weight[y] for _, y in self.labels if y == label) for label in (0, 1)]
        self.rate = mass[1] / sum(mass) if self.labels else 0.0
        self.slope, self.offset = self.fitted(vectors) if all(mass) else (1.0, 0.0)

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        found = np.array([i for i in map(self.words.get, split_words(text)) if i is not None], np.int64)
        found.sort()
        at = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else found
        return found[at], np.diff(np.r_[at, len(found)])

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.weight[terms]
        heavy = w > 0
        norm = math.sqrt(float(w @ w))
        return terms[heavy], w[heavy] / norm if norm else w[heavy]

    def vote(self, vector: tuple[np.ndarray, np.ndarray], skip: int = -1) -> tuple[float, list[tuple[int, int, float]]]:
        near = [(*self.labels[i], s) for s, i in self.index.search(*vector, self.k, skip)]
        votes = [(y, s * s * self.class_weight[y]) for _, y, s in near]
        whole = sum(w for _, w in votes)
        return (sum(w for y, w in votes if y) / whole if whole else self.rate), near

    @staticmethod
    def logit(vote):
        return np.log((vote + 0.01) / (1.01 - vote))

    def fitted(self, vectors) -> tuple[float, float]:
        """Slope and offset of the logistic curve: a few steps of Newton's method on the examples' votes without themselves."""
        x = self.logit(np.array([self.vote(v, i)[0] for i, v in enumerate(vectors)]))
        y, w = np.array([y for _, y in self.labels], float), np.array([self.class_weight[y] for _, y in self.labels])
        design, curve = np.c_[x, np.ones(len(x))], np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(design @ curve, -30, 30)))
            slope = design.T @ (w * (p - y)) + 1e-3 * (curve - [1.0, 0.0])
            curve = curve - np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), slope)
        return float(max(curve[0], 1e-3)), float(curve[1])

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        if not self.labels:
            return 0.0, []
        vote, near = self.vote(self.vector(terms, counts))
        return float(1 / (1 + math.exp(-(self.slope * self.logit(vote) + self.offset)))), near


def learnable() -> Column:
    """Whether a row's label may be learnt: crc32 of the id as text, modulo 3, is not 1. Null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def _counter(words: list[bytes]):
    known = {w: i for i, w in enumerate(words)}

    @F.arrow_udf("struct<term:array<int>,n:array<int>>")
    def counted(text: pa.Array) -> pa.Array:
        counts = [np.unique(np.array([i for i in map(known.get, split_words(x.as_py())) if i is not None], np.int64), return_counts=True) for x in text]
        return pa.StructArray.from_arrays([pa.array([list(a[j]) for a in counts], pa.list_(pa.int32())) for j in (0, 1)], names=["term", "n"])

    return counted


def _distinct_words():
    @F.arrow_udf("array<binary>")
    def distinct_words(text: pa.Array) -> pa.Array:
        return pa.array([list(set(split_words(x.as_py()))) for x in text], pa.list_(pa.binary()))

    return distinct_words


def frequencies(docs: DataFrame, text: str, words: list[bytes]) -> np.ndarray:
    """In how many rows of docs each word occurs; each task sends a count for each word at most."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # the sample's words

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: i for i, w in enumerate(shared.value)}
        held = np.zeros(len(known), np.int64)
        for batch in batches:
            for x in batch.column(0):
                held[list({i for i in map(known.get, split_words(x.as_py())) if i is not None})] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at])], names=["term", "n"])

    found = docs.select(text).mapInArrow(tally, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(words), np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, k: int = K) -> NearestExamples:
    """The model of at most max_toxic + max_clean labelled documents; document frequencies are those of all docs."""
    bounded_batches(docs.sparkSession)
    known = labels.filter(learnable() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    classes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pick = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, max_toxic), (0, max_clean))]
    chosen = F.broadcast(pick[0].union(pick[1]))  # max_toxic + max_clean rows at most
    short = F.coalesce(F.length(text) <= MAX_EXAMPLE, F.lit(True))
    sample = docs.filter(short).select("doc_id", F.col(text).alias("__t")).join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("__t").alias("__t"))
    sample = durable(sample, "examples")
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    found = sample.select("toxic", F.explode(_distinct_words()(F.col("__t"))).alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).toArrow()
    terms = sorted(zip(found.column("term").to_pylist(), found.column("a").to_pylist(), found.column("n").to_pylist()))
    words, a, n = [t[0] for t in terms], np.array([t[1] for t in terms], float), np.array([t[2] for t in terms], float)
    toxic, clean = max(1, size.get(1, 0)), max(1, size.get(0, 0))
    part = toxic / (toxic + clean)
    delta = np.abs(np.log((a + SMOOTHING * part) / toxic) - np.log((n - a + SMOOTHING * (1 - part)) / clean))
    idf = np.log((1 + docs.count()) / (1 + frequencies(docs, text, words))) + 1
    rows = sample.select("doc_id", "toxic", _counter(words)(F.col("__t")).alias("c")).select("doc_id", "toxic", "c.*").orderBy("doc_id").toArrow().to_pylist()
    examples = [(r["doc_id"], r["toxic"], np.array(r["term"], np.int64), np.array(r["n"], np.int64)) for r in rows]
    weight = [classes.get(y, 0) / max(1, size.get(y, 0)) for y in (0, 1)]
    mean = sum(weight[e[1]] for e in examples) / max(1, len(examples)) or 1.0
    return NearestExamples(words, idf * delta, examples, (weight[0] / mean, weight[1] / mean), k)


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD, **bounds) -> DataFrame:
    """docs without text, with held_out, score, predicted and evidence (neighbours' doc_id, label and cosine)."""
    docs = without(docs, COLUMNS)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, text, **bounds))  # a bounded number of examples
    remembered: dict = {}

    @F.arrow_udf("struct<score:double,evidence:array<struct<doc_id:long,label:int,cosine:double>>>")
    def voted(texts: pa.Array) -> pa.Array:
        model, scores, evidence = shared.value, [], []
        for x in texts:
            terms, counts = model.count(x.as_py())
            key = terms.tobytes(), counts.tobytes()
            if key not in remembered:
                if len(remembered) >= REMEMBERED:
                    remembered.clear()
                score, near = model.score(terms, counts)
                remembered[key] = score, [{"doc_id": d, "label": y, "cosine": s} for d, y, s in near]
            scores.append(remembered[key][0])
            evidence.append(remembered[key][1])
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(evidence, kind)], names=["score", "evidence"])

    names = [c for c in docs.columns if c != text]
    out = docs.select(*names, voted(F.col(text)).alias(unused(docs, "vote")))
    vote = F.col(unused(docs, "vote"))
    return out.select(*names, F.coalesce(~learnable(), F.lit(False)).alias("held_out"), vote["score"].alias("score"), (vote["score"] >= threshold).cast("int").alias("predicted"), vote["evidence"].alias("evidence"))
