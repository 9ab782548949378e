"""Whole results of toxicity, sharding and decontamination beyond its broadcast bounds, against plain forms of their own."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vespera.llm import decontaminate, queries, sharding, toxicity


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def logit(v):
    return math.log((v + 0.01) / (1.01 - v))


def scored(docs, labels):
    """(doc_id, score) of each of docs (doc_id, text), by dense vectors and all cosines."""
    learnt = {}
    for i, y in labels:
        if i is not None and y in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1:
            learnt[i] = max(y, learnt.get(i, 0))
    texts = {}
    for i, t in docs:
        if i in learnt and len(t or "") <= toxicity.MAX_EXAMPLE:
            texts[i] = min(t, texts[i]) if i in texts and t is not None and texts[i] is not None else texts.get(i, t)
    counts = {i: Counter(words_of(t)) for i, t in texts.items()}
    vocabulary = sorted({w for c in counts.values() for w in c})
    df = Counter(w for _, t in docs for w in set(words_of(t)))
    n = {y: max(1, sum(learnt[i] == y for i in texts)) for y in (0, 1)}
    part = n[1] / (n[0] + n[1])
    weight = {}
    for w in vocabulary:
        a, b = (sum(w in counts[i] for i in texts if learnt[i] == y) for y in (1, 0))
        delta = abs(math.log((a + toxicity.SMOOTHING * part) / n[1]) - math.log((b + toxicity.SMOOTHING * (1 - part)) / n[0]))
        weight[w] = delta * (math.log((1 + len(docs)) / (1 + df[w])) + 1)
    place = {w: k for k, w in enumerate(vocabulary)}

    def vector(c):
        v = np.zeros(len(vocabulary))
        for w, k in c.items():
            if w in place:
                v[place[w]] = (1 + math.log(k)) * weight[w]
        return v / (np.linalg.norm(v) or 1.0)

    ids = sorted(texts)
    matrix, y = np.array([vector(counts[i]) for i in ids]), np.array([learnt[i] for i in ids])
    share = {c: sum(v == c for v in learnt.values()) / n[c] for c in (0, 1)}
    share = {c: s / np.mean([share[v] for v in y]) for c, s in share.items()}
    rate = sum(share[1] for v in y if v) / sum(share[v] for v in y)

    def vote(v, skip=None):
        near = sorted(((c, k) for k, c in enumerate((matrix @ v).tolist()) if c > 0 and k != skip), reverse=True)[: toxicity.K]
        total = sum(c * c * share[y[k]] for c, k in near)
        return sum(c * c * share[y[k]] for c, k in near if y[k]) / total if total else rate

    x = np.array([logit(vote(matrix[k], k)) for k in range(len(ids))])
    w, slope, offset = np.array([share[v] for v in y]), 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-(slope * x + offset)))
        g = np.array([np.sum(w * (p - y) * x) + 1e-3 * (slope - 1), np.sum(w * (p - y)) + 1e-3 * offset])
        h = np.sum(w * p * (1 - p) * np.array([[x * x, x], [x, np.ones(len(x))]]), axis=2) + 1e-3 * np.eye(2)
        slope, offset = np.array([slope, offset]) - np.linalg.solve(h, g)
    return [(i, 1 / (1 + math.exp(-(max(slope, 1e-3) * logit(vote(vector(Counter(words_of(t)))))+ offset)))) for i, t in docs]


def test_toxicity_query_is_brute_force(spark, tmp_path):
    rng = random.Random(11)
    plain, bad = [f"w{k}" for k in range(300)], [f"bad{k}" for k in range(12)]
    docs, labels = [], []
    for i in range(260):
        toxic = rng.random() < 0.3
        text = rng.choices(plain, k=rng.randint(3, 60)) + (rng.choices(bad, k=rng.randint(1, 4)) if toxic or rng.random() < 0.1 else [])
        rng.shuffle(text)
        docs.append((i, " ".join(text).title() if i % 5 == 0 else ", ".join(text)))
        if rng.random() < 0.8:
            labels.append((i, int(toxic)))
    docs += [(None, "bad1 w3 w4"), (400, None), (401, ""), (402, "unknown words alone"), (3, "w1 w2 bad3 é")]
    labels += [(3, 1), (400, 0), (None, 1), (77, None)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").repartition(2).write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.score, r.predicted) for r in queries.op9_toxicity(spark, str(tmp_path)).collect()))
    expected = sorted((i is None, i or 0, s) for i, s in scored(docs, labels))
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert max(abs(g[2] - e[2]) for g, e in zip(got, expected)) < 1e-6
    assert all(g[3] == (g[2] >= 0.7) for g in got)


def test_cut_edges_against_random_and_greedy_places(spark):
    """Pairs of equal texts in different shards. Greedy: the largest groups first, each in the emptiest shard with room, whole."""
    rng = random.Random(4)
    sizes = [rng.choice([2, 2, 3, 5, 9, 20, 45]) for _ in range(120)] + [400]
    rows = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)] + [f"alone {k}" for k in range(900)]
    rng.shuffle(rows)
    out = sharding.shard_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4), 24).collect()
    pairs = lambda counts: sum(n * (n - 1) // 2 for n in counts)
    whole = pairs(sizes)

    def cut(places):
        return whole - pairs(Counter((rows[i], s) for i, s in places if rows[i].startswith("group")).values())

    own, capacity = cut([(r.doc_id, r["shard"]) for r in out]), len(rows) // 24
    at_random = cut([(i, rng.randrange(24)) for i in range(len(rows))])
    room, greedy = [capacity] * 24, 0
    for n in sorted(sizes, reverse=True):
        parts, left = [], n
        while left:
            s = max(range(24), key=lambda k: room[k])
            parts.append(min(left, room[s]) or left)
            room[s] -= parts[-1]
            left -= parts[-1]
        greedy += n * (n - 1) // 2 - pairs(parts)
    assert Counter(Counter(r["shard"] for r in out).values()).keys() <= {len(rows) // 24, len(rows) // 24 + 1}
    assert own < 0.25 * (at_random - greedy) + greedy, (own, at_random, greedy)


@pytest.mark.parametrize("hot", [2, 10_000])
def test_decontamination_beyond_its_bounds(spark, monkeypatch, hot):
    """Fingerprints and context that are shuffled, with one that most documents have, give what broadcasts give."""
    rng = random.Random(6)
    common = " ".join(f"c{k}" for k in range(14))
    rows = [(i, " ".join(rng.choices("abcdefgh", k=30)) + (f" {common} " if i % 4 else " ") + " ".join(rng.choices("abcdefgh", k=20))) for i in range(300)] + [(None, common), (7, None), (8, "")]
    items = [(k, f"item{k} {common} tail{k}") for k in range(20)] + [(90, "a b a"), (91, " ".join(rng.choices("abcdefgh", k=12))), (92, rows[3][1])]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    seen = lambda: sorted((repr(r.doc_id), r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontaminate.contamination(docs, benchmark).collect())
    expected = seen()
    monkeypatch.setattr(decontaminate, "BROADCAST_PRINTS", 0)
    monkeypatch.setattr(decontaminate, "HOT", hot)
    assert seen() == expected and any(len(e[3]) >= 20 for e in expected)
