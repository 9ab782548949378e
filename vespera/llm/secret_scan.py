"""Secrets in text: rules give base findings, a character convolutional network in numpy judges every candidate.

Candidates are the base findings, values behind = or : of VALUE_CHARS characters or more, and other strings of BARE_CHARS or
more with a digit and a letter. The network reads the characters of a candidate, all of them, with BEFORE in front and AFTER
behind: an embedding, one convolution, and pooling (the greatest and the mean of each filter) over each of the three zones. So a
candidate's length changes neither the network nor what of it is read. A candidate that overlaps no base finding
is a secret from its kind's threshold on; base findings stay whatever their score, which is given too.

The network is trained here, on all different labelled findings of the corpus and on GENERATED of each label made by a fixed
rule from formats of keys and of harmless strings. A corpus finding's
label is that of its kind's rule: an assigned value of mixed letters and digits with LEAST_BITS of entropy a character, or an
access key, is a secret; digits alone, letters alone, a file or host name, few different characters are none; all else, and what is longer
than LABELLED characters, is not labelled. Findings are dealt by their hash into parts of about PART; each task trains the network for an epoch on a
part and the generated ones, and the mean of the parts' networks begins the next epoch. A single part is trained through.

One finding in HELD, by its hash, is kept from training: the outputs of all these, in steps of 1 / LEVELS, are counted by Spark. On the counts a
logistic curve maps the network's output to the chance of a
secret, and each kind's threshold is set so that RECALL of its secrets there pass, and as much higher as costs none of these and halves
the distance to the next harmless one.

Null texts are read as empty. Offsets count code points, ends are exclusive. Rows are scored independently, so repeated rows get equal
results; an empty table trains on the generated findings alone and has no rows. Input columns that clash with the operator's are replaced.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vespera.llm.common import at_work, bounded_batches, durable, without

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "value", "bare")
#: Patterns of base findings, and the least length of a group of theirs.
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),  # shorter runs fail and take nothing from others
}
VALUE_CHARS, BARE_CHARS = 12, 16
VALUE = re.compile(rf"""[:=]["'\x20]{{0,3}}(?<![A-Za-z0-9+/_.-])([A-Za-z0-9+/_.-]{{{VALUE_CHARS},}}={{0,2}})""")
BARE = re.compile(rf"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{{{BARE_CHARS},}}={{0,2}}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
COLUMNS = ("secrets",)

BEFORE, AFTER = 32, 16
#: Characters told apart (ASCII, one for all others, one for the room between strings), width of the embedding, characters under a filter, filters.
CODES, WIDTH, REACH, FILTERS = 130, 8, 5, 24
OTHER, ROOM = 128, 129
#: Generated findings of each label; part held out; what share of held-out secrets must pass; seed.
GENERATED, HELD, RECALL, SEED = 2500, 3, 0.98, 13
#: Longest candidate that the rules label; corpus findings that a task trains on; steps of an output of 1, and the greatest output told apart.
LABELLED, PART, LEVELS, GREATEST = 256, 5000, 1024, 60
LEAST_BITS = 3.0
EPOCHS, BATCH, RATE = 10, 100, 3e-3
#: Characters that are convolved at once.
BLOCK = 1 << 15

Finding = tuple[str, int, int]  # kind, start, end
Window = tuple[str, str, str]  # text before, the candidate, text behind


def base_findings(text: str) -> list[Finding]:
    """By start, then kind as listed."""
    found = [(kind, m.start(), m.end()) for kind, (pattern, group, least) in PATTERNS.items() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def other_candidates(text: str, base: list[Finding]) -> list[Finding]:
    """Values and bare strings that overlap no base finding, by start; a string that is both is a value."""
    found = {m.span(1): "value" for m in VALUE.finditer(text)}
    for m in BARE.finditer(text):
        if DIGIT.search(m[0]) and LETTER.search(m[0]):
            found.setdefault(m.span(), "bare")
    out, taken = [], sorted((a, b) for _, a, b in base)
    at = 0
    end = 0  # of the base findings that begin before a candidate's end
    for (a, b), kind in sorted(found.items()):
        while at < len(taken) and taken[at][0] < b:
            end, at = max(end, taken[at][1]), at + 1
        if end <= a:
            out.append((kind, a, b))
    return out


def window(text: str, finding: Finding) -> Window:
    _, a, b = finding
    return text[max(0, a - BEFORE) : a], text[a:b], text[b : b + AFTER]


# Labels


def entropy(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def rule_label(kind: str, candidate: str) -> int | None:
    """1, 0, or None where the rules can't tell."""
    if len(candidate) > LABELLED:
        return None
    value = PATTERNS["assign"][0].fullmatch(candidate)[2] if kind == "assign" else candidate
    mixed, bits = bool(DIGIT.search(value) and LETTER.search(value)), entropy(value)
    if kind == "access" or kind == "assign" and mixed and bits >= LEAST_BITS:
        return 1
    if not mixed or bits < 2 or re.fullmatch(r"(?:[A-Za-z]+[0-9]{0,4}[._/-])+[A-Za-z]+[0-9]{0,4}", value):
        return 0
    return None


def generated(n: int, seed: int = SEED) -> list[tuple[int, Window]]:
    """n secrets and n harmless strings in their surroundings, by rule."""
    rng = random.Random(seed)
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda letters, least, most: "".join(rng.choices(letters, k=rng.randint(least, most)))
    first, last = [*"bcdfghjklmnpqrstvwxyz", "br", "cl", "gr", "qu", "st", "th", "tr", ""], ["", "", "", *"bcdglmnprstxy", "ck", "ld", "ng", "rt", "st"]
    syllable = lambda: rng.choice(first) + rng.choice(["a", "e", "i", "o", "u", "y", "ie", "ou"]) + rng.choice(last)
    word = lambda least=1: "".join(syllable() for _ in range(rng.randint(least, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    keys = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "client_secret", "auth", "bearer", "private_key", "credential", "passphrase", "signing_key"]
    names = ["title", "path", "file", "name", "version", "class", "module", "url", "id", "color", "lang", "author", "route", "label", "ref"]

    def secret() -> str:
        return rng.choice([
            lambda: some("0123456789abcdef", 24, 64), lambda: some(low + up + digits, 16, 44), lambda: some(low + up + digits + "+/", 24, 64) + rng.choice(["", "=", "=="]),
            lambda: rng.choice(["ghp_", "gho_", "sk_live_", "sk-", "xoxb-", "glpat-", "npm_", "AIza"]) + some(low + up + digits, 24, 40), lambda: "eyJ" + ".".join(some(low + up + digits + "_-", 20, 40) for _ in range(3)),
            lambda: some(up + digits, 20, 32), lambda: some(low + digits, 20, 40), lambda: "-".join(some(low + digits, 5, 8) for _ in range(4)),
        ])()

    def harmless() -> str:
        return rng.choice([
            lambda: "_".join(word() for _ in range(rng.randint(3, 5))) + some(digits, 0, 2), lambda: "".join(word().title() for _ in range(rng.randint(3, 5))) + some(digits, 0, 2), lambda: "/".join([word(), word(), word() + rng.choice([".py", ".html", ".png", ".v2", "3"])]),
            lambda: ".".join(word(2) for _ in range(3)) + some(digits, 0, 2), lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}.00", lambda: word() + rng.choice("-=_.") * rng.randint(10, 30) + some(digits, 0, 1),
            lambda: "-".join(word() for _ in range(4)) + "-" + some(digits, 1, 4), lambda: some(digits, 12, 20), lambda: "your_" + rng.choice(keys) + "_here" + some(digits, 0, 1), lambda: f"{word()}.{word()}-{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
            lambda: word() + some(digits, 1, 3) + word(3), lambda: "x" * rng.randint(8, 20) + some(digits, 1, 2) + "x" * 4, lambda: "".join(word() for _ in range(4)),
        ])()

    def surrounded(value: str, key: str, bare: float) -> Window:
        front, behind = prose(4) + " ", " " + prose(3)
        if rng.random() < bare:
            return (front + rng.choice(["", "", "(", "`", "\n", key + " "]))[-BEFORE:], value, (rng.choice(["", ",", ".", ")", "`", "\n"]) + behind)[:AFTER]
        quote = rng.choice(["", '"', "'"])
        key = rng.choice([key, key.upper(), key.title(), word() + "_" + key])
        return (front + key + rng.choice(["=", " = ", ": ", '": ', ":"]) + quote)[-BEFORE:], value, (quote + behind)[:AFTER]

    out = []
    for _ in range(n):
        out.append((1, surrounded(secret(), rng.choice(keys + keys + names), 0.35)))
        out.append((0, surrounded(harmless(), rng.choice(keys + names + names), 0.5)))
    return out


def finding_hash(w: Window) -> str:
    return hashlib.sha256("\x00".join(w).encode("utf-8", "replace")).hexdigest()


def corpus_findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """label, hash, front, value, behind: all different labelled findings of all rows, stored."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], Window] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                base = base_findings(t or "")
                for f in base + other_candidates(t or "", base):
                    if (y := rule_label(f[0], t[f[1] : f[2]])) is not None:
                        w = window(t, f)
                        held[y, finding_hash(w)] = w
                        if len(held) >= 2 * PART:
                            yield sent(held)
                            held = {}
        yield sent(held)

    def sent(held: dict[tuple[int, str], Window]) -> pa.RecordBatch:
        rows = [(*k, *w) for k, w in held.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if not i else pa.string()) for i in range(5)], names=["label", "hash", "front", "value", "behind"])

    return durable(docs.select(text).mapInArrow(found, "label int, hash string, front string, value string, behind string").dropDuplicates(["label", "hash"]), "findings")


def _digits(first: int) -> Column:
    """Eight digits of the hash from the first on, as a number."""
    return F.conv(F.substring("hash", first, 8), 16, 10).cast("long")


def is_held(w: Window) -> bool:
    return int(finding_hash(w)[:8], 16) % HELD == 0


# The network


class Network:
    """embedding of characters, filters over REACH of them, greatest and mean of each filter in three zones, one output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / math.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {"embed": rng.normal(0, 0.5, (CODES, WIDTH)).astype(np.float32), "conv": draw(REACH * WIDTH, FILTERS), "bias": np.zeros(FILTERS, np.float32), "out": draw(6 * FILTERS, 1)[:, 0], "offset": np.zeros(1, np.float32)}
        self.p["embed"][ROOM] = 0

    @staticmethod
    def coded(windows: list[Window]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all characters, each window's zones one after the other with a ROOM before each and two behind the last, and the zones' lengths."""
        room = chr(ROOM)
        plain = lambda s: s if s.isascii() else "".join(c if c < "\x80" else chr(OTHER) for c in s)
        zones = [room + plain(z) for w in windows for z in w]
        return np.frombuffer("".join(zones).encode("latin-1"), np.uint8), np.array([len(z) for z in zones])

    def convolved(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the filters read at each character, REACH of them around it, and what they answer."""
        half = REACH // 2
        x = self.p["embed"][np.pad(codes, half, constant_values=ROOM)]
        read = np.concatenate([x[i : i + len(codes)] for i in range(REACH)], axis=1)
        return read, np.maximum(read @ self.p["conv"] + self.p["bias"], 0)

    def pooled(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Greatest and mean of each filter in each zone, a row for each window; characters are convolved BLOCK at a time."""
        starts = np.cumsum(sizes) - sizes
        most, total = np.zeros((len(sizes), FILTERS), np.float32), np.zeros((len(sizes), FILTERS), np.float32)
        half = REACH // 2
        for a in range(0, len(codes), BLOCK):
            b = min(a + BLOCK, len(codes))
            low, high = max(0, a - half), min(len(codes), b + half)
            answer = self.convolved(codes[low:high])[1][a - low : b - low]
            zones = np.arange(np.searchsorted(starts, a, side="right") - 1, np.searchsorted(starts, b))
            at = np.maximum(starts[zones] - a, 0)
            most[zones] = np.maximum(most[zones], np.maximum.reduceat(answer, at))
            total[zones] += np.add.reduceat(answer, at)
        return np.concatenate([most, total / sizes[:, None]], axis=1).reshape(len(sizes) // 3, -1)

    def outputs(self, windows: list[Window]) -> np.ndarray:
        if not windows:
            return np.empty(0, np.float32)
        return self.pooled(*self.coded(windows)) @ self.p["out"] + self.p["offset"][0]

    def gradients(self, windows: list[Window], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy."""
        codes, sizes = self.coded(windows)
        read, answer = self.convolved(codes)
        starts = np.cumsum(sizes) - sizes
        most, mean = np.maximum.reduceat(answer, starts), np.add.reduceat(answer, starts) / sizes[:, None]
        pooled = np.concatenate([most, mean], axis=1).reshape(len(windows), -1)
        slope = (1 / (1 + np.exp(-np.clip(pooled @ self.p["out"] + self.p["offset"][0], -30, 30))) - labels) / len(windows)
        into = (slope[:, None] * self.p["out"][None]).reshape(len(sizes), 2 * FILTERS)
        back = np.repeat(into[:, FILTERS:] / sizes[:, None], sizes, axis=0) + np.repeat(into[:, :FILTERS], sizes, axis=0) * (answer == np.repeat(most, sizes, axis=0))
        back *= answer > 0
        at, half, embed = back @ self.p["conv"].T, REACH // 2, np.zeros_like(self.p["embed"])
        around = np.pad(codes, half, constant_values=ROOM)
        for i in range(REACH):
            seen, part = around[i : i + len(codes)], at[:, i * WIDTH : (i + 1) * WIDTH]
            for j in range(WIDTH):
                embed[:, j] += np.bincount(seen, part[:, j], CODES)
        embed[ROOM] = 0
        return {"embed": embed, "conv": read.T @ back, "bias": back.sum(0), "out": pooled.T @ slope, "offset": slope.sum(keepdims=True)}

    def train(self, findings: list[tuple[int, Window]], epochs: int = EPOCHS, seed: int = SEED, state: np.ndarray | None = None) -> np.ndarray:
        """Adam over batches in a fixed random order, from a state (steps, parameters, both moments) on if one is given; returns the state reached."""
        rng, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        if state is not None:
            step, at = round(state[0]), 1
            for held in (self.p, first, second):
                for k, v in held.items():
                    held[k], at = state[at : at + v.size].reshape(v.shape).astype(v.dtype if held is self.p else np.float64), at + v.size
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(findings)), max(1, len(findings) // BATCH)):
                step += 1
                got = self.gradients([findings[i][1] for i in part], np.array([findings[i][0] for i in part], np.float32))
                for k, g in got.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= (RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return np.concatenate([[step], *[v.ravel() for held in (self.p, first, second) for v in held.values()]]).astype(np.float64)


class Scanner:
    """The fitted model: network, curve, thresholds by kind, and on how many held-out findings of each kind these rest.

    counts: (kind, label, level) of held-out findings and how many have it; a level is an output in steps of 1 / LEVELS.
    """

    def __init__(self, network: Network, counts: Counter, recall: float = RECALL):
        self.network = network
        keys = sorted(counts, key=lambda k: k[2])
        kinds, labels, levels, n = (np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.array([k[2] for k in keys], float), np.array([counts[k] for k in keys], int))
        self.slope, self.offset = _curve(levels / LEVELS, labels.astype(float), n)
        scores, self.thresholds, self.held_out = self.chance(levels / LEVELS), {}, {}
        for kind in ("value", "bare"):
            good, bad = (kinds == kind) & (labels == 1), (kinds == kind) & (labels == 0)
            secrets, harmless = int(n[good].sum()), int(n[bad].sum())
            at = float(scores[good][np.searchsorted(np.cumsum(n[good]), int((1 - recall) * secrets), side="right")]) if secrets else 0.5
            below = scores[bad][scores[bad] < at]
            passes = self.thresholds[kind] = (at + float(below.max())) / 2 if len(below) else at
            self.held_out[kind] = {"secrets": secrets, "harmless": harmless, "recall": float(n[good][scores[good] >= passes].sum() / secrets) if secrets else None, "passed": int(n[bad][scores[bad] >= passes].sum())}

    def chance(self, outputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * leveled(outputs) / LEVELS + self.offset, -30, 30)))

    def scan(self, text: str, judged: bool = True) -> list[tuple[str, int, int, float]]:
        """(kind, start, end, chance of a secret) of base findings and of the others that pass, by start, then kind as listed."""
        base = base_findings(text)
        found = base + other_candidates(text, base)
        scores = self.chance(self.network.outputs([window(text, f) for f in found])).tolist()
        out = [(*f, s) for f, s in zip(found, scores) if s >= self.thresholds.get(f[0], 0.0)]
        return sorted(out, key=lambda f: (f[1], KINDS.index(f[0])))


def kind_of(w: Window) -> str:
    return "value" if re.search(r"""[:=]["'\x20]{0,3}$""", w[0]) else "bare"


def leveled(outputs: np.ndarray) -> np.ndarray:
    return np.round(np.clip(np.asarray(outputs, float), -GREATEST, GREATEST) * LEVELS)


def _curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of labels over outputs, each counted n times: Newton's method, drawn a little towards the network's own."""
    design, curve = np.c_[x, np.ones(len(x))], np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ curve, -30, 30)))
        slope = design.T @ (n * (p - y)) + 0.1 * (curve - [1.0, 0.0])
        curve = curve - np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), slope)
    return float(max(curve[0], 1e-3)), float(curve[1])


def trained(found: DataFrame, made: list[tuple[int, Window]], seed: int = SEED) -> Network:
    """The network after EPOCHS over the findings (label, hash, front, value, behind) and the generated ones that are not held out."""
    spark, kept = found.sparkSession, found.filter(_digits(1) % HELD != 0)
    parts = max(1, -(-kept.count() // PART))
    rounds = EPOCHS if parts > 1 else 1
    # A part without findings trains on the generated ones all the same.
    rows = kept.withColumn("part", _digits(9) % parts).unionByName(spark.range(parts).select(F.col("id").alias("part")), allowMissingColumns=True)
    shared = spark.sparkContext.broadcast([f for f in made if not is_held(f[1])])
    state, network = None, Network(seed)
    for i in range(rounds):

        def epoch(part: pa.Table) -> pa.Table:
            findings = sorted((r for r in part.to_pylist() if r["hash"]), key=lambda r: (r["label"], r["hash"]))
            findings = [(r["label"], (r["front"], r["value"], r["behind"])) for r in findings] + shared.value
            reached = Network(seed).train(findings, EPOCHS // rounds, seed + i, state)
            return pa.table({"part": part["part"][:1], "n": pa.array([len(findings)], pa.int64()), "state": pa.array([reached.tobytes()], pa.binary())})

        reached = sorted(tuple(r) for r in rows.repartition(parts, "part").groupBy("part").applyInArrow(epoch, "part long, n long, state binary").collect())  # a network of fixed size from each part
        states = np.array([np.frombuffer(r[2]) for r in reached])
        state = np.average(states, axis=0, weights=[r[1] for r in reached]) if parts > 1 else states[0]
    network.train([], 0, state=state)
    return network


def held_counts(found: DataFrame, made: list[tuple[int, Window]], network: Network) -> Counter:
    """How many held-out findings have each (kind, label, level): no more rows than levels, whatever the corpus."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, *zones = (c.to_pylist() for c in batch.columns)
            windows = list(zip(*zones))
            yield pa.RecordBatch.from_arrays([pa.array([kind_of(w) for w in windows], pa.string()), pa.array(label, pa.int32()), pa.array(leveled(network.outputs(windows)).astype(np.int64))], names=["kind", "label", "level"])

    levels = found.filter(_digits(1) % HELD == 0).select("label", "front", "value", "behind").mapInArrow(judged, "kind string, label int, level long").groupBy("kind", "label", "level").count()
    counts = Counter({(r["kind"], r["label"], r["level"]): r["count"] for r in levels.collect()})
    own = [f for f in made if is_held(f[1])]
    counts.update((kind_of(w), y, int(v)) for (y, w), v in zip(own, leveled(network.outputs([w for _, w in own]))))
    return counts


def fit(docs: DataFrame, text: str = "text", made: int = GENERATED, recall: float = RECALL, seed: int = SEED) -> Scanner:
    """The scanner of all the corpus' and the generated findings."""
    bounded_batches(docs.sparkSession)
    found, own = corpus_findings(docs, text), generated(made, seed)
    network = trained(found, own, seed)
    return Scanner(network, held_counts(found, own, network), recall)


def scan_secrets(docs: DataFrame, text: str = "text", scanner: Scanner | None = None, **bounds) -> DataFrame:
    """docs with secrets: array of struct(kind, start, end, score) by start, then kind as listed."""
    docs = at_work(docs)
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scanner or fit(docs, text, **bounds))  # a network of fixed size

    @F.arrow_udf("array<struct<kind:string,start:long,end:long,score:double>>")
    def scanned(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        return pa.array([[dict(zip(("kind", "start", "end", "score"), f)) for f in shared.value.scan(t or "")] for t in texts.to_pylist()], kind)

    docs = without(docs, COLUMNS)
    return docs.select(*docs.columns, scanned(F.col(text)).alias("secrets"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
