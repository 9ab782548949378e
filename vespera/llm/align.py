"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids go together in the corpus.

Both tokenizers cut a text's bytes. Each byte gets a label: no token ends there, one of A ends (a), one of B (b), or both
(c). A regular expression scans the string of labels for spans up to each c; the labels of a span say how
many tokens of A and of B its group has. Each token of A in a group is linked with each of B.

An id pair's count is the number of documents that hold it linked. A text's pairs are counted in the task that
tokenizes it, so a row is made for each distinct pair of a document, not for each link; pairs that many documents
have are few, their counts are broadcast and their rows stay where they are (spread_join), the others are shuffled.

A is a byte-level BPE model, whose merges are done from the model file's own ids by tiktoken; texts with very long
runs of white space, on which that library fails, go to the tokenizers library. B is the model of pieces.py, encoded as
there. Both get a space before the text, and special tokens' strings are plain text.

Null and empty texts have no tokens, nor have texts that the tokens' bytes don't give back (a U+2581, which B reads as
a space): their counts are 0 and their digest is empty. Rows are documents, repeated rows too, and null ids are ids like any
other. Input columns that clash with the operator's are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vespera.llm.common import at_work, bounded_batches, durable, spread_join, without
from vespera.llm.pieces import MODEL, encoder_of, load_model

BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
#: Bytes of text that are aligned at once; links that are written out at once, and links of a group whose ids are counted first.
SLICE, LINKS, CROWDED = 1 << 20, 1 << 19, 4096
#: White space in a row that tiktoken is not given.
LONG_BLANK = re.compile(r"\s{500}")
#: An id pair is a whole number: A's id above so many bits, B's id below.
B_BITS = 20

#: Fixed values, which must equal those of the model's family: the bytes that stand for themselves in a byte-level entry, and the pattern
#: that cuts a text before the merges.
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LABELS = np.frombuffer(b"nabc", np.uint8)
SPAN = re.compile(b"[nab]*c")


class ByteModel:
    """A byte-level BPE model of the tokenizers library's format."""

    def __init__(self, data: bytes):
        import tiktoken

        spec = json.loads(data)
        model, cut = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"]:
            raise ValueError("only byte-level BPE models without a normaliser are supported")
        other = [b for b in range(256) if b not in PLAIN_BYTES]
        byte = {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(other)}
        special = {t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in k): i for k, i in model["vocab"].items() if i not in special}
        pair = lambda m: m if isinstance(m, list) else m.split(" ")
        merged = [model["vocab"]["".join(pair(m))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("only models whose ids are in the order of their merges are supported")
        self.data, self.slow = data, None
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        raw = {i: t for t, i in ranks.items()}
        self.raw = pa.array([raw.get(i, b"") for i in range(max(model["vocab"].values()) + 1)], pa.binary())

    def encode(self, text: str) -> np.ndarray:
        ids = self.library(text) if LONG_BLANK.search(text) else self.fast.encode_to_numpy(text, disallowed_special=())
        return np.asarray(ids, np.int64)

    def library(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.data.decode())
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids


_MODELS: dict[bytes, ByteModel] = {}


def byte_model_of(key: bytes, shared) -> ByteModel:
    """The process's model of a broadcast file; only the last one is kept."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = ByteModel(shared.value)
    return _MODELS[key]


def _bytes(ids: np.ndarray, raw: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of tokens one after the other, and where each begins and the last ends."""
    if not len(ids):
        return memoryview(b""), np.zeros(1, np.int64)
    found = raw.take(pa.array(ids)).cast(pa.large_binary())
    offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]
    data = found.buffers()[2]
    return memoryview(data).cast("B")[offsets[0] : offsets[-1]], offsets - offsets[0]


def label_string(end_a: np.ndarray, end_b: np.ndarray, size: int) -> bytes:
    """A label for each of size bytes, from the places behind the tokens' last bytes."""
    at = np.zeros(size, np.uint8)
    at[end_a - 1] |= 1
    at[end_b - 1] |= 2
    return LABELS[at].tobytes()


class _Counts(dict):
    """Of a span: tokens of A above 32 bits, tokens of B below."""

    def __missing__(self, span: bytes) -> int:
        n = (span.count(b"a") + 1 << 32) + span.count(b"b") + 1
        if len(span) <= 16:
            self[span] = n
        return n


def groups_of(labels: bytes) -> np.ndarray:
    """A row for each group: tokens of A, tokens of B. Bytes where nothing ends add to no count and are left out before the scan."""
    spans = SPAN.findall(labels.translate(None, b"n"))
    n = np.fromiter(map(_Counts().__getitem__, spans), np.int64, len(spans))
    return np.stack([n >> 32, n & 0xFFFFFFFF], axis=1)


def _spread(size: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of consecutive ranges."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)


def pair_counts(a: np.ndarray, b: np.ndarray, groups: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links) of the distinct pairs of each document, in order. a, b: ids; doc: each group's document."""
    n_a, n_b = groups[:, 0], groups[:, 1]
    at_a, at_b, links = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
    key = lambda d, x, y: (d << 40) | (x << B_BITS) | y
    few = np.flatnonzero(links <= CROWDED)
    keys, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    block = np.cumsum(links[few]) // LINKS
    for part in np.split(few, np.flatnonzero(np.diff(block)) + 1):
        g, i = np.repeat(part, links[part]), _spread(links[part])
        found, n = np.unique(key(doc[g], a[at_a[g] + i // n_b[g]], b[at_b[g] + i % n_b[g]]), return_counts=True)
        keys.append(found)
        times.append(n)
    for g in np.flatnonzero(links > CROWDED).tolist():
        x, n = np.unique(a[at_a[g] : at_a[g] + n_a[g]], return_counts=True)
        y, m = np.unique(b[at_b[g] : at_b[g] + n_b[g]], return_counts=True)
        for i in range(0, len(x), max(1, LINKS // len(y))):
            some = slice(i, i + max(1, LINKS // len(y)))
            keys.append(key(doc[g], x[some, None], y[None]).ravel())
            times.append((n[some, None] * m[None]).ravel())
    keys, times = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    keys, times = keys[first], np.add.reduceat(times, first) if len(first) else times
    return keys >> 40, keys & ((1 << 40) - 1), times


class Aligner:
    def __init__(self, first: ByteModel, second):
        """second: an encoder of pieces.py."""
        self.a, self.b = first, second
        self.raw_b = second.model.raw_bytes
        text = lambda n, ends: [b"%d%s" % (i, e) for i in range(n) for e in ends]
        self.spelled = pa.array([*text(len(self.a.raw), (b",", b"|")), *text(len(self.raw_b), (b",", b";"))], pa.binary())

    def slices(self, texts: list[str | None]) -> Iterator[list[str]]:
        held, size = [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size >= SLICE:
                yield held
                held, size = [], 0
        if held:
            yield held

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and of B of each text; none of a null or empty text and where either's bytes are not the text's."""
        lists = self.b.encoded(pa.array(texts, pa.string()))
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        data, ends = _bytes(flat[at[0] : at[-1]], self.raw_b)
        none, out_a, out_b, wholes = flat[:0].astype(np.int64), [], [], []
        for k, t in enumerate(texts):
            whole = (" " + t).encode()
            same = t and data[ends[at[k] - at[0]] : ends[at[k + 1] - at[0]]] == whole
            out_a.append(self.a.encode(" " + t) if same else none)
            out_b.append(flat[at[k] : at[k + 1]] if same else none)
            wholes.append(whole if same else b"")
        if _bytes(np.concatenate(out_a), self.a.raw)[0] != b"".join(wholes):
            for k, whole in enumerate(wholes):
                if _bytes(out_a[k], self.a.raw)[0] != whole:
                    out_a[k] = out_b[k] = none
        return out_a, out_b

    def aligned(self, texts: list[str]) -> Iterator[dict]:
        """For each text its counts, digest and distinct pairs."""
        list_a, list_b = self.tokens(texts)
        sizes_a, sizes_b = np.array([len(x) for x in list_a]), np.array([len(x) for x in list_b])
        a, b = np.concatenate(list_a), np.concatenate(list_b).astype(np.int64)
        (_, ends_a), (_, ends_b) = _bytes(a, self.a.raw), _bytes(b, self.raw_b)
        groups = groups_of(label_string(ends_a[1:], ends_b[1:], int(ends_a[-1])))
        upto_a, upto_b = np.cumsum(groups[:, 0]), np.cumsum(groups[:, 1])
        doc = np.searchsorted(np.cumsum(sizes_a), upto_a - 1, side="right")  # of each group
        n_groups = np.bincount(doc, minlength=len(texts))
        n_links = np.zeros(len(texts), np.int64)
        np.add.at(n_links, doc, groups[:, 0] * groups[:, 1])
        # Tokens in the order of the groups, A's before B's, each spelled with what follows it.
        spelled = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[upto_a - 1], last_b[upto_b - 1] = 1, 1
        spelled[np.arange(len(a)) + np.repeat(upto_b - groups[:, 1], groups[:, 0])] = 2 * a + last_a
        spelled[np.arange(len(b)) + np.repeat(upto_a, groups[:, 1])] = 2 * (len(self.a.raw) + b) + last_b
        data, ends = _bytes(spelled, self.spelled)
        upto = np.cumsum(sizes_a + sizes_b)
        of, pair, times = pair_counts(a, b, groups, doc)
        cut = np.searchsorted(of, np.arange(len(texts) + 1))
        for k in range(len(texts)):
            low, high = ends[upto[k] - sizes_a[k] - sizes_b[k]], ends[upto[k]]
            digest = sha256(data[low : high - 1]).hexdigest() if high > low else ""
            yield {"n_a": sizes_a[k], "n_b": sizes_b[k], "n_groups": n_groups[k], "n_links": n_links[k], "groups_sha256": digest, "pair": pair[cut[k] : cut[k + 1]], "times": times[cut[k] : cut[k + 1]]}


KIND = "struct<n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string,links:array<struct<pair:long,times:long>>>"


def _table(rows: list[dict]) -> pa.Array:
    offsets = pa.array(np.cumsum([0, *[len(r["pair"]) for r in rows]]), pa.int32())
    join = lambda name: pa.array(np.concatenate([np.empty(0, np.int64), *[r[name] for r in rows]]), pa.int64())
    links = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([join("pair"), join("times")], names=["pair", "times"]))
    counts = [pa.array([int(r[n]) for r in rows], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    return pa.StructArray.from_arrays([*counts, pa.array([r["groups_sha256"] for r in rows], pa.string()), links], names=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])


def align_tokens(docs: DataFrame, text: str = "text", byte_model: str = BYTE_MODEL, piece_model: str = MODEL) -> DataFrame:
    """row, own (a struct of docs' columns but the text), n_a, n_b, n_groups, n_links, groups_sha256 and links (distinct pairs and how often each is linked), stored."""
    docs, spark = at_work(docs), docs.sparkSession
    bounded_batches(spark)
    first, second = load_model(byte_model), load_model(piece_model)
    shared = spark.sparkContext.broadcast(first), spark.sparkContext.broadcast(second)  # vocabulary files, which no input makes larger
    keys = sha256(first).digest(), sha256(second).digest()

    held: dict[str, Aligner] = {}

    @F.arrow_udf(KIND)
    def aligned(texts: pa.Array) -> pa.Array:
        if not held:
            held["a"] = Aligner(byte_model_of(keys[0], shared[0]), encoder_of(keys[1], shared[1]))
        return _table([row for part in held["a"].slices(texts.to_pylist()) for row in held["a"].aligned(part)])

    own = F.struct(*[c for c in docs.columns if c != text])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), own.alias("own"), aligned(F.col(text)).alias("x"))
    return durable(rows.select("row", "own", "x.*"), "aligned")


def linked_ids(aligned: DataFrame) -> DataFrame:
    """pair, a, b, docs (how many documents hold it linked) and best (whether docs is the highest of a), stored."""
    pairs = aligned.select(F.inline("links")).groupBy("pair").agg(F.count("*").alias("docs"))
    pairs = durable(pairs.select("pair", F.shiftright("pair", B_BITS).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)).alias("b"), "docs"), "pairs")
    most = pairs.groupBy("a").agg(F.max("docs").alias("most"))  # A's vocabulary at most
    return pairs.join(F.broadcast(most), "a").select("pair", "a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, text: str = "text", byte_model: str = BYTE_MODEL, piece_model: str = MODEL) -> DataFrame:
    """docs without text, with COLUMNS."""
    rows = align_tokens(without(docs, COLUMNS), text, byte_model, piece_model)
    facts = linked_ids(rows).select("pair", "docs", "best", F.col("docs").alias("n"))
    total = rows.agg(F.sum(F.size("links"))).first()[0] or 0
    links = spread_join(rows.select("row", F.inline("links")), facts, ["pair"], total)
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("links").join(sums, "row", "left").select("own.*", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
