"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

A segmentation is a best path through the lattice of a text's pieces. A document of more than CHUNK code
points is cut at every multiple of CHUNK, mostly inside a word. Each chunk, on its own, yields a transfer
matrix over max and plus from the states at its left boundary to those at its right one, a state being the
piece that crosses or touches the boundary. The matrices are combined associatively, FAN at a time, up a
tree; down the tree the states at every boundary follow, and then each chunk is backtraced by itself.

Weights are such that the path is the library's own segmentation. Unigram models add piece scores. BPE
models are merges, not scores; but a sequence of pieces is what the merges make of a text exactly if
every two neighbours are what they make of those two pieces' text, so an edge weighs 0 if its two pieces
stand that test and has no weight (minus infinity) otherwise, and one path is left.

No piece goes on across a space that follows another character (the model is checked for that). Inside a
chunk the lattice therefore narrows to one state at each such place: the matrix is the sweep from the left
boundary to the first of them, plus the weight of the words in between, plus the sweep from the last of
them to the right boundary. Words in between are segmented by the merges, those of a batch of chunks side by
side (long ones and those of unigram models by a sweep), and remembered. A chunk without such a place is swept
whole. The library encodes documents of CHUNK code points or fewer, and those alone.

Null texts have null ids, empty texts none. Encoding is that of the model's options (dummy prefix, byte
fallback); decoding gives the text back if the model's normalisation is the identity, except that a
U+2581 is read as a space. Rows are independent; repeated rows get equal ids. Input columns that clash
with the operator's are replaced. Rows of giant documents are known by a number given to each row.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from vespera.llm.common import bounded_batches, durable, unused, without

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents over CHUNK code points are cut into chunks of that size; FAN matrices are combined at a time.
CHUNK, FAN = 16_384, 64
#: Words that an encoder remembers, and the longest remembered; words up to SHORT are segmented by the merges alone.
CACHE, REMEMBERED, SHORT = 200_000, 256, 48
#: Chunks that a task of the scan takes and whose words it holds at once, and up to how many chunks their states, 20 bytes each, are broadcast.
CHUNKS_A_TASK, BROADCAST_CHUNKS = 64, 500_000
BPE, UNIGRAM = 2, 1
SPACE = "▁"
COLUMNS = ("ids", "n_ids")

_NARROW = re.compile(f"(?<=[^{SPACE}]){SPACE}")

State = tuple[int, int, str]  # code points past the boundary, id (-1: unknown), text of the piece
START: State = (0, -2, "")


class PieceModel:
    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        self.kind = spec.trainer_spec.model_type
        norm = spec.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalisation are supported")
        self.dummy = norm.add_dummy_prefix
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [p.piece for p in spec.pieces]
        self.types = [p.type for p in spec.pieces]
        self.scores = {p.piece: (p.score, i) for i, p in enumerate(spec.pieces) if p.type == 1 or p.type == 4}
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError("pieces that hold a space inside are not supported")
        self.longest = max(map(len, self.scores))
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == 6}
        self.unknown = next(i for i, t in enumerate(self.types) if t == 2)
        self.worst = min(s for s, _ in self.scores.values()) - 10.0  # the library's penalty of an unknown character
        self.raw = [bytes([int(p[3:5], 16)]) if t == 6 else b"" if t == 3 else p.replace(SPACE, " ").encode() for p, t in zip(self.pieces, self.types)]
        self.raw[self.unknown] = " ⁇ ".encode()
        self.raw_bytes = pa.array(self.raw, pa.binary())
        self.fits = lru_cache(1 << 16)(self._fits)
        self._stable: dict[str, bool] = {}
        self.weighed: dict[str, tuple[float, bytes]] = {}
        self.words = Words(self.segmented)
        #: whether a piece begins with the space
        self.heads = np.array([p.startswith(SPACE) for p in self.pieces])

    # The lattice

    def starting(self, text: str, at: int) -> list[tuple[str, int, float]]:
        """Pieces of text that start at a place: text, id, score. A character that is no piece is an unknown one."""
        found = [(s, x[1], x[0]) for n in range(1, min(self.longest, len(text) - at) + 1) if (x := self.scores.get(s := text[at : at + n]))]
        return found if text[at] in self.scores else [(text[at], -1, self.worst), *found]

    def merged(self, text: str) -> list[str]:
        """What BPE makes of a short text: the best-scored neighbours merge first, of equals the leftmost."""
        parts = list(text)
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                x = self.scores.get(parts[i] + parts[i + 1])
                if x and (best is None or x[0] > best):
                    best, where = x[0], i
            if where < 0:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def _fits(self, left: str, right: str) -> bool:
        return self.merged(left + right) == [left, right]

    def weight(self, left: State, piece: str, score: float) -> float | None:
        if self.kind != BPE:
            return score
        return 0.0 if (self.stable(piece) if left == START else self.fits(left[2], piece)) else None

    def stable(self, s: str) -> bool:
        """Whether a piece can stand in a segmentation at all: BPE makes it of its own text."""
        if self.kind != BPE:
            return True
        if s not in self._stable:
            self._stable[s] = self.merged(s) == [s]
        return self._stable[s]

    def states(self, text: str, at: int) -> list[State]:
        """The states a boundary at a place in text can have: pieces that start before it and end there or later."""
        if at == 0:
            return [START]
        return [(b + len(s) - at, i, s) for b in range(max(0, at - self.longest), at) for s, i, _ in self.starting(text, b) if b + len(s) >= at and self.stable(s)]

    def sweep(self, text: str, begin: int, end: int, entries: list[State]) -> dict[int, dict[State, tuple[dict[int, float], dict[int, tuple[int, State]]]]]:
        """Nodes by place: last piece -> best weight by entry, and the node before. Paths stop at the first piece that reaches end."""
        nodes: dict[int, dict] = defaultdict(dict)
        for e, state in enumerate(entries):
            weights, back = nodes[begin + state[0]].setdefault((0, *state[1:]), ({}, {}))
            weights[e] = 0.0
        for at in range(begin, end):
            for left, (weights, _) in list(nodes.get(at, {}).items()):
                for s, i, score in self.starting(text, at):
                    w = self.weight(START if left[1] == -2 else left, s, score)
                    if w is None:
                        continue
                    to, back = nodes[at + len(s)].setdefault((0, i, s), ({}, {}))
                    for e, x in weights.items():
                        if x + w > to.get(e, -np.inf):
                            to[e], back[e] = x + w, (at, left)
        return nodes

    def narrow(self, text: str, begin: int, end: int) -> tuple[int, int] | None:
        """The first and the last place from begin on and before end that no piece crosses."""
        first = _NARROW.search(text, max(begin, 1), end)
        if not first:
            return None
        last = text.rfind(SPACE, first.start(), end)
        while text[last - 1] == SPACE and last > first.start():
            last = text.rfind(SPACE, first.start(), last)
        return first.start(), last

    def inside(self, text: str, begin: int, end: int) -> tuple[float, list[bytes]]:
        """Weight and ids of the words between two places that no piece crosses."""
        total, parts, at = 0.0, [], begin
        while at < end:
            m = _NARROW.search(text, at + 1, end)
            stop = m.start() if m else end
            weight, ids = self.word(text[at:stop])
            total += weight
            parts.append(ids)
            at = stop
        return total, parts

    def word(self, s: str) -> tuple[float, bytes]:
        """Weight and ids of a text between two places that no piece crosses, by a sweep; remembered."""
        if (known := self.weighed.get(s)) is not None:
            return known
        ends = self.sweep(s, 0, len(s), [START])[len(s)]
        node = max(ends, key=lambda k: ends[k][0][0])
        found = ends[node][0][0], array("i", self.backtrace(s, 0, len(s), START, node)).tobytes()
        if len(s) <= REMEMBERED:
            if len(self.weighed) >= CACHE:
                self.weighed.clear()
            self.weighed[s] = found
        return found

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Two symbols in one number, ascending, and the piece that they merge into. A symbol is a piece's id, or len(pieces) more than a code point that is no piece."""
        n, found = len(self.pieces), {}
        symbol = lambda s: x[1] if (x := self.scores.get(s)) else n + ord(s) if len(s) == 1 else None
        for s, (_, i) in self.scores.items():
            for k in range(1, len(s)):
                if (left := symbol(s[:k])) is not None and (right := symbol(s[k:])) is not None:
                    found[left << 32 | right] = i
        keys = np.array(sorted(found), np.int64)
        return keys, np.array([found[k] for k in keys.tolist()] + [-1], np.int32)

    @cached_property
    def characters(self) -> np.ndarray:
        """The symbol of each code point."""
        symbols = np.arange(len(self.pieces), len(self.pieces) + 0x110000, dtype=np.int32)
        for s, (_, i) in self.scores.items():
            if len(s) == 1:
                symbols[ord(s)] = i
        return symbols

    @cached_property
    def merits(self) -> np.ndarray:
        """Score by piece; the last is that of no merge."""
        merits = np.full(len(self.pieces) + 1, -np.inf)
        for score, i in self.scores.values():
            merits[i] = score
        return merits

    def joint(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols merge into, or -1."""
        keys, made = self.pairs
        pair = left << 32 | right
        at = np.searchsorted(keys, pair)
        return np.where(keys[np.minimum(at, len(keys) - 1)] == pair, made[at], -1) if len(keys) else np.full(pair.shape, -1)

    def segmented(self, words: list[str]) -> list[bytes]:
        """Ids of words, each behind one space, by the merges; those of SHORT code points or fewer side by side."""
        texts = [SPACE + w.replace(" ", SPACE) for w in words]
        out: list[bytes] = [b""] * len(words)
        lengths: dict[int, list[int]] = defaultdict(list)
        for i, s in enumerate(texts):
            lengths[len(s)].append(i)
        # Rows of symbols of one width. A merge makes a row narrower by one, and the words of that width join it.
        rows, symbols, made = np.empty(0, np.int64), np.empty((0, SHORT), np.int64), np.empty((0, SHORT - 1), np.int64)
        for width in range(SHORT, 0, -1):
            if fresh := lengths.pop(width, None):
                points = np.frombuffer("".join([texts[i] for i in fresh]).encode("utf-32-le"), np.uint32)
                more = self.characters[points].astype(np.int64).reshape(-1, width)
                rows, symbols = np.concatenate([rows, fresh]), np.concatenate([symbols, more])
                made = np.concatenate([made, self.joint(more[:, :-1], more[:, 1:])])
            if not len(rows):
                symbols, made = symbols[:, 1:], made[:, 1:]
                continue
            here = np.arange(len(rows))
            scores = self.merits[made]
            at = scores.argmax(axis=1) if width > 1 else np.zeros(len(rows), np.int64)  # of equals the leftmost
            going = scores[here, at] > -np.inf if width > 1 else np.zeros(len(rows), bool)
            if not going.all():
                self._put(out, rows[~going], symbols[~going])
                rows, symbols, made, at = rows[going], symbols[going], made[going], at[going]
                here = np.arange(len(rows))
            if width == 1:
                break
            symbols[here, at] = made[here, at]
            symbols = symbols[np.arange(width) != at[:, None] + 1].reshape(len(rows), width - 1)
            made = made[np.arange(width - 1) != at[:, None]].reshape(len(rows), width - 2)
            for some, x in ((at > 0, at - 1), (at < width - 2, at)):
                r, c = here[some], x[some]
                made[r, c] = self.joint(symbols[r, c], symbols[r, c + 1])
        for left in lengths.values():  # longer ones
            for i in left:
                out[i] = self.word(texts[i])[1]
        return out

    def _put(self, out: list[bytes], rows: np.ndarray, symbols: np.ndarray) -> None:
        """Symbols of one width as ids, into the places of their rows."""
        n, size = len(self.pieces), 4 * symbols.shape[1]
        odd = (symbols >= n).any(axis=1)
        raw = symbols.astype(np.int32).tobytes()
        for k, (i, o) in enumerate(zip(rows.tolist(), odd.tolist())):
            out[i] = raw[k * size : (k + 1) * size] if not o else array("i", [x for c in symbols[k].tolist() for x in ([c] if c < n else self.spelled(-1, chr(c - n)))]).tobytes()

    def transfer(self, text: str, begin: int, end: int) -> np.ndarray:
        """The matrix of best weights from the states at a chunk's begin to those at its end; text reaches beyond both."""
        entries, exits = self.states(text, begin), self.states(text, end)
        if (places := self.narrow(text, begin, end)) is None:
            return self.swept(text, begin, end, entries, exits)
        first, last = places
        head, tail = np.full(len(entries), -np.inf), np.full(len(exits), -np.inf)
        for weights, _ in self.sweep(text, begin, first, entries).get(first, {}).values():
            for e, x in weights.items():
                head[e] = max(head[e], x)
        nodes = self.sweep(text, last, end, [START])
        for j, (over, i, s) in enumerate(exits):
            weights, _ = nodes.get(end + over, {}).get((0, i, s), ({}, {}))
            tail[j] = weights.get(0, -np.inf)
        between = 0.0 if self.kind == BPE else self.inside(text, first, last)[0]  # the merges' words all weigh 0
        return head[:, None] + between + tail[None, :]

    def swept(self, text: str, begin: int, end: int, entries: list[State], exits: list[State]) -> np.ndarray:
        """The matrix of a chunk whose lattice is nowhere narrow."""
        nodes, matrix = self.sweep(text, begin, end, entries), np.full((len(entries), len(exits)), -np.inf)
        for j, (over, i, s) in enumerate(exits):
            if end + over - len(s) < begin:  # one piece spans the chunk: an entry that is the exit itself
                for e, entry in enumerate(entries):
                    if entry[1:] == (i, s) and begin + entry[0] == end + over:
                        matrix[e, j] = 0.0
                continue
            weights, _ = nodes.get(end + over, {}).get((0, i, s), ({}, {}))
            for e, x in weights.items():
                if begin + entries[e][0] <= end + over - len(s):
                    matrix[e, j] = x
        return matrix

    def traces(self, chunks: list[tuple[str, int, int, State, State]]) -> list[bytes]:
        """Ids of the pieces that start in each chunk, on the best path between two states. Chunks: text, begin, end and both states."""
        places = [self.narrow(text, begin, end) for text, begin, end, *_ in chunks]
        if self.kind == BPE:  # what lies between starts with a space
            middles = self.words.ids([split_stretches(c[0][p[0] + 1 : p[1]].replace(SPACE, " ")) if p and p[0] < p[1] else [] for c, p in zip(chunks, places)])
        else:
            middles = [b"".join(self.inside(c[0], *p)[1]) if p else b"" for c, p in zip(chunks, places)]
        return [self.trace(*c, p, middle) for c, p, middle in zip(chunks, places, middles)]

    def trace(self, text: str, begin: int, end: int, entry: State, exit_: State, places: tuple[int, int] | None, middle: bytes) -> bytes:
        """Ids of the pieces that start in a chunk, middle being those between its narrow places."""
        if places is None:
            return array("i", self.backtrace(text, begin, end, entry, exit_)).tobytes()
        first, last = places
        ends = self.sweep(text, begin, first, [entry]).get(first, {})
        node = max(ends, key=lambda k: ends[k][0][0])
        head = [] if begin + entry[0] == first else self.backtrace(text, begin, first, entry, node)
        return b"".join([array("i", head).tobytes(), middle, array("i", self.backtrace(text, last, end, START, exit_)).tobytes()])

    def backtrace(self, text: str, begin: int, end: int, entry: State, exit_: State) -> list[int]:
        """Ids of the pieces that start in a swept stretch, on the best path between two states."""
        if end + exit_[0] - len(exit_[2]) < begin:
            return []
        nodes, at, node, path = self.sweep(text, begin, end, [entry]), end + exit_[0], (0, *exit_[1:]), []
        while at > begin + entry[0]:
            path.append((node[1], node[2]))
            at, node = nodes[at][node][1][0]
        return [x for i, s in reversed(path) for x in self.spelled(i, s)]

    def spelled(self, i: int, s: str) -> list[int]:
        return [i] if i >= 0 else [self.bytes[b] for b in s.encode()] if self.bytes else [self.unknown]

    # Texts

    def prepared(self, text: str) -> str:
        return (SPACE if self.dummy and text else "") + text.replace(" ", SPACE)

    def scan(self, text: str, size: int, fan: int = FAN) -> list[int]:
        """Ids of a prepared text by chunks; what the distributed path does, in one place."""
        chunks = [(a, min(a + size, len(text))) for a in range(0, len(text), size)]
        levels = [[self.transfer(text, a, b) for a, b in chunks]]
        while len(levels[-1]) > 1:
            levels.append([product(levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
        ends = [(0, int(np.argmax(levels[-1][0][0])))]
        for level in reversed(levels[:-1]):
            ends = [x for k, (b, e) in enumerate(ends) for x in between(level[k * fan : (k + 1) * fan], b, e)]
        ids = self.traces([(text, a, b, self.states(text, a)[s], self.states(text, b)[e]) for (a, b), (s, e) in zip(chunks, ends)])
        return np.frombuffer(b"".join(ids), np.int32).tolist()

    def decode(self, ids) -> str:
        out = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.dummy and out[:1] == " " else out

    def decoded(self, ids: pa.Array) -> pa.Array:
        """The texts of lists of ids: their pieces' bytes are taken and joined by Arrow; what is no UTF-8 is decoded one by one."""
        texts = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pc.take(self.raw_bytes, ids.values)) if ids.null_count == 0 else ids_to_bytes(ids, self.raw_bytes), b"")
        try:
            texts = texts.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([self.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in ids], pa.string())
        return pc.replace_substring_regex(texts, r"\A ", "") if self.dummy else texts


def ids_to_bytes(ids: pa.Array, raw: pa.Array) -> pa.Array:
    """Lists of ids as lists of their pieces' bytes; null lists stay null."""
    offsets = pa.array([None if not v else o for v, o in zip(ids.is_valid().to_pylist(), ids.offsets.to_pylist())] + [ids.offsets[-1].as_py()], pa.int32())
    return pa.ListArray.from_arrays(offsets, pc.take(raw, ids.values))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix product over max and plus."""
    return np.max(a[:, :, None] + b[None, :, :], axis=1, initial=-np.inf)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The product of consecutive matrices, halves first."""
    if len(matrices) == 1:
        return matrices[0]
    half = len(matrices) // 2
    return times(product(matrices[:half]), product(matrices[half:]))


def between(matrices: list[np.ndarray], begin: int, end: int) -> list[tuple[int, int]]:
    """For consecutive chunks, the states at both ends of each on the best path from the state begin to the state end."""
    after = [np.where(np.arange(matrices[-1].shape[1]) == end, 0.0, -np.inf)]
    for m in reversed(matrices):
        after.append(np.max(m + after[-1][None, :], axis=1))
    out, at = [], begin
    for m, rest in zip(matrices, reversed(after[:-1])):
        to = int(np.argmax(m[at] + rest))
        out.append((at, to))
        at = to
    return out


class Words:
    """Ids of lists of words by a function that segments new ones; those of a bounded number are remembered."""

    def __init__(self, segmented: Callable[[list[str]], list[bytes]]):
        self.segmented, self.known = segmented, {}

    def ids(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of each list as 32-bit numbers. Words that are new are segmented once."""
        words = set().union(*lists)
        if len(self.known) > CACHE:  # what these lists have is kept
            self.known = {w: ids for w in words if (ids := self.known.get(w)) is not None}
        known, new = self.known, list(words.difference(self.known))
        known.update(zip(new, self.segmented(new), strict=True))
        out = [b"".join(map(known.__getitem__, x)) for x in lists]
        for w in new:
            if len(w) > REMEMBERED:
                del known[w]
        return out


class Encoder:
    """Encodes texts by the library; the ids of a bounded number of words are remembered."""

    def __init__(self, model: bytes):
        self.model = PieceModel(model)
        self.words = Words(self.segmented)
        self.last: tuple[pa.Array, pa.Array] | None = None

    def encoded(self, texts: pa.Array) -> pa.Array:
        """Lists of the texts' ids. Those of the last batch are kept: where ids go on to another Python function, Spark has a batch encoded for each of the two."""
        if self.last is None or not self.last[0].equals(texts):
            self.last = None
            found = self.encode([t or "" for t in texts.to_pylist()])
            self.last = texts, _ids([x if t.is_valid else None for x, t in zip(found, texts)])
        return self.last[1]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit numbers."""
        if not self.model.dummy:
            return [array("i", ids).tobytes() for ids in self.model.library.encode(texts, num_threads=1)]
        return self.words.ids([split_stretches(t) if t else [] for t in texts])

    def segmented(self, words: list[str]) -> list[bytes]:
        """Ids of words, many in one text."""
        library, known = self.model.library, {"": array("i", [self.model.scores[SPACE][1]]).tobytes()}  # nothing after a space: the space alone
        odd = [w for w in words if " " in w or SPACE in w]
        plain = list(set(words).difference(odd, known))
        for i in range(0, len(plain), 1000):
            part = plain[i : i + 1000]
            ids = np.array(library.encode(" ".join(part)), np.int32)
            at = 4 * np.flatnonzero(self.model.heads[ids])  # each word's first piece begins with the space, no other does
            raw = ids.tobytes()
            known.update((w, raw[a:b]) for w, a, b in zip(part, at.tolist(), [*at[1:].tolist(), len(raw)], strict=True))
        for w, ids in zip(odd, library.encode(odd, num_threads=1) if odd else ()):
            known[w] = array("i", ids).tobytes()
        return [known[w] for w in words]


_ENCODERS: dict[bytes, Encoder] = {}


def encoder_of(key: bytes, model) -> Encoder:
    """The process's encoder of a broadcast model: tasks that a worker runs one after the other share it, and only the last model's is kept."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model.value)
    return _ENCODERS[key]


def split_stretches(text: str) -> list[str]:
    if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    out, begin = [], 0
    for m in re.finditer(f"(?<=[^ {SPACE}]) ", text):
        out.append(text[begin : m.start()])
        begin = m.end()
    return [*out, text[begin:]]


def load_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _ids(parts: list[bytes | None]) -> pa.Array:
    sizes = [0 if p is None else len(p) // 4 for p in parts]
    offsets = pa.array([None if p is None else int(o) for p, o in zip(parts, np.cumsum([0, *sizes]))] + [int(sum(sizes))], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(p for p in parts if p), np.int32)))


def encode_pieces(docs: DataFrame, text: str = "text", model: str = MODEL, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """docs with ids (array of int) and n_ids. Documents over chunk code points go through the scan."""
    spark = docs.sparkSession
    bounded_batches(spark)
    data = load_model(model)
    shared, key = spark.sparkContext.broadcast(data), sha256(data).digest()  # a vocabulary file, which no input makes larger

    def encoder() -> Encoder:
        return encoder_of(key, shared)

    @F.arrow_udf("array<int>")
    def whole(texts: pa.Array) -> pa.Array:
        return encoder().encoded(texts)

    out = without(docs, COLUMNS)
    row = unused(out, "row")
    big = F.coalesce(F.length(text) > chunk, F.lit(False))
    small = out.filter(~big).withColumn("ids", whole(F.col(text)))
    rows = durable(out.filter(big).withColumn(row, F.monotonically_increasing_id()), "giants")
    parts = scan_giants(rows.select(F.col(row).alias("row"), F.col(text).alias("t")), encoder, chunk, fan)
    both = small.unionByName(rows.join(parts.withColumnRenamed("row", row), row).drop(row))
    return both.withColumn("n_ids", F.when(F.col("ids").isNotNull(), F.size("ids").cast("long")))


def cut_chunks(rows: DataFrame, encoder, chunk: int) -> DataFrame:
    """row, k, t, a, b: the chunks of giant texts (row, t), each with the text around it that pieces at its ends can reach."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = encoder().model
                s = m.prepared(t.as_py())
                for k, a in enumerate(range(0, len(s), chunk)):
                    # A place's states depend on LONGEST code points before it, and whether it is narrow on one more.
                    left, b = max(0, a - m.longest - 1), min(a + chunk, len(s))
                    yield pa.RecordBatch.from_pylist([{"row": row, "k": k, "t": s[left : b + m.longest], "a": a - left, "b": b - left}], schema=schema)

    schema = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("t", pa.string()), ("a", pa.int32()), ("b", pa.int32())])
    return rows.mapInArrow(cut, "row long, k int, t string, a int, b int")


def chunk_matrices(chunks: DataFrame, encoder) -> DataFrame:
    """row, k, wide, m: the transfer matrix of each chunk, row by row as 64-bit floats, and its number of columns."""

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encoder().model.transfer(r["t"], r["a"], r["b"]) for r in batch.select(["t", "a", "b"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m.shape[1] for m in found], pa.int32()), pa.array([m.tobytes() for m in found], pa.binary())], names=["row", "k", "wide", "m"])

    return chunks.mapInArrow(matrices, "row long, k int, wide int, m binary")


def _read(c: dict) -> np.ndarray:
    return np.frombuffer(c["m"], np.float64).reshape(-1, c["wide"])


def scan_giants(rows: DataFrame, encoder, chunk: int, fan: int) -> DataFrame:
    """row, ids of giant texts (row, t): chunks, their matrices, products up a tree, states down it, and each chunk's backtrace."""

    @F.arrow_udf("struct<wide:int,m:binary>")
    def combined(groups: pa.Array) -> pa.Array:
        found = [product([_read(c) for c in g]) for g in groups.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([m.shape[1] for m in found], pa.int32()), pa.array([m.tobytes() for m in found], pa.binary())], names=["wide", "m"])

    @F.arrow_udf("int")
    def best(wide: pa.Array, m: pa.Array) -> pa.Array:
        return pa.array([int(np.argmax(np.frombuffer(x.as_py(), np.float64)[: w.as_py()])) for w, x in zip(wide, m)], pa.int32())

    @F.arrow_udf("array<struct<begin:int,end:int>>")
    def settled(groups: pa.Array, begin: pa.Array, end: pa.Array) -> pa.Array:
        out = [between([_read(c) for c in g], b, e) for g, b, e in zip(groups.to_pylist(), begin.to_pylist(), end.to_pylist())]
        return pa.array([[{"begin": b, "end": e} for b, e in x] for x in out], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = encoder().model
        for whole in batches:
            for batch in (whole.slice(i, CHUNKS_A_TASK) for i in range(0, whole.num_rows, CHUNKS_A_TASK)):
                ids = m.traces([(r["t"], r["a"], r["b"], m.states(r["t"], r["a"])[r["begin"]], m.states(r["t"], r["b"])[r["end"]]) for r in batch.to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _ids(ids)], names=["row", "k", "part"])

    def groups(level: DataFrame, what: str) -> DataFrame:
        """The matrices of a level by their parent, in order: fan at most in a list."""
        put = F.sort_array(F.collect_list(F.struct("k", "wide", "m")))
        return level.groupBy("row", F.floor(F.col("k") / fan).cast("int").alias(what)).agg(put.alias("g"))

    count = rows.agg(F.sum(F.ceil((F.length("t") + 1) / chunk))).first()[0] or 0
    chunks = durable(cut_chunks(rows, encoder, chunk).repartition(max(1, -(-count // CHUNKS_A_TASK)), "row", "k"), "chunks")
    levels = [durable(chunk_matrices(chunks, encoder), "matrices")]
    while (levels[-1].agg(F.max("k")).first()[0] or 0) > 0:
        levels.append(durable(groups(levels[-1], "k").withColumn("p", combined("g")).select("row", "k", "p.wide", "p.m"), "products"))
    ends = levels[-1].select("row", "k", F.lit(0).alias("begin"), best("wide", "m").alias("end"))
    for level in reversed(levels[:-1]):
        ends = groups(level, "k").join(ends, ["row", "k"]).select("row", F.transform("g", lambda c: c["k"]).alias("ks"), settled("g", "begin", "end").alias("s"))
        ends = ends.select("row", F.explode(F.arrays_zip("ks", "s")).alias("z")).select("row", F.col("z.ks").alias("k"), "z.s.begin", "z.s.end")
    ends = F.broadcast(ends) if count <= BROADCAST_CHUNKS else ends
    parts = chunks.join(ends, ["row", "k"]).select("row", "k", "t", "a", "b", "begin", "end").mapInArrow(traced, "row long, k int, part array<int>")
    return parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "part"))).alias("p")).select("row", F.flatten("p.part").alias("ids"))


def decode_pieces(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """encoded with decoded: the text of ids."""
    spark = encoded.sparkSession
    bounded_batches(spark)
    data = load_model(model)
    shared, key = spark.sparkContext.broadcast(data), sha256(data).digest()

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        return encoder_of(key, shared).model.decoded(column)

    return encoded.withColumn("decoded", decoded(F.col(ids)))
