"""TIFF files by ranges: the directory first, then the blocks that a window needs and no others."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from functools import cached_property

import numpy as np

# Tags and field types, fixed by the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILE_AT, TILE_BYTES, SAMPLE_FORMAT, SCALE, TIEPOINT, GEO_KEYS, METADATA, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42112, 42113
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATE = (1,), (5,), (8, 32946)
#: LZW's own codes, and the widest one's bits.
CLEAR, END, WIDEST = 256, 257, 12

#: (offset, size) -> bytes of a file
ReadAt = Callable[[int, int], bytes]


def lzw(data: bytes, size: int) -> bytes:
    """The first size bytes that TIFF's LZW codes stand for: codes of 9 to 12 bits, high bit first, that widen one code early."""
    plain = [bytes([i]) for i in range(256)] + [b"", b""]
    known, width, last, out, made = plain.copy(), 9, b"", [], 0
    held = bits = 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == CLEAR:
            known, width, last = plain.copy(), 9, b""
            continue
        if code == END:
            break
        if code < len(known):
            found = known[code]
        elif last and code == len(known):
            found = last + last[:1]
        else:
            raise ValueError("a code that stands for nothing")
        if last:
            known.append(last + found[:1])
            if len(known) + 1 >> width and width < WIDEST:
                width += 1
        out.append(found)
        made += len(found)
        if made >= size:
            break
        last = found
    return b"".join(out)[:size]


class Tiff:
    """The directory of a plain or large TIFF file, and its blocks: strips or tiles, uncompressed, deflated or LZW, predictors 1 to 3."""

    def __init__(self, read_at: ReadAt):
        self.read_at = read_at
        head = read_at(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        magic = struct.unpack_from(f"{self.order}H", head, 2)[0] if self.order and len(head) >= 8 else 0
        if magic not in (42, 43) or magic == 43 and (len(head) < 16 or struct.unpack_from(f"{self.order}2H", head, 4) != (8, 0)):
            raise ValueError("not a TIFF file")
        # Offsets and counts have 4 bytes, in large files 8.
        self.word, self.count, entry = ("Q", "Q", 20) if magic == 43 else ("I", "H", 12)
        at = struct.unpack_from(self.order + self.word, head, 8 if magic == 43 else 4)[0]
        width = struct.calcsize(self.count)
        n = struct.unpack(self.order + self.count, read_at(at, width))[0]
        table = read_at(at + width, n * entry)
        self.tags: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, values = struct.unpack_from(f"{self.order}HH{self.word}", table, i * entry)
            if kind in FIELD:
                self.tags[tag] = self._values(FIELD[kind], values, table[i * entry + entry - struct.calcsize(self.word) : (i + 1) * entry])
        if self.one(COMPRESSION, 1) not in PLAIN + LZW + DEFLATE:
            raise ValueError("only plain, deflated and LZW TIFF files are read")
        if WIDTH not in self.tags or HEIGHT not in self.tags or not (STRIP_AT in self.tags or TILE_AT in self.tags):
            raise ValueError("a TIFF file without an image")

    def _values(self, code: str, n: int, field: bytes) -> tuple:
        size = struct.calcsize("=" + code) * n
        raw = field if size <= len(field) else self.read_at(struct.unpack(self.order + self.word, field)[0], size)
        if len(raw) < size:
            raise ValueError("a TIFF file that ends too early")
        return (raw[:n].rstrip(b"\0"),) if code == "c" else struct.unpack_from(f"{self.order}{n}{code}", raw)

    def one(self, tag: int, default):
        return self.tags.get(tag, (default,))[0]

    @cached_property
    def shape(self) -> tuple[int, int, int]:
        """Bands, rows, columns."""
        return self.one(SAMPLES, 1), self.one(HEIGHT, 0), self.one(WIDTH, 0)

    @cached_property
    def kind(self) -> np.dtype:
        return np.dtype({1: "u", 2: "i", 3: "f"}[self.one(SAMPLE_FORMAT, 1)] + str(self.one(BITS, 8) // 8))

    @cached_property
    def block(self) -> tuple[int, int]:
        """Rows and columns of a block."""
        if TILE_AT in self.tags:
            return self.one(TILE_H, 0), self.one(TILE_W, 0)
        return min(self.shape[1], self.one(ROWS, self.shape[1])), self.shape[2]

    def pixels(self, band: int | None, r: int, c: int) -> np.ndarray:
        """Block (r, c) as rows, columns, bands: of one band where bands are apart, of all (band None) where they are not."""
        (bands, h, w), (bh, bw) = self.shape, self.block
        tiled, across, down = TILE_AT in self.tags, -(-w // bw), -(-h // bh)
        i = (band or 0) * across * down + r * across + c
        at, size = self.tags[TILE_AT if tiled else STRIP_AT][i], self.tags[TILE_BYTES if tiled else STRIP_BYTES][i]
        rows, deep = bh if tiled else min(bh, h - r * bh), bands if band is None else 1
        length = rows * bw * deep * self.kind.itemsize
        raw, packing, predictor = self.read_at(at, size), self.one(COMPRESSION, 1), self.one(PREDICTOR, 1)
        raw = raw if packing in PLAIN else lzw(raw, length) if packing in LZW else zlib.decompress(raw)
        if len(raw) < length:
            raise ValueError("a block that ends too early")
        if predictor == 3:  # bytes of a row by significance, then differences of bytes
            planes = np.add.accumulate(np.frombuffer(raw, np.uint8, length).reshape(rows, -1, deep), axis=1, dtype=np.uint8)
            return np.ascontiguousarray(planes.reshape(rows, self.kind.itemsize, bw * deep).transpose(0, 2, 1)).view(self.kind.newbyteorder(">")).reshape(rows, bw, deep)
        out = np.frombuffer(raw, self.kind.newbyteorder(self.order), rows * bw * deep).reshape(rows, bw, deep)
        return np.add.accumulate(out, axis=1, dtype=self.kind) if predictor == 2 else out

    def window(self, r0: int, r1: int, c0: int, c1: int, bands: list[int] | None = None) -> np.ndarray:
        """Bands (all, or those named), rows r0 to r1 and columns c0 to c1, ends exclusive, from the blocks that hold some of them."""
        (n, h, w), (bh, bw) = self.shape, self.block
        names = list(range(n)) if bands is None else bands
        out = np.zeros((len(names), r1 - r0, c1 - c0), self.kind)
        apart = self.one(PLANAR, 1) == 2
        for r in range(r0 // bh, -(-r1 // bh)):
            for c in range(c0 // bw, -(-c1 // bw)):
                rows, cols = slice(max(r0, r * bh), min(r1, (r + 1) * bh, h)), slice(max(c0, c * bw), min(c1, (c + 1) * bw, w))
                whole = None if apart else self.pixels(None, r, c)
                for k, band in enumerate(names):
                    part = self.pixels(band, r, c)[:, :, 0] if apart else whole[:, :, band]
                    out[k, rows.start - r0 : rows.stop - r0, cols.start - c0 : cols.stop - c0] = part[rows.start - r * bh : rows.stop - r * bh, cols.start - c * bw : cols.stop - c * bw]
        return out
