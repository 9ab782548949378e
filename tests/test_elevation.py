"""Elevation files of every kind by block ranges, against the arrays that they were made from."""

import struct
import zlib

import numpy as np
import pytest

from vespera.operators import segments
from vespera.sources import elevation, geodata
from vespera.sources.tiff import Tiff, lzw


def lzw_coded(data: bytes) -> bytes:
    known, width, codes = {bytes([i]): i for i in range(256)}, 9, []
    codes.append((256, 9))
    held = b""
    for i in range(len(data)):
        one = data[i : i + 1]
        if held + one in known:
            held += one
            continue
        codes.append((known[held], width))
        known[held + one] = len(known) + 2
        if len(known) + 2 == 1 << width:
            width += 1
        if len(known) + 2 >= 4094:
            codes.append((256, width))
            known, width = {bytes([j]): j for j in range(256)}, 9
        held = one
    if held:
        codes.append((known[held], width))
    codes.append((257, width))
    text = "".join(f"{c:0{n}b}" for c, n in codes)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def tiff(h: np.ndarray, west, north, cell, order="<", big=False, packing=1, predictor=1, tile=None, strip=7, nodata=None) -> bytes:
    """A one-band TIFF of any of the kinds."""
    kind = h.dtype.newbyteorder(order)
    if tile:
        blocks = [np.pad(h[r : r + tile, c : c + tile], [(0, max(0, r + tile - h.shape[0])), (0, max(0, c + tile - h.shape[1]))]) for r in range(0, h.shape[0], tile) for c in range(0, h.shape[1], tile)]
    else:
        blocks = [h[r : r + strip] for r in range(0, h.shape[0], strip)]
    parts = []
    for b in blocks:
        if predictor == 2:
            b = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1).astype(h.dtype)
        raw = b.astype(kind).tobytes()
        if predictor == 3:
            planes = b.astype(h.dtype.newbyteorder(">")).view(np.uint8).reshape(*b.shape, h.dtype.itemsize).transpose(0, 2, 1).reshape(b.shape[0], -1)
            raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
        parts.append({1: raw, 8: zlib.compress(raw), 5: lzw_coded(raw)}[packing])
    w = "Q" if big else "I"
    entries = {256: ("I", [h.shape[1]]), 257: ("I", [h.shape[0]]), 258: ("H", [h.dtype.itemsize * 8]), 259: ("H", [packing]), 277: ("H", [1]), 317: ("H", [predictor]), 339: ("H", [{"u": 1, "i": 2, "f": 3}[h.dtype.kind]]), 33550: ("d", [cell, cell, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, west, north, 0.0])}
    entries |= {322: ("I", [tile]), 323: ("I", [tile]), 324: (w, [0] * len(parts)), 325: ("I", [len(p) for p in parts])} if tile else {273: (w, [0] * len(parts)), 278: ("I", [strip]), 279: ("I", [len(p) for p in parts])}
    if nodata is not None:
        entries[42113] = ("s", str(nodata).encode() + b"\0")
    ids, small = {"H": 3, "I": 4, "d": 12, "s": 2, "Q": 16}, 8 if big else 4
    head, at = (16, 8 + 20 * len(entries) + 8) if big else (8, 2 + 12 * len(entries) + 4)
    extra_at = head + at
    pack = lambda e: e[1] if e[0] == "s" else struct.pack(f"{order}{len(e[1])}{e[0]}", *e[1])
    body_at = extra_at + sum(len(pack(e)) for e in entries.values() if len(pack(e)) > small)
    starts = [body_at + sum(map(len, parts[:i])) for i in range(len(parts))]
    entries[324 if tile else 273] = (w, starts)
    mark = b"II" if order == "<" else b"MM"
    out = mark + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8)) + struct.pack(order + ("Q" if big else "H"), len(entries))
    extra = b""
    for tag in sorted(entries):
        raw, count = pack(entries[tag]), len(entries[tag][1])
        field = raw.ljust(small, b"\0") if len(raw) <= small else struct.pack(order + w, extra_at + len(extra))
        extra += raw if len(raw) > small else b""
        out += struct.pack(order + "HH" + w, tag, ids[entries[tag][0]], count) + field
    return out + struct.pack(order + w, 0) + extra + b"".join(parts)


@pytest.mark.parametrize("packing, predictor", [(1, 1), (8, 1), (8, 2), (8, 3), (5, 1), (5, 2), (5, 3)])
def test_files_of_each_kind_agree(packing, predictor):
    rng = np.random.default_rng(packing * 10 + predictor)
    whole = np.round(np.cumsum(rng.normal(0, 2, (61, 53)), axis=1)).astype(np.float32)
    for kind in ("f4", "i2", "u1", "f8"):
        h = (whole if kind != "u1" else np.abs(whole)).astype(kind)
        if predictor == 3 and h.dtype.kind != "f" or predictor == 2 and h.dtype.kind == "f":
            continue
        for order in "<>":
            for big in (False, True):
                for tile in (None, 16):
                    file = Tiff(lambda at, n, data=tiff(h, 0.0, 1.0, 0.1, order, big, packing, predictor, tile): data[at : at + n])
                    assert (file.window(0, 61, 0, 53)[0] == h).all(), (kind, order, big, tile)
                    assert (file.window(13, 37, 20, 50, [0])[0] == h[13:37, 20:50]).all()


def test_lzw_over_full_tables():
    rng = np.random.default_rng(3)
    for data in (b"", b"a", b"a" * 50_000, rng.integers(0, 256, 40_000).astype(np.uint8).tobytes(), bytes(range(256)) * 200, rng.integers(0, 3, 60_000).astype(np.uint8).tobytes()):
        assert lzw(lzw_coded(data), len(data)) == data
    with pytest.raises(ValueError, match="stands for nothing"):
        lzw(int(("100000000" + "111111110").ljust(24, "0"), 2).to_bytes(3, "big"), 10)


@pytest.fixture
def folder(tmp_path):
    """Two tiles of 60 cells a degree, one of which reaches three cells beyond its degree on every side."""
    rng = np.random.default_rng(1)
    a, b = rng.normal(100, 50, (60, 60)).astype(np.float32), rng.normal(100, 50, (66, 66)).astype(np.float32)
    a[5, 5] = -9999
    (tmp_path / "a.tif").write_bytes(tiff(a, -122.0, 38.0, 1 / 60, packing=5, predictor=3, nodata=-9999))
    (tmp_path / "b.tif").write_bytes(tiff(b, -121.05, 38.05, 1 / 60, big=True, packing=8, predictor=3, tile=16))
    (tmp_path / "notes.txt").write_text("no raster")
    a[5, 5] = 0
    return tmp_path, {(37, -122): (a, 0), (37, -121): (b, -3)}


def test_blocks_of_cells_with_halos(spark, folder):
    path, tiles = folder
    rows = elevation.read_elevations(spark, str(path), 16).collect()
    assert len(rows) == 2 * 16 and {r.cells for r in rows} == {60}
    for r in rows:
        h, first = tiles[r.south, r.west]
        low, high = first, first + h.shape[0]
        assert r.r0 == max(r.block_r * 16 - 1, low) and r.r0 + r.rows == min(min(r.block_r * 16 + 16, 60) + 1, high)
        got = np.frombuffer(r.pixels, np.float32).reshape(r.rows, r.cols)
        assert (got == h[r.r0 - first : r.r0 - first + r.rows, r.c0 - first : r.c0 - first + r.cols]).all()


def test_filters_keep_blocks_from_being_read(spark, folder):
    path, tiles = folder
    data = bytearray((path / "b.tif").read_bytes())
    file = Tiff(lambda at, n: bytes(data[at : at + n]))
    for at, size in list(zip(file.tags[324], file.tags[325]))[10:]:
        data[at : at + size] = b"\xff" * size  # no zlib stream
    (path / "b.tif").write_bytes(bytes(data))
    blocks = elevation.read_elevations(spark, str(path), 16)
    some = blocks.filter("west = -121 AND block_r < 1")
    assert some.count() == 4 and some.rdd.getNumPartitions() == 1
    assert blocks.filter("south IN (37) AND west <= -122 AND rows > 0").count() == 16
    with pytest.raises(Exception, match=r"cannot read elevations of .*b\.tif"):
        blocks.filter("block_r = 3").count()


def test_a_broken_or_missing_file_is_named(spark, tmp_path):
    (tmp_path / "x.tif").write_bytes(b"II*\0")
    with pytest.raises(Exception, match=r"x\.tif"):
        elevation.read_elevations(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="no elevations"):
        elevation.read_elevations(spark, str(tmp_path / "gone")).collect()


def test_source_blocks_are_those_of_the_whole_file_reader(spark, folder):
    path, tiles = folder
    (path / "b.tif").unlink()
    whole = segments.haloed(geodata.elevation_blocks(spark, str(path), 16), 16)
    key = ["south", "west", "block_r", "block_c", "r0", "c0", "rows", "cols", "pixels"]
    assert sorted(whole.select(key).collect()) == sorted(elevation.read_elevations(spark, f"file://{path}", 16).select(key).collect())
