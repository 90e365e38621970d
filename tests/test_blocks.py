"""Blocks of TIFF files of several layouts, written here byte by byte."""

import struct
import zlib

import numpy as np
import pytest

from geoloom.sources import blocks as B


def tiff(path, m, tile=None, stripe=None, deflate=False, predictor=1, order="<", apart=False, big=False):
    """Writes (rows, columns, bands) as a TIFF file."""
    h, w, n = m.shape
    across, down = tile or (w, stripe or h)
    planes = [m[:, :, k : k + 1] for k in range(n)] if apart else [m]
    chunks = []
    for p in planes:
        for r in range(0, h, down):
            for c in range(0, w, across):
                part = p[r : r + down, c : c + across]
                if tile:
                    part = np.pad(part, ((0, down - part.shape[0]), (0, across - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1).astype(m.dtype)
                raw = np.ascontiguousarray(part).astype(m.dtype.newbyteorder(order)).tobytes()
                if predictor == 3:
                    big_end = np.ascontiguousarray(part).astype(m.dtype.newbyteorder(">")).view(np.uint8).reshape(part.shape[0], -1, m.dtype.itemsize).transpose(0, 2, 1).reshape(part.shape[0], -1, part.shape[2])
                    raw = np.concatenate([big_end[:, :1], np.diff(big_end, axis=1)], axis=1).astype(np.uint8).tobytes()
                chunks.append(zlib.compress(raw) if deflate else raw)
    offsets, at = [], 16
    for c in chunks:
        offsets.append(at)
        at += len(c)
    kind = {"u": 1, "i": 2, "f": 3}[m.dtype.kind]
    long = (16, "Q") if big else (4, "I")
    tags = {256: (4, "I", [w]), 257: (4, "I", [h]), 258: (3, "H", [m.dtype.itemsize * 8] * n), 259: (3, "H", [8 if deflate else 1]), 277: (3, "H", [n]), 284: (3, "H", [2 if apart else 1]), 317: (3, "H", [predictor]), 339: (3, "H", [kind] * n)}
    sizes = [len(c) for c in chunks]
    tags |= {322: (4, "I", [across]), 323: (4, "I", [down]), 324: (*long, offsets), 325: (*long, sizes)} if tile else {273: (*long, offsets), 278: (4, "I", [down]), 279: (*long, sizes)}
    room, entry, word = (8, 20, "Q") if big else (4, 12, "I")
    body, extra, far = b"", b"", at + (8 if big else 2) + entry * len(tags) + room
    for tag in sorted(tags):
        code, letter, values = tags[tag]
        data = struct.pack(f"{order}{len(values)}{letter}", *values)
        if len(data) > room:
            place, data, extra = struct.pack(order + word, far + len(extra)), b"", extra + data
        else:
            place = data.ljust(room, b"\0")
        body += struct.pack(order + "HH" + word, tag, code, len(values)) + place
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at)).ljust(14, b"\0")
    path.write_bytes(head[:16] + b"".join(chunks) + struct.pack(order + ("Q" if big else "H"), len(tags)) + body + b"\0" * room + extra)


LAYOUTS = {
    "plain": {}, "stripes": {"stripe": 7}, "tiles": {"tile": (16, 32)}, "deflate": {"tile": (16, 16), "deflate": True, "predictor": 2}, "motorola": {"stripe": 5, "order": ">", "deflate": True, "predictor": 2},
    "apart": {"tile": (32, 16), "apart": True}, "big": {"tile": (16, 16), "big": True, "deflate": True},
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(spark, tmp_path, name):
    rng = np.random.default_rng(1)
    m = rng.integers(0, 60000, (45, 50, 3)).astype(np.uint16)
    tiff(tmp_path / "a.tif", m, **LAYOUTS[name])
    cells = B.read_cells(B.raster_blocks(spark, str(tmp_path))).toPandas()
    got = np.full(m.shape, -1.0)
    got[cells.r, cells.c, cells.band - 1] = cells.v
    assert len(cells) == m.size and (got == m).all()


def test_floats_with_their_predictor(spark, tmp_path):
    m = np.random.default_rng(2).normal(size=(20, 33, 1)).astype(np.float32)
    tiff(tmp_path / "f.tiff", m, tile=(16, 16), deflate=True, predictor=3)
    cells = B.read_cells(B.raster_blocks(spark, str(tmp_path))).toPandas()
    assert (m[cells.r, cells.c, 0] == cells.v.astype(np.float32)).all() and len(cells) == m.size


def test_a_window_reads_its_blocks_only(spark, tmp_path):
    m = np.arange(100 * 120, dtype=np.int32).reshape(100, 120, 1)
    for name in "ab":
        tiff(tmp_path / f"{name}.tif", m + ord(name), tile=(16, 16), deflate=True)
    blocks = B.raster_blocks(spark, str(tmp_path))
    assert blocks.count() == 2 * 7 * 8
    met = B.in_window(blocks, 20, 30, 10, 20)
    assert sorted({(r.r0, r.c0) for r in met.collect()}) == [(16, 16), (16, 32), (16, 48)]
    cells = B.read_cells(blocks, (20, 30, 10, 20)).collect()
    assert {(r.path[-5], r.r, r.c, int(r.v)) for r in cells} == {(n, r, c, int(m[r, c, 0]) + ord(n)) for n in "ab" for r in range(20, 30) for c in range(30, 50)}
    # The other blocks' bytes may be anything: they are not read.
    first = met.where("path LIKE '%a.tif'").orderBy("offset").first()
    raw = bytearray((tmp_path / "a.tif").read_bytes())
    raw[16 : first.offset] = b"\xff" * (first.offset - 16)
    (tmp_path / "a.tif").write_bytes(bytes(raw))
    assert len(B.read_cells(blocks, (20, 30, 10, 20)).collect()) == len(cells)
    with pytest.raises(Exception, match="zlib|Error"):
        B.read_cells(blocks).count()


def test_files_that_are_none(spark, tmp_path):
    assert B.raster_blocks(spark, str(tmp_path)).count() == 0
    (tmp_path / "x.tif").write_bytes(b"not a raster")
    with pytest.raises(Exception, match="not a TIFF file"):
        B.raster_blocks(spark, str(tmp_path)).count()
