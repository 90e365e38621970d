"""Windows of TIFF rasters read block by block: files are opened for their directories, and only the blocks asked for are read.

A table of blocks is made from the files' directories, one task for some files; a window is a filter on it, so what is not
asked for is never read. The blocks that stay are dealt over tasks, which read each one's bytes by its place and decode them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.sources.storage import BITS, CODES, FORMAT, HEIGHT, SAMPLES, SIZES, WIDTH

# Fixed values of TIFF: tags of the layout, and the compressions that are read (none, deflate by its two codes).
COMPRESSION, STRIP_OFFSETS, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 259, 273, 278, 279, 284, 317, 322, 323, 324, 325
PLAIN, DEFLATE = 1, (8, 32946)
HEAD = 1 << 14  # bytes read at once for a directory

BLOCK = "path string, band int, bands int, r0 int, c0 int, rows int, columns int, full_rows int, full_columns int, offset long, size long, dtype string, compression int, predictor int"


class Source:
    """Ranges of a file in any store that Arrow opens; a path without a scheme is local."""

    def __init__(self, path: str):
        from pyarrow import fs

        if path.startswith("file:"):
            path = "/" + path[5:].lstrip("/")
        store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.file = store.open_input_file(name)
        self.head = b""

    def read(self, at: int, n: int) -> bytes:
        if at + n <= HEAD:
            if not self.head:
                self.head = self.file.read_at(min(HEAD, self.file.size()), 0)
            return self.head[at : at + n]
        return self.file.read_at(n, at)

    def close(self) -> None:
        self.file.close()


def directory(source: Source) -> tuple[str, dict]:
    """Byte order and tags of a (Big)TIFF file's first image; a ValueError if it is none."""
    try:
        first = source.read(0, 16)
        order = {b"II": "<", b"MM": ">"}[first[:2]]
        big = struct.unpack_from(order + "H", first, 2)[0] == 43
        (at,) = struct.unpack_from(order + ("Q" if big else "I"), first, 8 if big else 4)
        long, entry = (8, 20) if big else (2, 12)
        (n,) = struct.unpack(order + ("Q" if big else "H"), source.read(at, long))
        raw, tags = source.read(at + long, n * entry), {}
        for i in range(n):
            tag, kind = struct.unpack_from(order + "HH", raw, i * entry)
            (count,) = struct.unpack_from(order + ("Q" if big else "I"), raw, i * entry + 4)
            if kind not in CODES:
                continue
            place, width = i * entry + (12 if big else 8), count * SIZES[kind]
            if width > (8 if big else 4):
                (far,) = struct.unpack_from(order + ("Q" if big else "I"), raw, place)
                value = source.read(far, width)
            else:
                value = raw[place : place + width]
            tags[tag] = struct.unpack(f"{order}{count}{CODES[kind]}", value)
        return order, tags
    except (KeyError, struct.error, IndexError) as e:
        raise ValueError("not a TIFF file") from e


def blocks_of(path: str) -> list[tuple]:
    """Rows of BLOCK of a file: one for each stripe or tile; band is 0 where a block holds all bands, which are counted from 1."""
    source = Source(path)
    try:
        order, tags = directory(source)
    finally:
        source.close()
    width, height, bands = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]] + str(tags.get(BITS, (8,))[0] // 8)
    if TILE_OFFSETS in tags:
        across, down, offsets, sizes = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0], tags[TILE_OFFSETS], tags[TILE_SIZES]
    else:
        across, down, offsets, sizes = width, min(tags.get(STRIP_ROWS, (height,))[0], height), tags[STRIP_OFFSETS], tags[STRIP_SIZES]
    columns, rows = -(-width // across), -(-height // down)
    apart = bands > 1 and tags.get(PLANAR, (1,))[0] == 2
    out = []
    for i, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, place = divmod(i, columns * rows)
        r0, c0 = place // columns * down, place % columns * across
        full = down if TILE_OFFSETS in tags else min(down, height - r0)
        out.append((path, plane + 1 if apart else 0, 1 if apart else bands, r0, c0, min(down, height - r0), min(across, width - c0), full, across, offset, size, order + kind, tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]))
    return out


def decoded(data: bytes, rows: int, columns: int, bands: int, dtype: str, compression: int, predictor: int) -> np.ndarray:
    """(rows, columns, bands) of a block's bytes; a block of no bytes is empty ground, all zero."""
    kind = np.dtype(dtype)
    if not data:
        return np.zeros((rows, columns, bands), kind.newbyteorder("="))
    if compression in DEFLATE:
        data = zlib.decompress(data)
    elif compression != PLAIN:
        raise ValueError(f"compression {compression} is not read")
    if predictor == 3:  # bytes of a row by significance, each less the one before it
        raw = np.cumsum(np.frombuffer(data, np.uint8).reshape(rows, -1, bands), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, columns * bands)
        flat = np.ascontiguousarray(raw.transpose(0, 2, 1)).view(kind.newbyteorder(">"))
        return flat.reshape(rows, columns, bands).astype(kind.newbyteorder("="))
    out = np.frombuffer(data, kind, rows * columns * bands).reshape(rows, columns, bands).astype(kind.newbyteorder("="))
    return np.cumsum(out, axis=1, dtype=out.dtype) if predictor == 2 else out


def _directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in BLOCK.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in BLOCK.split(", ")]
    for batch in batches:
        for path in batch.column("path").to_pylist():
            found = blocks_of(path)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names)


def _cells(window: tuple[int, int, int, int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, None
        for batch in batches:
            for b in batch.to_pylist():
                if b["path"] != opened:
                    if source:
                        source.close()
                    source, opened = Source(b["path"]), b["path"]
                block = decoded(source.read(b["offset"], b["size"]) if b["size"] else b"", b["full_rows"], b["full_columns"], b["bands"], b["dtype"], b["compression"], b["predictor"])
                top, left, bottom, right = b["r0"], b["c0"], b["r0"] + b["rows"], b["c0"] + b["columns"]
                if window:
                    top, left, bottom, right = max(top, window[0]), max(left, window[1]), min(bottom, window[0] + window[2]), min(right, window[1] + window[3])
                part = block[top - b["r0"] : bottom - b["r0"], left - b["c0"] : right - b["c0"]]
                r, c, k = (x.ravel() for x in np.indices(part.shape))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["path"]] * part.size, pa.string()), pa.array((b["band"] or 1) + k, pa.int32()), pa.array(top + r, pa.int32()), pa.array(left + c, pa.int32()), pa.array(part.ravel().astype(float))],
                    ["path", "band", "r", "c", "v"],
                )
        if source:
            source.close()

    return run


def raster_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks (BLOCK) of every TIFF file under a folder, from the files' directories only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tif,tiff}").load(folder).select("path")  # names, not contents
    return files.mapInArrow(_directories, BLOCK)


def in_window(blocks: DataFrame, top: int, left: int, rows: int, columns: int) -> DataFrame:
    """The blocks that a window meets."""
    return blocks.where((F.col("r0") < top + rows) & (F.col("r0") + F.col("rows") > top) & (F.col("c0") < left + columns) & (F.col("c0") + F.col("columns") > left))


def read_cells(blocks: DataFrame, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """path, band (from 1), r, c, v of the cells of blocks, or of a window (top, left, rows, columns) of them."""
    spark = blocks.sparkSession
    chosen = in_window(blocks, *window) if window else blocks
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # Rows of a block are few bytes each and become many: dealt over tasks, a file's blocks in the order of their places.
    dealt = chosen.repartition(tasks, "path", F.floor(F.col("offset") / (1 << 24))).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(_cells(window), "path string, band int, r int, c int, v double")
