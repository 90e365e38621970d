"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers, decoded and resampled with numpy.

Companded samples are expanded through 256-entry tables built from the G.711 rule. ADPCM blocks are decoded across
blocks: step t of the decoder runs for all blocks of a batch at once, so the Python work does not grow with their
number. Stored forms are written to the shared folder: the payload as mu-law WAV, and what it decodes to, resampled to
half its rate, as 16-bit PCM WAV; digests and features are read from the written bytes. Rows of an Arrow batch are
worked on `HELD` bytes at a time (or one row, if that is longer).

Defined cases: a null or empty payload is stored as 64 zero bytes; equal payloads give equal stored forms; a stored
form that is no WAV file of a known format decodes to null. Only the named columns are read, so further columns of
any name do no harm; repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import materialize, table

RATE = 8000
BLOCK = 64
HELD = 1 << 21  # bytes of payloads worked on at a time
PIECE = 1 << 18  # samples expanded at a time
PCM, ALAW, MULAW, IMA = 1, 6, 7, 0x11
#: Options of the written media: audio is large and read once, so it is packed well, in pages that hold many rows.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}

# Fixed values of the IMA ADPCM format: the step sizes and the index steps of the eight magnitudes.
IMA_STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
]
IMA_INDEX = [-1, -1, -1, -1, 2, 4, 6, 8]


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: complemented bits hold sign, three of exponent and four of mantissa, with a bias of 132."""
    u = ~np.arange(256) & 0xFF
    size = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: even bits inverted; the lowest segment is linear."""
    a = np.arange(256) ^ 0x55
    part, mantissa = (a >> 4) & 7, (a & 15) << 4
    size = np.where(part == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(part - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


def _ima_tables() -> tuple[np.ndarray, np.ndarray]:
    """For step index * 16 + code: the signed difference, and the next index * 16."""
    step, code = np.array(IMA_STEPS)[:, None], np.arange(16)[None, :]
    diff = (step >> 3) + step * (code >> 2 & 1) + (step >> 1) * (code >> 1 & 1) + (step >> 2) * (code & 1)
    after = np.clip(np.arange(len(IMA_STEPS))[:, None] + np.array(IMA_INDEX)[code & 7], 0, len(IMA_STEPS) - 1)
    return np.where(code & 8, -diff, diff).astype(np.int32).ravel(), (after * 16).astype(np.int32).ravel()


MU, A = mulaw_table(), alaw_table()
IMA_DIFF, IMA_NEXT = _ima_tables()


def ima_decode(blocks: np.ndarray) -> np.ndarray:
    """Blocks (n, size) of mono IMA ADPCM to PCM (n, 1 + 2 * (size - 4)): one decoder step for all blocks at a time."""
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    at = np.minimum(blocks[:, 2], len(IMA_STEPS) - 1).astype(np.int32) * 16
    out = np.empty((1 + 2 * len(codes), len(blocks)), np.int16)
    out[0] = value
    for t, byte in enumerate(codes):
        for half, code in enumerate((byte & 15, byte >> 4)):
            at += code
            value += IMA_DIFF[at]
            np.clip(value, -32768, 32767, out=value)
            at = IMA_NEXT[at]
            out[1 + 2 * t + half] = value
    return out.T


def ima_encode(pcm: np.ndarray, size: int = BLOCK) -> bytes:
    """PCM to mono IMA ADPCM blocks, all blocks at once; the last block is filled with its last sample."""
    per = 1 + 2 * (size - 4)
    pcm = np.asarray(pcm, np.int32)
    pcm = np.concatenate([pcm, np.full(-len(pcm) % per, pcm[-1] if len(pcm) else 0, np.int32)]).reshape(-1, per)
    value, at = pcm[:, 0].copy(), np.zeros(len(pcm), np.int32)
    out = np.zeros((len(pcm), size), np.uint8)
    out[:, :2] = value.astype("<i2").view(np.uint8).reshape(-1, 2)
    for t in range(1, per):
        code = np.zeros(len(pcm), np.int32)
        best = np.full(len(pcm), 1 << 30)
        for c in range(16):
            miss = np.abs(np.clip(value + IMA_DIFF[at + c], -32768, 32767) - pcm[:, t])
            code, best = np.where(miss < best, c, code), np.minimum(best, miss)
        value = np.clip(value + IMA_DIFF[at + code], -32768, 32767)
        at = IMA_NEXT[at + code]
        out[:, 4 + (t - 1) // 2] |= (code << (4 * ((t - 1) % 2))).astype(np.uint8)
    return out.tobytes()


def wav(data: bytes, kind: int, rate: int = RATE) -> bytes:
    """A mono WAV file: format, fact and data chunks."""
    bits, align = {PCM: (16, 2), ALAW: (8, 1), MULAW: (8, 1), IMA: (4, BLOCK)}[kind]
    per = 1 + 2 * (BLOCK - 4)
    samples = {PCM: len(data) // 2, IMA: len(data) // BLOCK * per}.get(kind, len(data))
    pace = {PCM: rate * 2, IMA: rate * BLOCK // per}.get(kind, rate)
    more = struct.pack("<HH", 2, per) if kind == IMA else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", kind, 1, rate, pace, align, bits) + more
    body = b"".join(
        (
            b"WAVEfmt ",
            struct.pack("<I", len(fmt)),
            fmt,
            b"fact",
            struct.pack("<II", 4, samples),
            b"data",
            struct.pack("<I", len(data)),
            data,
            b"\0" * (len(data) % 2),
        )
    )
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media: bytes) -> tuple[int, int, int, memoryview] | None:
    """(format, rate, block size, data) of a mono WAV file, else None."""
    view = memoryview(media)
    if len(view) < 12 or view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        return None
    at, fmt = 12, None
    while at + 8 <= len(view):
        (size,) = struct.unpack_from("<I", view, at + 4)
        if view[at : at + 4] == b"fmt " and size >= 16:
            fmt = struct.unpack_from("<HHIIHH", view, at + 8)
        elif view[at : at + 4] == b"data":
            return (fmt[0], fmt[2], fmt[4], view[at + 8 : at + 8 + size]) if fmt and fmt[1] == 1 else None
        at += 8 + size + size % 2
    return None


def decode(media: bytes | None) -> tuple[int, np.ndarray] | None:
    """(rate, PCM samples) of a stored form; None if it is none of PCM, A-law, mu-law or IMA ADPCM."""
    found = unwav(media) if media else None
    if found is None:
        return None
    kind, rate, size, data = found
    raw = np.frombuffer(data, np.uint8)
    if kind in (MULAW, ALAW):
        return rate, (MU if kind == MULAW else A)[raw]
    if kind == PCM:
        return rate, raw[: len(raw) // 2 * 2].view("<i2")
    if kind == IMA and size > 4:
        return rate, ima_decode(raw[: len(raw) // size * size].reshape(-1, size)).ravel()
    return None


def _between(x0, x1, x2, x3):
    """The sample half way from x1 to x2: a four-tap half-band filter in whole numbers."""
    return np.clip((9 * (x1 + x2) - x0 - x3 + 8) >> 4, -32768, 32767)


def double_rate(pcm: np.ndarray) -> np.ndarray:
    """PCM at twice the rate; beyond the ends the end samples are repeated."""
    if not len(pcm):
        return pcm.astype(np.int16)
    x = np.concatenate([pcm[:1], pcm, pcm[-1:], pcm[-1:]]).astype(np.int32)
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1::2] = _between(x[:-3], x[1:-2], x[2:-1], x[3:])
    return out


def halve_rate(pcm: np.ndarray) -> np.ndarray:
    """PCM at half the rate: every second sample of a three-tap low-pass; beyond the ends the end samples are repeated."""
    if not len(pcm):
        return pcm.astype(np.int16)
    x = np.concatenate([pcm[:1], pcm, pcm[-1:]]).astype(np.int32)
    return ((x[:-2:2] + 2 * x[1:-1:2] + x[2::2] + 2) >> 2).astype(np.int16)


def _groups(sizes: list[int]) -> Iterator[slice]:
    """Runs of rows of at most HELD bytes together, or of one row."""
    at = total = 0
    for i, n in enumerate(sizes):
        if i > at and total + n > HELD:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield slice(at, len(sizes))


def _sizes(column: pa.Array) -> list[int]:
    return [len(x.as_buffer()) if x.is_valid else 0 for x in column]


def pcm_form(media: bytes | None, double: bool = False) -> bytes | None:
    """The stored form's audio as a 16-bit PCM file of half (or twice) its rate; None for an unknown form."""
    found = decode(media)
    if found is None:
        return None
    rate, pcm = found
    return wav(double_rate(pcm).tobytes(), PCM, 2 * rate) if double else wav(halve_rate(pcm).tobytes(), PCM, rate // 2)


def transcode(df: DataFrame, key: str, media: str, double: bool = False) -> DataFrame:
    """key and `pcm`, the stored form decoded and resampled to half (or twice) its rate, as a 16-bit PCM file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _groups(_sizes(batch.column(1))):
                part = batch.slice(rows.start, rows.stop - rows.start)
                out = [pcm_form(x.as_py(), double) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["key", "pcm"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(media).cast("binary").alias("media"))
    return rows.mapInArrow(run, f"key {kind}, pcm binary").withColumnRenamed("key", key)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in _groups(_sizes(batch.column(1))):
            part = batch.slice(rows.start, rows.stop - rows.start)
            payloads = [x.as_py() or b"" for x in part.column(1)]
            media = [wav(x + bytes(-len(x) % BLOCK if x else BLOCK), MULAW) for x in payloads]
            columns = [part.column(0), pa.array(map(len, payloads), pa.int64()), pa.array(media, pa.binary()), pa.array(map(pcm_form, media), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_bytes", "media", "pcm"])


def store(df: DataFrame, key: str, payload: str) -> DataFrame:
    """key, n_bytes, `media` (the payload, filled with zero bytes to a positive multiple of 64, as mu-law WAV) and `pcm`
    (what it decodes to at half the rate, as PCM WAV), written to the shared folder."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(payload).cast("binary").alias("payload"))
    return materialize(rows.mapInArrow(_store, f"key {kind}, n_bytes long, media binary, pcm binary").withColumnRenamed("key", key), "media", **PACKED)


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """Per 64-byte block of payloads: mu-law energy, peak and sign changes within it, A-law energy, ADPCM energy."""
    for s in range(0, len(raw), PIECE):
        data = raw[s : s + PIECE].reshape(-1, BLOCK)
        x = MU[data].astype(np.int64)
        law = A[data].astype(np.int64)
        adpcm = ima_decode(data).astype(np.int64)
        energy = lambda v: np.einsum("ij,ij->i", v, v)
        yield np.stack([energy(x), np.abs(x).max(1), ((x[:, 1:] < 0) != (x[:, :-1] < 0)).sum(1), energy(law), energy(adpcm)])


def features(payloads: list[memoryview], resampled: list[np.ndarray]) -> list[str]:
    """Features of payloads (each a positive multiple of 64 bytes) and of their resampled PCM in whole numbers, so that equal bytes agree."""
    sizes = np.array([len(p) for p in payloads])
    found = np.concatenate(list(_pieces(np.frombuffer(b"".join(payloads), np.uint8))), axis=1)
    starts = (np.cumsum(sizes) - sizes) // BLOCK
    sums, peaks = np.add.reduceat(found, starts, axis=1), np.maximum.reduceat(found[1], starts)
    rms = lambda total, n: np.sqrt(total / n).astype(np.int64)
    mu, law = rms(sums[0], sizes), rms(sums[3], sizes)
    ima = rms(sums[4], sizes // BLOCK * (1 + 2 * (BLOCK - 4)))
    wide = [x.astype(np.int64) for x in resampled]
    low = [int(np.sqrt((x * x).sum() / len(x))) for x in wide]
    return [f"mulaw:{a}:{p}:{z};pcm:{r}:{np.abs(x).max()};alaw:{b};adpcm:{c}" for a, p, z, r, x, b, c in zip(mu, peaks, sums[2], low, wide, law, ima, strict=True)]


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for batch in batches:
        for rows in _groups(_sizes(batch.column(2))):
            part = batch.slice(rows.start, rows.stop - rows.start)
            media, pcm = ([x.as_py() for x in part.column(i)] for i in (2, 3))
            payloads = [unwav(x)[3] for x in media]
            columns = [
                part.column(0),
                part.column(1),
                pa.array([len(x) for x in payloads], pa.int64()),
                pa.array([sha(x) for x in payloads]),
                pa.array([zlib.crc32(x[-BLOCK:]) for x in payloads], pa.int64()),
                pa.array([len(x) for x in media], pa.int64()),
                pa.array([sha(x) for x in media]),
                pa.array(features(payloads, [decode(x)[1] for x in pcm])),
                pa.array([len(x) for x in pcm], pa.int64()),
                pa.array([sha(x) for x in pcm]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256"])


def read_back(df: DataFrame, key: str) -> DataFrame:
    """Digests and features of what `store` wrote, from the stored bytes."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
    rows = df.select(F.col(key).alias("key"), "n_bytes", "media", "pcm")
    return rows.mapInArrow(_read_back, schema).withColumnRenamed("key", key)


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's UTF-8 bytes stored as mu-law samples, read back, expanded, decoded and resampled."""
    return read_back(store(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


QUERIES = {"op1_telephony": op1_telephony}
ORACLE: dict[str, str] = {}
