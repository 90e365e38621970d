import hashlib
import zlib

import numpy as np
from cases import ODD, odd

from geoloom.llm import telephony as T


def test_tables_follow_g711():
    mu, a = T.mulaw_table(), T.alaw_table()
    assert (mu[0], mu[0x7F], mu[0xFF], mu[0x80]) == (-32124, 0, 0, 32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(a.tolist())) == 256


def _slow_ima(block):
    value, index, out = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = T.IMA_STEPS[index]
            diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + T.IMA_INDEX[code & 7]))
            out.append(value)
    return out


def test_adpcm_across_blocks_equals_one_by_one():
    blocks = np.random.default_rng(1).integers(0, 256, (40, 64), dtype=np.uint8)
    assert T.ima_decode(blocks).tolist() == [_slow_ima(bytes(b)) for b in blocks]


def test_adpcm_round_trip_is_close():
    tone = (8000 * np.sin(np.arange(1210) / 9)).astype(np.int16)
    rate, back = T.decode(T.wav(T.ima_encode(tone), T.IMA))
    assert rate == 8000 and np.abs(back[: len(tone)].astype(int) - tone).mean() < 400


def _slow_feature(raw):
    x = T.MU[np.frombuffer(raw, np.uint8)].astype(np.int64)
    ends = [x[0], *x.tolist(), x[-1]]
    low = np.array([(ends[i] + 2 * ends[i + 1] + ends[i + 2] + 2) // 4 for i in range(0, len(x), 2)])
    law = T.A[np.frombuffer(raw, np.uint8)].astype(np.int64)
    ima = np.array([_slow_ima(raw[i : i + 64]) for i in range(0, len(raw), 64)], np.int64)
    rms = lambda v: int(np.sqrt((v * v).sum() / v.size))
    change = sum(int(((b[:-1] < 0) != (b[1:] < 0)).sum()) for b in x.reshape(-1, 64))
    return f"mulaw:{rms(x)}:{abs(x).max()}:{change};pcm:{rms(low)}:{abs(low).max()};alaw:{rms(law)};adpcm:{rms(ima)}"


def test_features_do_not_depend_on_batches_or_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    payloads = [rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 7, 2, 30, 1)]
    want = [_slow_feature(p) for p in payloads]
    for piece in (64, 128, 640, 1 << 18):
        monkeypatch.setattr(T, "PIECE", piece)
        assert T.features(payloads, [T.decode(T.pcm_form(T.wav(p, T.MULAW)))[1] for p in payloads]) == want


def _row(i, text):
    data = (text or "").encode()
    padded = data + bytes(-len(data) % 64 if data else 64)
    media = T.wav(padded, T.MULAW)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    pcm = T.pcm_form(media)
    return (i, len(data), len(padded), sha(padded), zlib.crc32(padded[-64:]), len(media), sha(media), _slow_feature(padded), len(pcm), sha(pcm))


def test_store_and_read_back(spark):
    rows = T.read_back(T.store(odd(spark), "doc_id", "text"), "doc_id").collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(map(tuple, rows), key=key) == sorted((_row(*x) for x in ODD), key=key)
    assert T.read_back(T.store(odd(spark, []), "doc_id", "text"), "doc_id").count() == 0


def test_rows_are_held_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(T, "HELD", 64)
    assert [(x.start, x.stop) for x in T._groups([10, 60, 4, 500, 0, 0])] == [(0, 1), (1, 3), (3, 4), (4, 6)]
    assert list(T._groups([])) == []


def test_query_against_plain_python(spark, sf_small):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert sorted(map(tuple, T.op1_telephony(spark, sf_small).collect())) == sorted(_row(*x) for x in texts)


def test_transcode(spark):
    stored = T.store(odd(spark), "doc_id", "text")
    for double, want in ((True, 16000), (False, 4000)):
        for r in T.transcode(stored, "doc_id", "media", double).join(stored.select("doc_id", "pcm").withColumnRenamed("pcm", "of"), "doc_id").collect():
            rate, pcm = T.decode(bytes(r.pcm))
            assert rate == want and (double or bytes(r.of) == bytes(r.pcm))
    broken = spark.createDataFrame([(1, b"no wav"), (2, None)], "doc_id long, media binary")
    assert [r.pcm for r in T.transcode(broken, "doc_id", "media").collect()] == [None, None]
