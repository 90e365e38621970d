import hashlib
from collections import defaultdict

import numpy as np
import pytest
from cases import ODD, odd

from geoloom.llm import suffixes as S


def _slow(texts, length):
    seen = defaultdict(int)
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] += 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        gone[-1] = False
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _texts(seed, n=60):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdé"), rng.integers(1, 6)))
    passages = [" ".join(word() for _ in range(k)) for k in (12, 30, 80, 150)]
    out = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.integers(5, 60)))]
        for _ in range(rng.integers(0, 3)):
            parts += [passages[rng.integers(0, 4)], " ".join(word() for _ in range(rng.integers(0, 20)))]
        out.append(" ".join(parts))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_two_stage_sort_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    text = np.concatenate([rng.integers(0, 3 if seed else 200, 700), [0]]).astype(np.uint8)
    depth = 40
    words = S.packed(text, depth)
    order = S.two_stage(text, np.ones(len(text), bool), words, depth)
    raw = bytes(text) + bytes(depth)
    assert sorted(order.tolist()) == list(range(len(text)))
    keys = [raw[i : i + depth] for i in order.tolist()]
    assert keys == sorted(keys)
    want = [next((k for k in range(depth) if a[k] != b[k]), depth) for a, b in zip(keys, keys[1:])]
    assert S.common_prefixes(words, order, depth).tolist() == want


def test_direct_sort_of_much_that_is_equal():
    rng = np.random.default_rng(7)
    block = rng.integers(0, 2, 300).astype(np.uint8)
    text = np.concatenate([np.concatenate([block[rng.integers(0, 80) :], rng.integers(0, 3, 20)]) for _ in range(60)] + [[0]]).astype(np.uint8)
    raw = bytes(text) + bytes(216)
    order = S.two_stage(text, np.ones(len(text), bool), S.packed(text))
    keys = [raw[i : i + 200] for i in order.tolist()]
    assert keys == sorted(keys)


def test_partial_sort_keeps_the_order():
    text = np.concatenate([np.random.default_rng(9).integers(0, 4, 900), [0]]).astype(np.uint8)
    wanted = np.random.default_rng(1).random(901) < 0.3
    raw = bytes(text) + bytes(40)
    order = S.two_stage(text, wanted, S.packed(text, 40), 40)
    keys = [raw[i : i + 40] for i in order[wanted[order]].tolist()]
    assert keys == sorted(keys) and len(keys) == wanted.sum()


def test_segments_cover_every_window_once():
    parts = [bytes(np.random.default_rng(k).integers(0, 256, n, dtype=np.uint8)) for k, n in enumerate((199, 200, 1000, 0, 5000))] + [b"a" * 3000]
    part, first, n, key = S.segments(parts)
    for p, data in enumerate(parts):
        got = [i for a, k in zip(first[part == p], n[part == p]) for i in range(a, a + k)]
        assert got == list(range(max(0, len(data) - 199)))
    assert n.max() <= 169


def test_prefixes_of_any_difference():
    for k in range(8):
        for low in (0x00, 0x01, 0x7F, 0xFF):
            a, b = bytes([9] * k + [1] + [0] * (15 - k)), bytes([9] * k + [low if low != 1 else 2] + [255] * (15 - k))
            text = np.frombuffer(a + b"\0" + b + b"\0", np.uint8)
            assert S.common_prefixes(S.packed(text, 16), np.array([0, 17]), 16).tolist() == [k]


def test_passage_with_ever_other_neighbours(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 3)
    monkeypatch.setattr(S, "VAST", 20)
    rng = np.random.default_rng(4)
    rand = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    passage = rand(203)
    texts = [rand(int(rng.integers(150, 400))) + passage[i % 3 :] + rand(int(rng.integers(150, 400))) for i in range(90)]
    rows = S.repeats(odd(spark, list(enumerate(texts)))).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert [got[i] for i in range(len(texts))] == _slow(texts, 200) and all(got[i][1] >= 200 for i in got)


@pytest.mark.parametrize(("seed", "hot", "vast"), [(1, 512, 1 << 16), (2, 2, 1 << 16), (3, 512, 1 << 16), (1, 2, 4)])
def test_against_all_windows(spark, seed, hot, vast, monkeypatch):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "VAST", vast)
    monkeypatch.setattr(S, "RUN", 5000)
    texts = _texts(seed)
    texts += texts[:5] + ["one line that comes again\n" * 30, "ab" * 200, "x" * 900, None, ""]
    length, gram = (50, 8) if seed < 3 else (200, 32)
    rows = S.repeats(odd(spark, list(enumerate(texts))), length=length, gram=gram).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert len(rows) == len(texts) and [got[i] for i in range(len(texts))] == _slow(texts, length)


def test_odd_rows(spark):
    rows = S.repeats(odd(spark)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=key)
    assert got == sorted(((i, *w) for (i, _), w in zip(ODD, _slow([t for _, t in ODD], 200), strict=True)), key=key)
    assert S.repeats(odd(spark, [])).count() == 0


def test_query_against_all_windows(spark, sf_small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    ids = sorted(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.op7_suffixes(spark, sf_small).collect()}
    assert [got[i] for i in ids] == _slow([texts[i] for i in ids], 200)
