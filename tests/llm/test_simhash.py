import re

import numpy as np
import pyarrow as pa
import xxhash
from cases import ODD, odd

from geoloom.llm import graph
from geoloom.llm import simhash as S


def _slow_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def _slow_components(fps):
    """fps: list of (id, fingerprint); ids are comparable."""
    n, root = len(fps), list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min([x for x in (least.get(find(i)), fps[i][0]) if x is not None], default=None)
    return [least[find(i)] for i in range(n)]


def test_fingerprints():
    for _, text in [*ODD, (0, "A b"), (0, "a\x0bB\x1cc d"), (0, "ÀB c d e")]:
        assert S.fingerprint(text)[0] == _slow_fingerprint(text)


def test_embedding_is_a_lower_bound_and_cells_miss_nothing():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)
    counts = lambda x: np.stack([np.bitwise_count(x >> np.uint64(2 * i) & np.uint64(3)) for i in range(32)]).astype(int)
    manhattan = np.abs(counts(a) - counts(b)).sum(0)
    assert (np.bitwise_count(S.embed(a) ^ S.embed(b)) == manhattan).all() and (manhattan <= np.bitwise_count(a ^ b)).all()
    met = np.zeros(3000, bool)
    for m in S.cell_masks(3):
        met |= (S.embed(a) ^ S.embed(b)) & np.uint64(m) == 0
    assert met.all() and len(S.cell_masks(3)) == 20


def test_components_of_planted_groups(spark):
    rng = np.random.default_rng(6)
    base = [int(x) for x in rng.integers(0, 1 << 62, 60)]
    fps = list(base)
    for x in base[:20]:  # chains and dense groups
        for _ in range(12):
            y = x
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                y ^= 1 << int(bit)
            fps.append(y)
            x = y if rng.random() < 0.4 else x
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    edges = S.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r.node.f0: r.root.f0 for r in graph.components(edges).collect()}
    want = _slow_components(list(zip(signed, fps, strict=True)))
    assert [got.get(f, f) for f in signed] == want


def test_links_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        fps = [0, 1, 3, 7, 15, 31, 63, 127, 1 << 40, (1 << 40) + 1] + [1 << 20 | 1 << i for i in range(10)]
        edges = S.links(spark.createDataFrame([(f,) for f in fps], "fp long").coalesce(1))
        got = {r.node.f0: r.root.f0 for r in graph.components(edges).collect()}
        assert [got.get(f, f) for f in fps] == _slow_components([(f, f) for f in fps])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_rows(spark):
    rows = S.near_duplicates(odd(spark), "doc_id", "text").collect()
    want = _slow_components([(i, _slow_fingerprint(t)) for i, t in ODD])
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=key) == sorted(zip([i for i, _ in ODD], want, strict=True), key=key)
    assert S.near_duplicates(odd(spark, []), "doc_id", "text").count() == 0
    kept = S.keep_one(odd(spark)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 5, 6] and kept[0].key == "k"


def test_query_against_all_pairs(spark, sf_small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    fps = [(i, _slow_fingerprint(t)) for i, t in sorted(texts.items())]
    want = dict(zip([i for i, _ in fps], _slow_components(fps), strict=True))
    for r in S.op6_simhash(spark, sf_small).collect():
        assert r.fingerprint == f"{_slow_fingerprint(texts[r.doc_id]):016x}" and r.component_id == want[r.doc_id]


def test_similar_texts(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    docs, want = [], {}
    for g in range(40):
        base = [word() for _ in range(300)]
        docs.append((100 * g, " ".join(base)))
        for k in range(1, 6):
            text = list(base)
            for at in rng.choice(300, 3, replace=False):  # 15 of 296 shingles at most: a similarity of 0.9 or more
                text[at] = word()
            docs.append((100 * g + k, " ".join(text)))
        want[100 * g] = 1
        half = base[:150] + [word() for _ in range(150)]
        docs.append((100 * g + 50, " ".join(half)))
        want[100 * g + 50] = 1
    kept = {r.doc_id for r in S.keep_one(odd(spark, docs)).collect()}
    assert set(want) <= kept and len(kept) <= len(want) + 2


def test_small_and_large_cells_agree(spark, monkeypatch):
    fps = [(int(x) ^ (1 << int(b))) & ((1 << 63) - 1) for x in (0, 12345678901234567) for b in range(40)]
    frame = spark.createDataFrame([(f,) for f in sorted(set(fps))], "fp long")
    want = {(r.node, r.root) for r in graph.components(S.links(frame)).collect()}
    monkeypatch.setattr(S, "SMALL", 1000)
    assert {(r.node, r.root) for r in graph.components(S.links(frame)).collect()} == want


def _slow_sets(texts, k=5):
    out = []
    for t in texts:
        words = t.lower().split()
        out.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)})
    return out


def test_all_pairs_of_the_least_similarity_and_no_others(spark):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts = []
    for g in range(300):  # pairs of a similarity from 0.65 to 0.95, most near the bound
        base = [word() for _ in range(200)]
        other = list(base)
        for at in range(0, 5 * (1 + g % 8), 5):
            other[at + 7] = word()
        texts += [" ".join(base), " ".join(other)]
    sets = _slow_sets(texts)
    like = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 600, 2)]
    assert sum(0.78 < x < 0.82 for x in like) >= 30 and sum(x < 0.8 for x in like) >= 60
    kept = {r.doc_id for r in S.keep_one(odd(spark, list(enumerate(texts)))).collect()}
    assert kept == set(range(600)) - {2 * i + 1 for i, x in enumerate(like) if x >= 0.8}


def test_large_cells_are_compared_to_the_end(spark):
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base, texts = [word() for _ in range(200)], []
    for _ in range(3):  # groups that share most of a text, and copies within a group
        own = base[:165] + [word() for _ in range(35)]
        for _ in range(30):
            text = list(own)
            text[int(rng.integers(0, 160))] = word()
            texts.append(" ".join(text))
    sets = _slow_sets(texts)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    kept = {r.doc_id for r in S.keep_one(odd(spark, list(enumerate(texts)))).collect()}
    assert kept == set(root) and 1 < len(kept) < 10


def test_rows_are_told_apart_by_id_and_text(spark):
    text = lambda k: " ".join(f"{k}word{i}" for i in range(30))
    docs = [(None, text(k)) for k in "abcdef"] + [(9, text("g")), (9, text("h")), (None, text("h")), (3, text("a")), (9, text("g"))]
    kept = [(r.doc_id, r.text) for r in S.keep_one(odd(spark, docs)).collect()]
    want = [(None, text(k)) for k in "bcdef"] + [(9, text("g")), (9, text("h")), (3, text("a"))]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_the_grid_meets_near_copies_before_the_bands(spark, monkeypatch):
    """Copies whose fingerprints are within the bound are linked by the grid alone; what it does not meet is left to the bands."""
    rng = np.random.default_rng(13)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(900)]
        texts += [" ".join(base), " ".join([*base[:-1], word()])]
    near = [S.sketch(S.shingles(t))[0][0] for t in texts]
    close = {i for i in range(0, 24, 2) if (near[i] ^ near[i + 1]) % (1 << 64) in {0} or bin((near[i] ^ near[i + 1]) % (1 << 64)).count("1") <= S.BITS}
    assert close
    met, keep = [], S.links
    monkeypatch.setattr(S, "links", lambda *a, **k: met.append(1) or keep(*a, **k))
    monkeypatch.setattr(S, "_candidates", lambda turn: lambda batches: (pa.RecordBatch.from_pylist([], pa.schema([(c, pa.int64()) for c in ("choice", "cell", "done", "a", "b")])) for b in batches))
    kept = {r.doc_id for r in S.keep_one(odd(spark, list(enumerate(texts)))).collect()}
    assert met and kept == set(range(24)) - {i + 1 for i in close}
