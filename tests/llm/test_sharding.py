import zlib
from collections import Counter, defaultdict

from cases import ODD, odd

from geoloom.llm import sharding as S


def _check(rows, n, tolerance=None):
    assert len(rows) == n
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    for got in slots.values():
        assert sorted(got) == list(range(len(got)))
    assert set(slots) <= set(range(24))
    if tolerance:
        mean = sum(sizes.values()) / 24
        assert len(sizes) == 24 and max(abs(v / mean - 1) for v in sizes.values()) < tolerance
    return slots


def _run(spark, df, tmp_path):
    df.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return S.op2_sharding(spark, str(tmp_path)).collect()


def test_odd_rows(spark, tmp_path):
    rows = _run(spark, odd(spark), tmp_path)
    _check(rows, len(ODD))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ODD)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert _run(spark, odd(spark, []), tmp_path) == []


def test_sizes_are_near_equal_with_a_hot_text(spark, tmp_path):
    texts = [(i, "copy " * 40) if i % 3 == 0 else (i, f"text {i} " * (i % 50 + 1)) for i in range(20000)]
    rows = _run(spark, odd(spark, texts), tmp_path)
    _check(rows, len(texts), 0.05)


def test_small_groups_stay_together(spark, tmp_path):
    texts = [(i, f"text {i // 4} " * (i // 4 % 30 + 1)) for i in range(12000)]
    rows = _run(spark, odd(spark, texts), tmp_path)
    _check(rows, len(texts), 0.05)
    places = defaultdict(set)
    for r in rows:
        places[r.doc_id // 4].add(r.shard)
    assert all(len(p) == 1 for p in places.values())


def test_repeatable(spark, sf_small):
    a = {(r.doc_id, r.shard, r.slot) for r in S.op2_sharding(spark, sf_small).collect()}
    assert a == {(r.doc_id, r.shard, r.slot) for r in S.op2_sharding(spark, sf_small).collect()}


def test_hot_texts_without_ids_or_with_one_id(spark, tmp_path):
    for name, hot in (("null", None), ("one", 7)):
        texts = [(hot, "copy " * 40) if i % 3 == 0 else (i, f"text {i} " * (i % 50 + 1)) for i in range(20000)]
        rows = _run(spark, odd(spark, texts), tmp_path / name)
        _check(rows, len(texts), 0.05)
        assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
