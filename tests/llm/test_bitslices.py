import math

import numpy as np
import oracle
import pytest

from geoloom.llm import bitslices as B

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, n int, block string, `group` int, `a.b` int, score int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, "v", 3, "b", 1, 2, 4, 5) for i, v in rows], SCHEMA)


def brute(rows, k=5, every=50):
    whole = [(i, None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows]
    whole = [(i, v) for i, v in whole if v is not None]
    out = []
    for q, w in {(i, tuple(v)) for i, v in whole if i is not None and i % every == 0}:
        scored = [(sum(a * b for a, b in zip(w, v)), i) for i, v in whole if len(v) == len(w) and i != q]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def search(spark, df, k=5):
    got = B.top_k(B.build_index(df, "vec_id", "embedding"), df.where("vec_id % 50 = 0"), k)
    return sorted([(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()], key=str)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25, 0.1]), (1, None), (2, []), (50, []), (3, [0.5, None, 0.1]), (4, [nan, 0.0, 0.0]), (100, [inf, 0.0, 0.0]), (None, [0.5, -0.25, 0.1]), (5, [0.5, -0.25, 0.1]), (5, [0.5, -0.25, 0.1]), (6, [1.0, 2.0]), (150, [1.0, 2.0]), (7, [-3.0, 900.0, 0.001]), (200, [0.0, 0.0, 0.0]), (200, [0.0, 0.0, 0.0]), (250, [0.1, 0.2, 0.3]), (250, [-0.1, 0.2, 0.3])]
    got = search(spark, frame(spark, rows))
    assert got == brute(rows) and len({q for q, *_ in got}) == 5  # 50 meets only 2, which is as short
    assert search(spark, frame(spark, [])) == []
    assert search(spark, frame(spark, rows[:1])) == []


def test_hot_vector_and_outliers(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 200)
    monkeypatch.setattr(B, "QUERIES_AT_ONCE", 3)
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(900, 16)) / 4).astype(np.float32)
    v[::3] = v[0]
    v[5, 2], v[6] = 1e5, 3e4
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    assert search(spark, frame(spark, rows)) == brute(rows)


def test_scores_beyond_a_double(spark):
    rows = [(i, [float(2**18 - i), float(2**18 + 3 * i), -7.0 * i]) for i in range(120)]
    assert search(spark, frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_slices_against_numbers(seed):
    rng = np.random.default_rng(seed)
    n, dim, k = int(rng.integers(1, 400)), int(rng.integers(1, 20)), int(rng.integers(1, 9))
    rows = rng.integers(-(1 << int(rng.integers(1, 12))), 1 << int(rng.integers(1, 12)), (n, dim)).astype(np.int32)
    shifts, slices = B.slices_of(rows)
    block = B.Block(dim, n, np.arange(n).tobytes(), np.ones(n, bool).tobytes(), rows.tobytes(), shifts.tobytes(), slices.tobytes())
    bits = lambda m: np.flatnonzero(np.unpackbits(m.view(np.uint8), bitorder="little"))
    for i in range(dim):
        codes = sum(1 << b for b in range(B.VALUE_BITS) for _ in [0]) and sum((np.isin(np.arange(n), bits(block.slices[i * B.VALUE_BITS + b])) << b) for b in range(B.VALUE_BITS))
        assert (codes == (rows[:, i] >> shifts[i]) + (1 << B.VALUE_BITS - 1)).all()
    for q in range(min(n, 5)):
        w = rows[q].astype(np.int64)
        exact = rows.astype(np.int64) @ w
        exact[q] = np.iinfo(np.int64).min
        want = np.lexsort((np.arange(n), -exact.astype(object)))[: min(k, n - 1)]
        at, score, _ = block.best(q, w, k)
        assert at.tolist() == want.tolist() and score.tolist() == exact[want].tolist()


def test_slice_order_finds_thresholds():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 300, 130)
    slices = [np.packbits(np.pad((values >> b) & 1, (0, 62)).astype(np.uint8), bitorder="little").view(np.uint64) for b in range(9)]
    rows = np.packbits(np.pad(np.ones(130, np.uint8), (0, 62)), bitorder="little").view(np.uint64)
    for k in (1, 5, 64, 130):
        assert B.kth_greatest(slices, rows, k) == np.sort(values)[-k]
    for least in (-3, 0, 1, 150, 299, 300, 5000):
        assert int(np.bitwise_count(B.at_least(slices, rows, least)).sum()) == int((values >= least).sum())


def test_boundary_is_small(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(8000, 64))
    rows = np.floor(256 * rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.int32)
    shifts, slices = B.slices_of(rows)
    block = B.Block(64, 8000, np.arange(8000).tobytes(), np.ones(8000, bool).tobytes(), rows.tobytes(), shifts.tobytes(), slices.tobytes())
    sizes = [block.best(q, rows[q].astype(np.int64), 5)[2] for q in range(20)]
    assert max(sizes) < 1600  # exact scores of less than a fifth of the rows


def test_query_against_sql(spark):
    oracle.compare(spark, B.op13_bitslices, B.OP13, "/root/testdata/sf0.01")


def test_a_block_is_not_repeated_for_each_block_of_queries(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 100)
    monkeypatch.setattr(B, "QUERIES_AT_ONCE", 1)
    monkeypatch.setattr(B, "SHARE", 4)
    rng = np.random.default_rng(4)
    rows = [(i, x.tolist()) for i, x in enumerate((rng.normal(size=(700, 8)) / 4).astype(np.float32))]
    df = frame(spark, rows)
    got = B.top_k(B.build_index(df, "vec_id", "embedding"), df.where("vec_id % 50 = 0"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]  # of the query blocks with the blocks' numbers
    assert "FlatMapCoGroupsInArrow" in plan and len(joins) == 1 and "rightHint=(strategy=broadcast)" in joins[0]
    assert sorted([(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()], key=str) == brute(rows)
