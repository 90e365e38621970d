import hashlib
import math
from collections import Counter

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from geoloom.llm import dualtree as D

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, start string, cluster int, distance int, `a.b` int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, "v", "s", 3, 1, 2) for i, v in rows], SCHEMA)


def brute(rows, k, rounds, dim):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in set(of):
            own = [v for (_, v), o in zip(kept, of) if o == j]
            centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return Counter((i, *reversed(nearest(v))) for i, v in kept), centroids


def run(spark, rows, k, rounds, dim):
    start = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    labels, centroids = D.lloyd(frame(spark, rows), "vec_id", "embedding", start, k, rounds, dim)
    return Counter(tuple(r) for r in labels.select("id", "cluster", "distance").collect()), centroids.tolist()


def test_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25]), (2, None), (3, []), (4, [0.5, None]), (5, [nan, 0.0]), (6, [inf, 0.0]), (None, [0.5, 0.25]), (7, [0.5, -0.25]), (7, [0.5, -0.25]), (8, [1.0, 2.0, 3.0]), (9, [900.0, -3e5]), (10, [0.0, 0.0])]
    for k in (1, 3, 16):
        assert run(spark, rows, k, 3, 2) == brute(rows, k, 3, 2)
    assert run(spark, [], 3, 2, 2) == (Counter(), [])
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert D.op11_dualtree(spark, str(tmp_path)).collect() == []  # none has 64 components


def test_ties_and_equal_centroids(spark):
    rows = [(i, [float(i % 3), float(i % 2)]) for i in range(60)]
    assert run(spark, rows, 16, 3, 2) == brute(rows, 16, 3, 2)


def test_hot_vector_in_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(700, 8)) / 3 + rng.integers(0, 4, (700, 1))).astype(np.float32)
    v[::3] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    monkeypatch.setattr(D, "BLOCK", 90)
    assert run(spark, rows, 7, 3, 8) == brute(rows, 7, 3, 8)


def test_large_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-(2**20), 2**20, 3)]) for i in range(80)]
    assert run(spark, rows, 5, 2, 3) == brute(rows, 5, 2, 3)


@pytest.mark.parametrize("seed", range(5))
def test_cover_tree(seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-40, 40, (int(rng.integers(1, 200)), 3))
    points = np.concatenate([points, points[: len(points) // 3]])
    t = D.CoverTree(points)
    assert sorted(t.order.tolist()) == list(range(len(points)))
    laid = points[t.order]
    for v in range(len(t.low)):
        own = laid[t.low[v] : t.high[v]]
        far = np.sqrt(((own - laid[t.center[v]]) ** 2).sum(axis=1)).max()
        assert far <= t.radius[v] + 1e-9 and (t.children[v] or far == 0)
        kids = range(t.first[v], t.first[v] + t.children[v])
        assert not t.children[v] or [(t.low[k], t.high[k]) for k in kids] == list(zip([t.low[v], *(t.high[k] for k in kids)], [t.high[k] for k in kids]))
        # A node's first child is its own point; the other children are within twice the gap that parts them.
        centres = np.array([laid[t.center[k]] for k in kids]).reshape(-1, 3)
        if len(centres):
            gaps = np.sqrt(D.squared_distances(centres))
            assert (centres[0] == laid[t.center[v]]).all()
            assert gaps[0].max() <= 2 * 2 ** math.ceil(math.log2(gaps[gaps > 0].min())) + 1e-9


def test_pruning_compares_few_pairs():
    rng = np.random.default_rng(6)
    centres = rng.integers(-3000, 3000, (64, 4))
    points = centres[rng.integers(0, 64, 2000)] + rng.integers(-20, 20, (2000, 4))
    tree, _ = D.Nodes.over(points)
    tree_c, numbers = D.Nodes.over(centres)
    cluster, compared = D.assign(tree, tree_c, numbers)
    exact = ((tree.points[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (cluster == exact.argmin(axis=1)).all()
    assert compared < 2000 * 64 / 10


def test_query_against_sql(spark):
    oracle.compare(spark, D.op11_dualtree, D.OP11, "/root/testdata/sf0.01")
