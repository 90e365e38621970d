"""Exhaustive and indexed neighbours against NumPy; the index's recall, and what it reads."""

import numpy as np
import pytest

from geoloom.operators import vectors as V

SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], SCHEMA)


def exact(m, asked, k):
    m = m.astype(np.float32).astype(float)
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    out = set()
    for q in asked:
        s = np.round(unit @ unit[q], 6)
        s[q] = -2
        out |= {(int(q), int(i), r + 1) for r, i in enumerate(np.lexsort((np.arange(len(m)), -s))[:k])}
    return out


def found(df):
    return {(r.query_id, r.vec_id, r["rank"]) for r in df.collect()}


def test_nearest_in_many_blocks(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(5000, 12))
    m[::3] = m[0]  # a third alike
    df = frame(spark, m).repartition(3)
    assert found(V.nearest(df, df.where("vec_id % 500 = 0"), 7)) == exact(m, range(0, 5000, 500), 7)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, []), (5, [0.0, 0.0]), (6, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [0.0, 3.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.query_id, r.vec_id, r.score) for r in V.nearest(df, df.where("vec_id in (0, 1, 2)"), 2).collect()}
    assert got == {(0, 7, 1.0), (0, 5, 0.0)}
    assert V.nearest(df.limit(0), df, 2).collect() == []
    index = V.build_index(df, 2)
    assert {(r.query_id, r.vec_id) for r in index.search(df.where("vec_id = 0"), 2, 2).collect()} == {(0, 7), (0, 5)}
    assert V.build_index(df.limit(0), 4).search(df, 2, 2).collect() == []


@pytest.fixture(scope="module")
def gathered(spark):
    """Vectors that gather around forty directions, a third of them about one."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    own = rng.integers(0, 40, 6000)
    own[::3] = 0
    return centres[own] + rng.normal(size=(6000, 24)) / 3


def test_index_where_vectors_gather(spark, gathered):
    df = frame(spark, gathered)
    index = V.build_index(df, 32)
    assert index.blocks.agg({"n": "sum"}).first()[0] == 6000  # every row
    assert index.blocks.agg({"n": "max"}).first()[0] <= V.BLOCK
    queries = df.where("vec_id % 100 = 1")
    share = V.recall(index.search(queries, 10, 4), V.nearest(df, queries, 10))
    assert share >= 0.9, share
    assert V.recall(index.search(queries, 10, 32), V.nearest(df, queries, 10)) == 1.0


def test_index_of_the_test_vectors(spark):
    """Their directions are even, so twelve of sixteen lists are needed (the query `ivf_knn`)."""
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    queries = v.where("vec_id % 20 = 0")
    assert V.recall(V.build_index(v, 16).search(queries, 10, 12), V.nearest(v, queries, 10)) >= 0.9


def test_search_reads_the_probed_folders_only(spark, gathered):
    df = frame(spark, gathered)
    index = V.build_index(df, 32)
    one = index.search(df.where("vec_id = 1"), 10, 2)
    plan = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [list" in plan.replace("isnotnull(list", "list") or "PartitionFilters: [" in plan and " list#" in plan
    one.collect()
    read = index.blocks.select("list", "n").where("list IN (0, 1)").inputFiles()
    assert len(read) <= len(index.blocks.inputFiles())


def test_blocks_meet_in_bounded_groups(spark, gathered, monkeypatch):
    """No row of a join holds a block of rows and one of queries, nothing of them is broadcast, and the neighbours are the same."""
    for name, n in (("BLOCK", 100), ("ASKED", 4), ("GROUP", 3), ("SHARE", 2), ("PIECE", 3)):
        monkeypatch.setattr(V, name, n)
    m = gathered[:1500]
    df = frame(spark, m)
    queries = df.where("vec_id % 50 = 0")
    near = V.nearest(df, queries, 7)
    index = V.build_index(df, 8).search(queries, 7, 8)
    for out in (near, index):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
        assert found(out.select("query_id", "vec_id", "rank")) == exact(m, range(0, 1500, 50), 7)
