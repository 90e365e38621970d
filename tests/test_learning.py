"""Boosted trees, calibration and invariant-pixel lines against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import boosting as B
from geoloom.operators import calibration as K
from geoloom.operators import normalise as N
from geoloom.plans import learning


def grown(model, x, label, weight, rounds, depth, bins_of, rate, l2, least):
    """The same trees by a plain loop over nodes, features and bins."""
    bins, k = model.bins(x), model.classes
    raw, out, one = np.zeros((len(x), k)), [], float(1 << B.SHIFT)
    for _ in range(rounds):
        g, h = B.gradients(raw, label, weight)
        trees = []
        for c in range(k):
            tree = B.Tree.blank(depth)
            todo = [(0, np.arange(len(x)), 0)]
            while todo:
                node, rows, level = todo.pop()
                gs, hs = int(g[rows, c].sum()), int(h[rows, c].sum())
                tree.value[node] = -rate * (gs / one) / (hs / one + l2)
                best = None
                for f in range(x.shape[1]) if level < depth else ():
                    for b in range(bins_of - 1):
                        low = rows[bins[rows, f] <= b]
                        if b not in bins[rows, f] or len(low) < least or len(rows) - len(low) < least:
                            continue
                        gl, hl = int(g[low, c].sum()), int(h[low, c].sum())
                        score = lambda a, d: (a / one) * (a / one) / (d / one + l2)
                        gain = score(gl, hl) + score(gs - gl, hs - hl) - score(gs, hs)
                        if gain > 0 and (best is None or (gain, -f, -b) > best):
                            best = (gain, -f, -b)
                if best:
                    f, b = -best[1], -best[2]
                    tree.feature[node], tree.bin[node] = f, b
                    right = bins[rows, f] > b
                    todo += [(2 * node + 1, rows[~right], level + 1), (2 * node + 2, rows[right], level + 1)]
            trees.append(tree)
        raw = raw + np.stack([t.value[t.nodes(bins)] for t in trees], axis=1)
        out.append(trees)
    return out


def test_boosting_grows_the_trees_of_a_plain_fit(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(600, 3)), 3)
    label = (x[:, 0] > 0.3).astype(int) + (x[:, 1] + x[:, 2] / 4 > 0.2)
    weight = np.where(label == 1, 1.5, 0.75)
    rows = [(i, [float(a) for a in v], int(y), float(w)) for i, (v, y, w) in enumerate(zip(x, label, weight))]
    rows += [(9000, None, 1, 1.0), (9001, [1.0, None, 2.0], 1, 1.0), (9002, [0.0, 0.0, 0.0], None, 1.0)]
    df = spark.createDataFrame(rows, "id int, features array<double>, label int, weight double").repartition(3)
    model = B.fit(df, 3, rounds=3, depth=2, bins=8, rate=0.3, least=10)
    want = grown(model, x, label, weight, 3, 2, 8, 0.3, 1.0, 10)
    for got, own in zip(model.trees, want, strict=True):
        for a, b in zip(got, own, strict=True):
            assert a.feature.tolist() == b.feature.tolist() and a.bin.tolist() == b.bin.tolist() and np.allclose(a.value, b.value, atol=1e-12)
    judged = B.predict(df.withColumnRenamed("weight", "a.b"), model).collect()
    raw = model.raw(model.bins(x))
    for r in judged:
        if r.id < 9000:
            assert r.predicted == raw[r.id].argmax() and abs(sum(r.p) - 1) < 1e-12
    assert {r.id for r in judged if r.predicted is None} == {9000, 9001}
    assert sum(r.predicted == r.label for r in judged if r.id < 9000) > 400


def test_sums_by_place_are_exact():
    at, big = np.array([0, 2, 2, 0]), np.array([1 << 52, (1 << 52) + 1, 1 << 52, -3])
    assert B.added(at, big, 3).tolist() == [(1 << 52) - 3, 0, (1 << 53) + 1]
    assert B.added(at, np.array([1, 2, 3, -4]), 4).tolist() == [-3, 0, 5, 0]


def test_boosting_without_rows(spark):
    empty = spark.createDataFrame([], "features array<double>, label int, weight double")
    assert B.fit(empty, 3, rounds=2).trees == []


def test_evaluation(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 1), (2, None), (None, 1)]
    rows = B.evaluation(spark.createDataFrame(pairs, "a int, b int"), F.col("a"), F.col("b")).collect()
    assert {(r.label, r.predicted, r.n) for r in rows} == {(0, 0, 5), (0, 1, 2), (1, 1, 3), (2, 1, 1)}
    assert all(r.accuracy == 8 / 11 and abs(r.macro_f1 - (10 / 12 + 6 / 9 + 0) / 3) < 1e-12 for r in rows)


def test_land_cover_is_learned_on_other_blocks(spark):
    rows = learning.land_cover_boosted(spark, "/root/testdata/sf0.01").collect()
    of = {}
    for r in rows:
        of[r.label] = of.get(r.label, 0) + r.n
    commonest = max(of.values()) / sum(of.values())
    assert rows[0].accuracy > commonest + 0.1 and rows[0].macro_f1 > 0.5 and set(of) <= set(range(5))


def newton(x, y, steps=30):
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    return beta


def test_calibration_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.4 + x @ [1.2, -0.7])))).astype(int)
    df = spark.createDataFrame([(int(b), float(u), float(v)) for b, (u, v) in zip(y, x)] + [(None, 1.0, 1.0), (1, None, 1.0)], "y int, u double, v double")
    fit = K.fit(df, "y", ["u", "v"])
    assert np.allclose([fit.intercept, *fit.coefficients], newton(x, y), atol=1e-6) and fit.labels == 500
    row = df.limit(1).select("u", "v", fit.probability().alias("p"), *[fit.contribution(c).alias(f"c_{c}") for c in "uv"]).first()
    assert abs(np.log(row.p / (1 - row.p)) - (fit.intercept + row.c_u + row.c_v)) < 1e-9


def test_no_probability_below_two_hundred_labels(spark):
    df = spark.createDataFrame([(i % 2, float(i % 7)) for i in range(199)], "y int, u double")
    fit = K.fit(df, "y", ["u"])
    assert not fit.shown and df.select(fit.probability().alias("p")).where("p IS NOT NULL").count() == 0
    assert K.fit(df.limit(0), "y", ["u"]).labels == 0
    levels = df.limit(4).select(F.explode(F.array(*map(F.lit, (0.39, 0.4, 0.69, 0.7)))).alias("p")).select("p", K.level(F.col("p"), F.lit(True)).alias("a"), K.level(F.col("p"), F.lit(False)).alias("b")).distinct().collect()
    assert {(r.p, r.a, r.b) for r in levels} == {(0.39, "LOW", "LOW"), (0.4, "MEDIUM", "MEDIUM"), (0.69, "MEDIUM", "MEDIUM"), (0.7, "HIGH", "MEDIUM")}


@pytest.mark.parametrize("seed", range(3))
def test_median_slope_of_listed_pairs(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 30, 80) / 7, rng.integers(0, 20, 80) / 3
    slopes = [(x[j] - x[i]) / (y[j] - y[i]) for i in range(80) for j in range(80) if y[j] > y[i]]
    assert abs(N.median_slope(x, y) - np.median(slopes)) < 1e-12
    assert np.isnan(N.median_slope(x[:5], np.ones(5)))


def test_a_round_reads_the_rows_once_a_level_of_splits(spark, monkeypatch):
    """The last level's sums are those of the splits above it, and rows lie packed, not one by one."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 2))
    df = spark.createDataFrame([([float(a) for a in v], int(v[0] > 0) + int(v[1] > 0), 1.0) for v in x], "features array<double>, label int, weight double").repartition(2)
    passes, sizes, split, write = [], [], B._splits, B.written
    monkeypatch.setattr(B, "_splits", lambda *a: passes.append(1) or split(*a))
    monkeypatch.setattr(B, "written", lambda *a: (out := write(*a), sizes.append(out.count()))[0])
    model = B.fit(df, 3, rounds=2, depth=2, bins=8)
    assert len(model.trees) == 2 and len(passes) == 4 and max(sizes) <= 10
    leaves = {int(n) for t in model.trees[0] for n in t.nodes(model.bins(x))}
    assert max(leaves) >= 3 and all(t.value[n] != 0 for t in model.trees[0] for n in np.unique(t.nodes(model.bins(x))))
