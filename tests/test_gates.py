"""Object measures and gates against plain Python."""

import random

from pyspark.sql import functions as F

from geoloom.operators import gates as G


def depth(cells, r, c, most):
    for k in range(1, most):
        if any((r + i, c + j) not in cells for i in range(-k, k + 1) for j in range(-k, k + 1)):
            return k
    return most


def test_inner_distance(spark):
    rng = random.Random(1)
    objects = {1: {(r, c) for r in range(9) for c in range(12)} - {(4, 5)}, 2: {(0, c) for c in range(20)}, 3: {(rng.randint(0, 8), rng.randint(0, 8)) for _ in range(60)}, 4: {(-5, -5)}}
    df = spark.createDataFrame([(k, r, c) for k, cells in objects.items() for r, c in cells] + [(4, -5, -5)], "label int, r int, c int")
    for most in (1, 2, 4):
        got = {(x.label, x.r, x.c): x.d for x in G.inner_distance(df, most).collect()}
        assert got == {(k, r, c): depth(cells, r, c, most) for k, cells in objects.items() for r, c in cells}
    assert G.inner_distance(df.limit(0), 3).count() == 0


def objects(spark, *changes):
    good = {"type": "default", "n": 30, "width": 3, "elongation": 1.0, "usable_share": 0.9, "edge_share": 0.1, "seasonal_share": 0.5, "post_share": 0.9, "gain": 1.0, "rmse": 0.01}
    rows = [{**good, **c, "label": i} for i, c in enumerate(changes)]
    schema = "label int, type string, n int, width int, elongation double, usable_share double, edge_share double, seasonal_share double, post_share double, gain double, rmse double"
    return spark.createDataFrame([tuple(r[x.split()[0]] for x in schema.split(", ")) for r in rows], schema)


def test_rules_of_each_gate(spark):
    cases = [
        ({}, None), ({"usable_share": 0.79}, "G1"), ({"width": 1, "edge_share": 0.6}, "G2"), ({"width": 1, "edge_share": 0.59}, None), ({"width": 3, "edge_share": 1.0}, None),
        ({"rmse": 0.041}, "G3"), ({"gain": 0.79}, "G3"), ({"gain": 1.25}, None), ({"gain": None}, "G3"), ({"type": "water_expansion", "seasonal_share": 0.95}, "G4"),
        ({"seasonal_share": 1.0}, None), ({"type": "water_contraction", "n": 19}, "G5"), ({"n": 9}, "G5"), ({"n": 10}, None), ({"type": "road_development", "elongation": 4.9}, "G5"),
        ({"type": "road_development", "elongation": 5.0}, None), ({"post_share": 0.5}, "G6"), ({"usable_share": 0.1, "n": 1}, "G1"),
    ]
    judged = G.judged(objects(spark, *[c for c, _ in cases])).orderBy("label").collect()
    assert [r.reason for r in judged] == [g for _, g in cases]


def test_funnel_and_leaving_one_gate_out(spark):
    rows = G.funnel(G.judged(objects(spark, {}, {}, {"n": 1}, {"usable_share": 0.0}, {"usable_share": 0.0, "post_share": 0.0}))).collect()
    assert [(r.gate, r.n_in, r.n_out, r.without) for r in rows] == [("G1", 5, 3, 1), ("G2", 3, 3, 0), ("G3", 3, 3, 0), ("G4", 3, 3, 0), ("G5", 3, 2, 1), ("G6", 2, 2, 0)]
    none = G.funnel(G.judged(objects(spark, {}).where(F.lit(False)))).collect()
    assert len(none) == 6 and not any(r.n_in for r in none)


def test_elongation(spark):
    df = spark.createDataFrame([(1, 0, c, True, False, False, True) for c in range(10)] + [(2, r, c, True, False, False, True) for r in range(4) for c in range(4)], "label int, r int, c int, usable boolean, edge boolean, seasonal boolean, post boolean")
    got = {r.label: r for r in G.measures(df).collect()}
    assert abs(got[1].elongation - 10) < 1e-9 and abs(got[2].elongation - 1) < 1e-9 and got[1].width == 1 and got[2].width == 3 and got[2].n == 16
