"""Small tables with known results, and properties of the ordered and spatial operators."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.config import GENESIS
from geoloom.functions import columns as C
from geoloom.operators import raster as R
from geoloom.operators import spatial as S
from geoloom.operators.chains import chain_state
from geoloom.operators.timeline import as_of, first_ranked, runs


@pytest.mark.parametrize(
    ("text", "applied", "product", "want"),
    [
        ("03.01", None, None, "apply:0"), ("03.01", True, 0, "apply:0"), ("04.00", None, None, "radiometry_ambiguous"), ("04.00", True, None, "apply:0"),
        ("05.11", False, None, "apply:-1000"), ("05.11", False, 0, "apply:0"), ("03.01", False, -1200, "apply:-1200"), ("x", True, None, "radiometry_ambiguous"),
    ],
)
def test_offset_decision(spark, text, applied, product, want):
    df = spark.createDataFrame([(text, applied, product)], "t string, a boolean, p int")
    assert df.select(C.offset_decision(C.baseline(F.col("t"))[0], F.col("a"), F.col("p"))).first()[0] == want


def test_index_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, None), (float("nan"), 1.0), (3.0, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(C.nd(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.0, 0.5]


def test_storage_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.00025,), (0.00035,), (-1.0,), (9.0,), (None,)], "r double")
    assert [r[0] for r in df.select(C.to_uint16(F.col("r"))).collect()] == [2, 4, 1, 65534, 0]


def test_as_of_strict_and_not(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "b", 1)], "id long, k string, t int")
    right = spark.createDataFrame([("a", 5, 50), ("a", 6, 60), ("b", 2, 20)], "k string, t int, v int")
    assert {r.id: r.v for r in as_of(left, right, ["k"], "t", ["v"]).collect()} == {1: None, 2: 60, 3: None}
    assert {r.id: r.v for r in as_of(left, right, ["k"], "t", ["v"], strict=False).collect()} == {1: 50, 2: 60, 3: None}


def test_runs_and_ranks(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate("xxyxx")], "k string, t int, v string")
    assert len({(r.v, r.run) for r in runs(df, ["k"], ["t"], "v").collect()}) == 3
    assert [r.t for r in first_ranked(df, ["k"], [F.col("t").desc()], 2).orderBy("t").collect()] == [3, 4]


def test_chain_reports_the_first_fault(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    good = [(1, GENESIS, sha("1")), (2, sha("1"), sha("2")), (3, sha("2"), sha("3"))]
    bad = [(1, GENESIS, sha("1")), (2, "?", sha("2")), (3, sha("2"), "?")]
    df = spark.createDataFrame([(c, *r) for c, rows in (("g", good), ("b", bad)) for r in rows], "c string, s int, p string, h string")
    rows = {r.c: r for r in chain_state(df, "c", "s", "p", "h", F.sha2(F.col("s").cast("string"), 256)).collect()}
    assert (rows["g"].first_bad, rows["g"].head) == (None, sha("3")) and (rows["b"].first_bad, rows["b"].problem) == (2, "link")


@settings(max_examples=8, deadline=None)
@given(st.sets(st.tuples(st.integers(-3, 6), st.integers(-3, 6)), max_size=40))
def test_components_and_morphology(spark, cells):
    if not cells:
        return
    df = spark.createDataFrame(sorted(cells), "r int, c int")
    want, left = [], set(cells)
    while left:
        todo, part = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            part.add((r, c))
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.discard(n)
                    todo.append(n)
        want.append(frozenset(part))
    got = {}
    for x in R.components(df).collect():
        got.setdefault(x.label, set()).add((x.r, x.c))
    assert {frozenset(v) for v in got.values()} == set(want)
    eroded = {(x.r, x.c) for x in R.erode(df, R.CROSS).collect()}
    assert eroded == {(r, c) for r, c in cells if {(r + a, c + b) for a, b, _ in R.CROSS} <= cells}
    opened = {(x.r, x.c) for x in R.dilate(R.erode(df, R.CROSS), R.CROSS).collect()}
    assert opened <= cells


def test_spatial_joins_against_all_pairs(spark):
    points = [(i, i * 7919 % 1000, i * 104729 % 1000) for i in range(80)]
    others = [(i, i * 6151 % 1000, i * 49157 % 1000) for i in range(60)]
    p, o = spark.createDataFrame(points, "id int, x int, y int"), spark.createDataFrame(others, "oid int, ox int, oy int")
    got = {(r.id, r.oid) for r in S.within(p, o, 90).collect()}
    assert got == {(a, b) for a, x, y in points for b, u, v in others if (x - u) ** 2 + (y - v) ** 2 <= 8100}
    boxes = spark.createDataFrame([(i, x, y, x + 70, y + 130) for i, x, y in others], "box int, x0 int, y0 int, x1 int, y1 int")
    got = {(r.id, r.box) for r in S.in_boxes(p, boxes, 50).collect()}
    assert got == {(a, b) for a, x, y in points for b, u, v in others if u <= x <= u + 70 and v <= y <= v + 130}


def test_degrees_and_metres_are_inverse(spark):
    from geoloom.operators import grid as K

    places = [(lon, lat) for lon in (78.0, 80.5, 81.0, 81.47, 84.0) for lat in (-40.0, 0.0, 20.65, 25.4, 70.0)]
    df = spark.createDataFrame(places, "lon double, lat double")
    east, north = K.utm44(F.col("lon"), F.col("lat"))
    back = df.select("lon", "lat", *[c.alias(n) for n, c in zip(("lon2", "lat2"), K.lonlat44(east, north))]).collect()
    assert all(abs(r.lon - r.lon2) < 1e-9 and abs(r.lat - r.lat2) < 1e-9 for r in back)


def test_reprojection_takes_the_source_cell_of_each_centre(spark):
    from geoloom.operators import geometry as G
    from geoloom.operators import grid as K

    source, target = G.Grid(81.47, 20.65, 0.001, 30, 30), G.Grid(548900.0, 2283500.0, 90.0, 12, 40)
    cells = spark.createDataFrame([(1, r, c, float(100 * r + c)) for r in range(30) for c in range(30)], "obs int, r int, c int, v double")
    got = {(r.r, r.c): r.v for r in G.reproject(cells, source, target).collect()}
    ramp = {(r.r, r.c): r.v for r in G.reproject(cells, source, target, True).collect()}
    at = spark.createDataFrame([(r, c) for r in range(12) for c in range(40)], "r int, c int")
    lon, lat = K.lonlat44(548900.0 + (F.col("c") + 0.5) * 90, 2283500.0 - (F.col("r") + 0.5) * 90)
    for p in at.select("r", "c", ((lon - 81.47) / 0.001).alias("x"), ((20.65 - lat) / 0.001).alias("y")).collect():
        inside = 0 <= p.x < 30 and 0 <= p.y < 30
        assert got[p.r, p.c] == (100 * int(p.y) + int(p.x) if inside else 0)
        if 0.5 <= p.x <= 29.5 and 0.5 <= p.y <= 29.5:
            assert abs(ramp[p.r, p.c] - (100 * (p.y - 0.5) + p.x - 0.5)) < 1e-6  # a plane stays a plane
    assert len(got) == len(ramp) == 480 and 0 in got.values()


def test_components_across_blocks(spark):
    from geoloom.operators import raster as R

    cells = {(r, 255) for r in range(-3, 700)} | {(699, c) for c in range(255, 900)} | {(0, 256), (5, 300), (5, 301), (-1, -1), (-1, 0)} | {(r, 600) for r in range(500, 530)}
    df = spark.createDataFrame([(r, c) for r, c in cells] + [(5, 300)], "r int, c int")
    got = {}
    for x in R.components(df).collect():
        got.setdefault(x.label, set()).add((x.r, x.c))
    left, want = set(cells), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            own.add((r, c))
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.discard(n)
                    todo.append(n)
        want.append(own)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert all(label == min(r * (1 << 20) + c for r, c in own) for label, own in got.items())
    assert R.components(df.limit(0)).count() == 0


def test_grid_joins_are_not_broadcast_and_compare_places(spark):
    """Rows that a grid multiplies are never broadcast by their size before that, and copies of a place count once in what is met."""
    rng = random.Random(5)
    places = [(rng.randrange(400), rng.randrange(400)) for _ in range(120)]
    rows = [(i, *places[i % 120], rng.randrange(-50, 50)) for i in range(360)]
    points = spark.createDataFrame(rows, "id long, x long, y long, v long")
    layer = [(i, rng.randrange(400), rng.randrange(400), i % 7) for i in range(40)] + [(100 + i, *places[i], 8) for i in range(3)] + [(200 + i, *places[0], 9) for i in range(3)]
    others = spark.createDataFrame(layer, "oid long, ox long, oy long, kind long")
    near, sums = S.nearest_within(points.select("id", "x", "y"), others, 48), S.sums_within(points, 96, 8)
    for out in (near, sums):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan
    want = {}
    for i, x, y, _ in rows:
        met = [((x - a) ** 2 + (y - b) ** 2, o, k) for o, a, b, k in layer if (x - a) ** 2 + (y - b) ** 2 <= 48 * 48]
        if met:
            want[i] = min(met)
    assert {r.id: (r.d2, r.oid, r.kind) for r in near.collect()} == want and 0 < len(want) < 360
    for r in sums.collect():
        _, x, y, v = rows[r.id]
        met = [w for _, a, b, w in rows if (x - a) ** 2 + (y - b) ** 2 <= 96 * 96]
        assert (r.v, r.n, r.total, r.squares) == (v, len(met), sum(met), sum(w * w for w in met))


def test_many_first_rows_are_ranked_in_each_partition_first(spark):
    """Above GROUP_LIMIT rows Spark has no group limit, so a group went to one task whole."""
    df = spark.range(20000, numPartitions=8).select("id", (F.col("id") % 2).alias("g"), F.xxhash64("id").alias("h"))
    out = first_ranked(df, ["g"], [F.col("h"), F.col("id")], 1500)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and "SPARK_PARTITION_ID" in plan.upper() and out.columns == df.columns
    got = {(r.g, r.id) for r in out.collect()}
    rows = df.collect()
    assert got == {(g, i) for g in (0, 1) for _, i in sorted((r.h, r.id) for r in rows if r.g == g)[:1500]}
