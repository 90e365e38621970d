"""Polygon operators against plain Python on random rings."""

import math
import random

import pytest

from geoloom.operators import polygons as G


def star(rng, n, cx, cy, reach):
    angles = sorted(rng.random() * 2 * math.pi for _ in range(n))
    return [(cx + round(math.cos(a) * rng.randint(reach // 5, reach)), cy + round(math.sin(a) * rng.randint(reach // 5, reach))) for a in angles]


def vertices(spark, rings):
    return spark.createDataFrame([(i, k + 1, x, y) for i, ring in rings.items() for k, (x, y) in enumerate(ring)], "ring int, k int, x long, y long")


def holds(ring, x, y):
    odd = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        if (y0 > y) != (y1 > y):
            side = (x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)
            odd ^= side < 0 if y1 > y0 else side > 0
    return odd


def meet(a, b):
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    for p, q in zip(a, a[1:] + a[:1]):
        for r, s in zip(b, b[1:] + b[:1]):
            boxes = all(max(p[i], q[i]) >= min(r[i], s[i]) and max(r[i], s[i]) >= min(p[i], q[i]) for i in (0, 1))
            if boxes and turn(p, q, r) * turn(p, q, s) <= 0 and turn(r, s, p) * turn(r, s, q) <= 0:
                return True
    return holds(a, *b[0]) or holds(b, *a[0])


@pytest.fixture(scope="module")
def rings():
    rng = random.Random(2)
    found = {i: star(rng, rng.randint(3, 30), rng.randint(-900, 900), rng.randint(-900, 900), 400) for i in range(14)}
    found[20] = [(-2000, -2000), (2000, -2000), (2000, 2000), (-2000, 2000)]  # holds many others
    found[21] = [(3000, 3000), (3001, 3000), (3001, 3001)]  # smaller than a cell
    found[22] = [(0, -3000), (40, -3000), (40, -2500), (0, -2500)]  # its edges run along those of cells
    return found


@pytest.mark.parametrize("size", [50, 1000])
def test_points_in_rings(spark, rings, size):
    rng = random.Random(3)
    points = [(i, rng.randint(-2100, 2100), rng.randint(-2100, 2100)) for i in range(900)]
    points += [(1000 + i, *v) for i, v in enumerate(v for ring in rings.values() for v in ring)] + [(5000, 20, -2700), (5000, 20, -2700), (5001, None, 4)]
    df = spark.createDataFrame(points, "id int, x long, y long")
    got = sorted((r.id, r.ring) for r in G.inside(df.where("x IS NOT NULL"), G.edges_of(vertices(spark, rings)), size).collect())
    want = {(i, n) for i, x, y in points if x is not None for n, ring in rings.items() if holds(ring, x, y)}
    assert set(got) == want
    assert G.inside(df.limit(0), G.edges_of(vertices(spark, rings)), size).count() == 0


def test_rings_that_meet(spark, rings):
    edges = G.edges_of(vertices(spark, rings))
    got = {(r.ring, r.other) for r in G.intersecting(edges, edges, 100).collect() if r.ring != r.other}
    assert got == {(a, b) for a in rings for b in rings if a != b and meet(rings[a], rings[b])}


def test_union_cancels_shared_edges(spark):
    rng = random.Random(4)
    cells = {(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(60)}
    edges = [("g", *e) for r, c in cells for e in ((c, r, c + 1, r), (c + 1, r, c + 1, r + 1), (c + 1, r + 1, c, r + 1), (c, r + 1, c, r))]
    left = G.union_edges(spark.createDataFrame(edges, "g string, x0 long, y0 long, x1 long, y1 long"), "g")
    row = G.area(left, "g").first()
    outer = sum((r + a, c + b) not in cells for r, c in cells for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
    assert row.area == len(cells) and row.perimeter == outer == left.count()


def plain(points, tolerance):
    """Douglas and Peucker's method on a ring: places of the vertices that stay."""
    closed = [*points, points[0]]
    keep, todo = {0}, [(0, len(points))]

    def off(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = 0.0 if dx == dy == 0 else min(max(((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy), 0.0), 1.0)
        return (a[0] + t * dx - p[0]) ** 2 + (a[1] + t * dy - p[1]) ** 2

    while todo:
        lo, hi = todo.pop()
        d = [(off(closed[k], closed[lo], closed[hi]), -k) for k in range(lo + 1, hi)]
        if d and max(d)[0] > tolerance**2:
            k = -max(d)[1]
            keep.add(k)
            todo += [(lo, k), (k, hi)]
    return keep


def test_simplification(spark, rings):
    got = {}
    for r in G.simplified(vertices(spark, rings), 60.0).collect():
        got.setdefault(r.ring, set()).add(r.k - 1)
    assert got == {i: plain(ring, 60.0) for i, ring in rings.items()}
    assert any(len(got[i]) < len(rings[i]) for i in rings)


def test_no_broadcasts_and_no_rows_for_each_copy_of_a_place(spark, rings, monkeypatch):
    """The planner does not see how many cells an edge has; and what is written does not grow with points at one place."""
    edges = G.edges_of(vertices(spark, rings))
    rows, keep = [], G.written
    monkeypatch.setattr(G, "written", lambda df, *a: (out := keep(df, *a), rows.append(out.count()))[0])
    places = [(i, 37 * i % 400, 53 * i % 400) for i in range(50)]
    found = []
    for copies in (1, 5):
        rows.clear()
        points = spark.createDataFrame([(1000 * c + i, x, y) for c in range(copies) for i, x, y in places], "id long, x long, y long")
        out = G.inside(points, edges, 64)
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
        found.append((sum(rows), {(r.id % 1000, r.ring) for r in out.collect()}, out.count()))
    assert found[0][:2] == found[1][:2] and found[1][2] == 5 * found[0][2]
    assert "BroadcastHashJoin" not in G.intersecting(edges, edges, 64)._jdf.queryExecution().executedPlan().toString()


def test_rings_meet_as_wholes(spark, monkeypatch):
    """What is shuffled is rings, not edges in cells nor pairs; each pair is found once, in however many blocks and tiles."""
    rng = random.Random(7)
    many = {i: star(rng, 40, rng.randint(-300, 300), rng.randint(-300, 300), 400) for i in range(50)}
    many |= {50 + i: star(rng, 9, rng.randint(-900, 900), rng.randint(-900, 900), 150) for i in range(30)}
    many |= {90: many[0], 91: many[0][::-1], 92: [(5, 5)], 93: [(-800, 10), (800, 11)], 94: [(p[0] + 2000, p[1]) for p in many[1]]}
    edges = G.edges_of(vertices(spark, many)).localCheckpoint()
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    want = {(a, b) for a in many for b in many if a < b and meet(many[a], many[b])}
    before = shuffled()
    assert {(r.ring, r.other) for r in G.intersecting(edges, edges, 20).collect()} == want | {(b, a) for a, b in want} | {(a, a) for a in many}
    assert shuffled() - before < G.edge_cells(edges, 20).count() / 2
    monkeypatch.setattr(G, "BLOCK", 500)
    for size in (20, 150):
        got = [tuple(sorted((r.ring, r.other))) for r in G.intersecting_pairs(edges, size).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_two_tables_of_rings_with_nulls(spark, monkeypatch):
    """Names of two kinds, rings of one table against those of another, edges without a place, and tables without rings."""
    monkeypatch.setattr(G, "BLOCK", 300)
    rng = random.Random(8)
    mine, theirs = ({i: star(rng, rng.randint(1, 30), rng.randint(-900, 900), rng.randint(-900, 900), 300) for i in range(n)} for n in (25, 12))
    left = G.edges_of(vertices(spark, mine)).unionByName(spark.createDataFrame([(None, 1, 1, 9, 9), (3, None, 1, 9, 9)], "ring int, x0 long, y0 long, x1 long, y1 long"))
    right = G.edges_of(vertices(spark, theirs)).selectExpr("concat('r', ring) AS ring", "x0", "y0", "x1", "y1")
    got = sorted((r.ring, r.other) for r in G.intersecting(left, right, 40).collect())
    assert got == sorted((a, f"r{b}") for a in mine for b in theirs if meet(mine[a], theirs[b]))
    assert G.intersecting(left.limit(0), right, 40).count() == G.intersecting(left, right.limit(0), 40).count() == G.intersecting_pairs(left.limit(0), 40).count() == 0


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_blocks_of_rings_in_small_pieces(rings, monkeypatch, most):
    """Strips and pieces of any size find the same pairs; cells never settle a pair that edges do not."""
    import pyarrow as pa

    from geoloom.operators import rings as R

    monkeypatch.setattr(R, "MOST", most)
    monkeypatch.setattr(R, "STRIP", most)
    ends = [[[p[k] for p in ring[s:] + ring[:s]] for ring in rings.values()] for s, k in ((0, 0), (0, 1), (1, 0), (1, 1))]
    table = pa.table([pa.array(list(rings)), *[pa.array(e, pa.list_(pa.int64())) for e in ends]], names=["ring", "x0", "y0", "x1", "y1"])
    for side in (800, 16000):
        found = []
        for tx in range(-6, 6):
            for ty in range(-6, 6):
                within = [all(min(p[k] for p in ring) // side <= t <= max(p[k] for p in ring) // side for k, t in enumerate((tx, ty))) for ring in rings.values()]
                own = table.filter(pa.array(within))
                out = R.meeting(side, True)((pa.scalar(tx), pa.scalar(ty), pa.scalar(0), pa.scalar(0)), own, own.rename_columns(["other", *table.column_names[1:]]))
                found += [tuple(sorted(p)) for p in zip(*out.to_pydict().values(), strict=True)]
        assert sorted(found) == [(a, b) for a in rings for b in rings if a < b and meet(rings[a], rings[b])]
    far = pa.table([[1], *[pa.array([[0, v]], pa.list_(pa.int64())) for v in (1 << 30, 5, 1 << 30, 5)]], names=table.column_names)
    with pytest.raises(ValueError, match="differ"):
        R.Block(far, (0, 0), 800)
