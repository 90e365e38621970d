"""Queries over polygons: rings around places, their points, pairs, unions and simpler forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import polygons as G
from geoloom.plans.change import POINTS, _from, _points
from geoloom.sources.fixtures import read

#: Fifty places make a ring around a centre; they stand in the order of their angles, so that a ring never crosses itself.
_PLACES = """SELECT CAST(floor(c_custkey / 50) AS BIGINT) AS ring, c_custkey AS id, CAST(floor(c_custkey / 50) AS BIGINT) * 6151 % 100000 + c_custkey * 7919 % 16001 - 8000 AS x,
 CAST(floor(c_custkey / 50) AS BIGINT) * 49157 % 100000 + c_custkey * 104729 % 16007 - 8000 AS y FROM customer"""
RINGS = f"""SELECT ring, CAST(row_number() OVER (PARTITION BY ring ORDER BY round(atan2(y - cy, x - cx), 9), id) AS INT) AS k, x, y
 FROM (SELECT *, avg(x) OVER (PARTITION BY ring) AS cx, avg(y) OVER (PARTITION BY ring) AS cy FROM ({_PLACES}) p) q"""
SIZE = 1000  # the side of a cell, in metres
SIMPLE = 5.0  # metres; the rings are drawn together by 100
LOT = 2500  # the side of a square lot


def _rings(spark, sf_dir):
    return _from(spark, sf_dir, RINGS, "customer")


def point_in_polygon(spark, sf_dir):
    """Each point with the rings that hold it."""
    return G.inside(_points(spark, sf_dir).select("id", "x", "y"), G.edges_of(_rings(spark, sf_dir)), SIZE)


_EDGES = f"""SELECT ring, x AS x0, y AS y0, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y1
 FROM ({RINGS}) WINDOW w AS (PARTITION BY ring ORDER BY k)"""
_CROSS = "(y0 > y) <> (y1 > y) AND CASE WHEN y1 > y0 THEN (x - x0) * (y1 - y0) < (y - y0) * (x1 - x0) ELSE (x - x0) * (y1 - y0) > (y - y0) * (x1 - x0) END"
INSIDE = f"""WITH e AS MATERIALIZED ({_EDGES}), b AS (SELECT ring, min(x0) AS xa, max(x0) AS xb, min(y0) AS ya, max(y0) AS yb FROM e GROUP BY ring)
 SELECT p.id, e.ring FROM ({POINTS}) p JOIN b ON x BETWEEN xa AND xb AND y BETWEEN ya AND yb JOIN e ON e.ring = b.ring GROUP BY p.id, e.ring HAVING sum(({_CROSS})::INT) % 2 = 1"""


def polygon_intersects(spark, sf_dir):
    """How many other rings each ring meets, and the least of them."""
    pairs = G.intersecting_pairs(G.edges_of(_rings(spark, sf_dir)), SIZE)
    both = F.explode(F.array(F.struct("ring", "other"), F.struct(F.col("other").alias("ring"), F.col("ring").alias("other")))).alias("p")
    return pairs.select(both).select("p.*").groupBy("ring").agg(F.count("*").alias("met"), F.min("other").alias("first_met"))


_TURN = lambda a, b, c: f"sign(({b}[1] - {a}[1]) * ({c}[2] - {a}[2]) - ({b}[2] - {a}[2]) * ({c}[1] - {a}[1]))"
MEETS = f"""WITH e AS MATERIALIZED (SELECT ring, x0, y0, x1, y1, [x0, y0] AS p, [x1, y1] AS q FROM ({_EDGES})),
 b AS (SELECT ring, min(x0) AS xa, max(x0) AS xb, min(y0) AS ya, max(y0) AS yb, min([x0, y0]) AS v FROM e GROUP BY ring),
 o AS (SELECT a.ring, b.ring AS other, b.v FROM b a JOIN b ON a.ring <> b.ring AND a.xa <= b.xb AND b.xa <= a.xb AND a.ya <= b.yb AND b.ya <= a.yb),
 touch AS (SELECT DISTINCT o.ring, o.other FROM o JOIN e a ON a.ring = o.ring JOIN e b ON b.ring = o.other
  WHERE {_TURN("a.p", "a.q", "b.p")} * {_TURN("a.p", "a.q", "b.q")} <= 0 AND {_TURN("b.p", "b.q", "a.p")} * {_TURN("b.p", "b.q", "a.q")} <= 0
  AND greatest(a.x0, a.x1) >= least(b.x0, b.x1) AND greatest(b.x0, b.x1) >= least(a.x0, a.x1) AND greatest(a.y0, a.y1) >= least(b.y0, b.y1) AND greatest(b.y0, b.y1) >= least(a.y0, a.y1)),
 held AS (SELECT o.ring, o.other FROM (SELECT ring, other, v[1] AS x, v[2] AS y FROM o) o JOIN e ON e.ring = o.ring GROUP BY o.ring, o.other HAVING sum(({_CROSS})::INT) % 2 = 1),
 pairs AS (SELECT * FROM touch UNION SELECT * FROM held UNION SELECT other, ring FROM held)
 SELECT ring, count(*) AS met, min(other) AS first_met FROM pairs GROUP BY ring"""


def polygon_union(spark, sf_dir):
    """Area and perimeter of the union of the square lots that each nation's places are in, from the edges that no neighbour cancels."""
    lots = _from(spark, sf_dir, LOTS, "customer")
    a, b = F.col("gx") * LOT, F.col("gy") * LOT
    side = lambda x0, y0, x1, y1: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    sides = F.explode(F.array(side(a, b, a + LOT, b), side(a + LOT, b, a + LOT, b + LOT), side(a + LOT, b + LOT, a, b + LOT), side(a, b + LOT, a, b))).alias("e")
    out = G.area(G.union_edges(lots.select("nation", sides).select("nation", "e.*"), "nation"), "nation")
    return out.select("nation", F.col("area").cast("long").alias("area"), F.col("perimeter").cast("long").alias("perimeter"))


LOTS = f"SELECT DISTINCT c_nationkey AS nation, CAST(floor(c_custkey * 7919 % 100000 / {LOT}) AS BIGINT) AS gx, CAST(floor(c_custkey * 104729 % 100000 / {LOT}) AS BIGINT) AS gy FROM customer"
UNION = f"""WITH l AS ({LOTS}) SELECT nation, count(*) * {LOT} * {LOT} AS area, sum(4 - (SELECT count(*) FROM l n WHERE n.nation = l.nation AND abs(n.gx - l.gx) + abs(n.gy - l.gy) = 1))::BIGINT * {LOT} AS perimeter FROM l GROUP BY nation"""


def simplify_rings(spark, sf_dir):
    """The vertices of each ring, drawn together by 100, that stay within five metres."""
    return G.simplified(_rings(spark, sf_dir).withColumns({c: F.col(c) / 100 for c in "xy"}), SIMPLE).select("ring", "k")


_OFF = """list_transform(range(lo + 1, hi), lambda k: list_transform([CASE WHEN (p[hi].x - p[lo].x) * (p[hi].x - p[lo].x) + (p[hi].y - p[lo].y) * (p[hi].y - p[lo].y) = 0 THEN 0.0::DOUBLE
  ELSE least(greatest(((p[k].x - p[lo].x) * (p[hi].x - p[lo].x) + (p[k].y - p[lo].y) * (p[hi].y - p[lo].y)) / ((p[hi].x - p[lo].x) * (p[hi].x - p[lo].x) + (p[hi].y - p[lo].y) * (p[hi].y - p[lo].y)), 0.0::DOUBLE), 1.0::DOUBLE) END],
  lambda t: (p[lo].x + t * (p[hi].x - p[lo].x) - p[k].x) * (p[lo].x + t * (p[hi].x - p[lo].x) - p[k].x) + (p[lo].y + t * (p[hi].y - p[lo].y) - p[k].y) * (p[lo].y + t * (p[hi].y - p[lo].y) - p[k].y))[1])"""
SIMPLIFY = f"""WITH RECURSIVE v AS (SELECT ring, k, x / 100.0::DOUBLE AS x, y / 100.0::DOUBLE AS y FROM ({RINGS})),
 r AS (SELECT ring, count(*)::INT AS n, list({{'x': x, 'y': y}} ORDER BY k) AS p FROM v GROUP BY ring),
 s(ring, lo, hi, p) AS (SELECT ring, 1, n + 1, list_append(p, p[1]) FROM r
  UNION ALL SELECT ring, CASE WHEN side = 0 THEN lo ELSE cut END, CASE WHEN side = 0 THEN cut ELSE hi END, p
   FROM (SELECT *, (lo + list_position(d, list_max(d)))::INT AS cut FROM (SELECT *, {_OFF} AS d FROM s) WHERE list_max(d) > {SIMPLE * SIMPLE}), (VALUES (0), (1)) t(side))
 SELECT DISTINCT ring, k FROM (SELECT ring, 1 AS k FROM r UNION ALL SELECT s.ring, s.hi FROM s JOIN r ON r.ring = s.ring AND s.hi <= r.n)"""

def events_export(spark, sf_dir):
    """One GeoJSON feature a ring: its closed outline, the places it was made of as provenance, and the latest decision on it."""
    rings = _from(spark, sf_dir, RINGS, "customer").groupBy("ring").agg(F.sort_array(F.collect_list(F.struct("k", "x", "y"))).alias("v"))  # a ring's own vertices
    line = F.transform("v", lambda p: F.array(p["x"], p["y"]))
    made = _from(spark, sf_dir, _PLACES, "customer").groupBy("ring").agg(F.sort_array(F.collect_list("id")).alias("provenance"))
    said = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).alias("ring")).agg(F.max_by(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("decision")), F.struct("o_orderdate", "o_orderkey")).alias("decision"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(F.concat(line, F.slice(line, 1, 1))).alias("coordinates"))
    properties = F.struct(F.size("v").alias("vertices"), "provenance", "decision")
    rows = rings.join(made, "ring").join(said, "ring", "left")
    return rows.select("ring", F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("ring").alias("id"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


EXPORT = f"""WITH r AS (SELECT ring, list([x, y] ORDER BY k) AS v FROM ({RINGS}) GROUP BY ring), m AS (SELECT ring, list(id ORDER BY id) AS provenance FROM ({_PLACES}) GROUP BY ring),
 s AS (SELECT o_custkey % 40 AS ring, {{'id': o_orderkey, 'decision': o_orderstatus}} AS decision FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
 SELECT r.ring, to_json({{'type': 'Feature', 'id': r.ring, 'geometry': {{'type': 'Polygon', 'coordinates': [list_append(v, v[1])]}}, 'properties': {{'vertices': len(v), 'provenance': provenance, 'decision': decision}}}})::VARCHAR AS feature
 FROM r JOIN m ON m.ring = r.ring LEFT JOIN s ON s.ring = r.ring"""

QUERIES = {"events_export": events_export, "point_in_polygon": point_in_polygon, "polygon_intersects": polygon_intersects, "polygon_union": polygon_union, "simplify_rings": simplify_rings}
ORACLE = {"events_export": EXPORT, "point_in_polygon": INSIDE, "polygon_intersects": MEETS, "polygon_union": UNION, "simplify_rings": SIMPLIFY}
