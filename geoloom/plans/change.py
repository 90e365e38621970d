"""Queries over space, change and similarity: grid and neighbourhood operators, event gates and states, vectors and review."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.config import CLOUD, EDGE, T
from geoloom.functions import columns as C
from geoloom.operators import raster as R
from geoloom.operators import registration as P
from geoloom.operators import spatial as S
from geoloom.operators.quality import shadow_moves
from geoloom.operators.timeline import first_ranked, ranked_in_buckets
from geoloom.operators.vectors import nearest
from geoloom.sources.fixtures import read

POINTS = "SELECT c_custkey AS id, c_custkey * 7919 % 100000 AS x, c_custkey * 104729 % 100000 AS y, c_acctbal AS v FROM customer"
LAYERS = "SELECT s_suppkey AS oid, s_suppkey * 6151 % 100000 AS ox, s_suppkey * 49157 % 100000 AS oy, s_nationkey AS kind FROM supplier"
ZONES = "SELECT s_suppkey AS zone, s_suppkey * 6151 % 100000 AS x0, s_suppkey * 49157 % 100000 AS y0, s_suppkey * 6151 % 100000 + 4000 + s_nationkey * 100 AS x1, s_suppkey * 49157 % 100000 + 6000 AS y1 FROM supplier"
CELLS = "SELECT DISTINCT CAST(c_custkey * 37 % 61 AS INT) AS r, CAST(c_custkey * c_nationkey % 53 AS INT) AS c FROM customer WHERE c_acctbal > 0"
RASTER = "SELECT l_linenumber AS obs, CAST(l_orderkey % 48 AS INT) AS r, CAST(l_partkey % 48 AS INT) AS c, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3"


def _from(spark, sf_dir, sql, name):
    return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=read(spark, sf_dir, name))


#: A day of the events stands for 15, so that a month of them spans the seasons and gaps that the thresholds speak of.
DAYS = 15


def _day(ts="ts"):
    return F.datediff(F.col(ts).cast("date"), F.to_date(F.lit("2024-01-01"))) * DAYS


def _points(spark, sf_dir):
    return _from(spark, sf_dir, POINTS, "customer")


def _raster(spark, sf_dir):
    return _from(spark, sf_dir, RASTER, "lineitem")


def _cells(spark, sf_dir):
    return _from(spark, sf_dir, CELLS, "customer")


def core_tile(spark, sf_dir):
    col = lambda v: F.floor((F.col(v) - 320) / 640).cast("int")
    return _points(spark, sf_dir).select("id", col("x").alias("tc"), col("y").alias("tr"), C.tile_id(col("x"), col("y")).alias("tile"))


CORE = f"SELECT id, CAST(floor((x - 320) / 640.0) AS INT) AS tc, CAST(floor((y - 320) / 640.0) AS INT) AS tr, 'epsg' AS tile FROM ({POINTS})".replace("'epsg'", "'32644_g10m_s128s64_c' || CAST(floor((x - 320) / 640.0) AS INT) || '_r' || CAST(floor((y - 320) / 640.0) AS INT)")


def tile_overlay(spark, sf_dir):
    """Every point counts in the up to four half-overlapping tiles that hold it: places are computed, not searched."""
    both = lambda v: F.explode(F.array(F.floor(F.col(v) / 640) - 1, F.floor(F.col(v) / 640)))
    rows = _points(spark, sf_dir).select("v", both("x").alias("tc"), "y").select("v", "tc", both("y").alias("tr")).where("tc >= 0 AND tr >= 0")
    return rows.groupBy(F.col("tc").cast("int").alias("tc"), F.col("tr").cast("int").alias("tr")).agg(F.count("*").alias("n"), F.round(F.avg("v"), 4).alias("mean_v"))


OVERLAY = f"""SELECT tc, tr, count(*) AS n, round(avg(v), 4) AS mean_v FROM (SELECT v, unnest([CAST(floor(x / 640.0) AS INT) - 1, CAST(floor(x / 640.0) AS INT)]) AS tc, y FROM ({POINTS})) t1,
 LATERAL (SELECT unnest([CAST(floor(y / 640.0) AS INT) - 1, CAST(floor(y / 640.0) AS INT)]) AS tr) WHERE tc >= 0 AND tr >= 0 GROUP BY tc, tr"""


def zone_flags(spark, sf_dir):
    """Points in each active priority zone."""
    zones = _from(spark, sf_dir, ZONES, "supplier").where("zone % 3 <> 0")
    return S.in_boxes(_points(spark, sf_dir).select("id", "x", "y"), zones, 5000).select("id", "zone")


ZONE_FLAGS = f"SELECT id, zone FROM ({POINTS}) p JOIN ({ZONES}) z ON zone % 3 <> 0 AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"


def aoi_intersect(spark, sf_dir):
    """Areas that a footprint (a box of 500 m around a point) meets, by the area's box widened by it."""
    zones = _from(spark, sf_dir, ZONES, "supplier").select("zone", *[(F.col(c) + d).alias(c) for c, d in (("x0", -500), ("y0", -500), ("x1", 500), ("y1", 500))])
    return S.in_boxes(_points(spark, sf_dir).select("id", "x", "y"), zones, 5000).groupBy("id").agg(F.count("*").alias("areas"), F.min("zone").alias("first_area"))


INTERSECT = f"SELECT id, count(*) AS areas, min(zone) AS first_area FROM ({POINTS}) JOIN ({ZONES}) ON x + 500 >= x0 AND x - 500 <= x1 AND y + 500 >= y0 AND y - 500 <= y1 GROUP BY id"


def near_layer(spark, sf_dir):
    """The nearest layer feature of each point within the radius; the fixture's places are drawn together by 8."""
    near = lambda df, *cols: df.select(*[c for c in df.columns if c not in cols], *[F.floor(F.col(c) / 8).alias(c) for c in cols])
    points, layers = near(_points(spark, sf_dir).select("id", "x", "y"), "x", "y"), near(_from(spark, sf_dir, LAYERS, "supplier"), "ox", "oy")
    return S.nearest_within(points, layers, T.near_default_m).select("id", "oid", "kind", "d2")


NEAR = f"""WITH p AS (SELECT id, x // 8 AS x, y // 8 AS y FROM ({POINTS})), l AS (SELECT oid, kind, ox // 8 AS ox, oy // 8 AS oy FROM ({LAYERS}))
 SELECT id, oid, kind, (x-ox)*(x-ox)+(y-oy)*(y-oy) AS d2 FROM p JOIN l ON (x-ox)*(x-ox)+(y-oy)*(y-oy) <= 250000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, oid) = 1"""


def peer_departure(spark, sf_dir):
    """How far each point's value departs from that of its peers within the radius, in their standard deviations, with enough peers.

    The sums of whole grid cells in reach are added cell by cell; only points in cells that the circle cuts are met
    one by one (`operators.spatial.sums_within`). The fixture's places are drawn together by 8.
    """
    p = _points(spark, sf_dir).select("id", F.floor(F.col("x") / 8).alias("x"), F.floor(F.col("y") / 8).alias("y"), F.round(F.col("v") * 100).cast("long").alias("v"))
    out = S.sums_within(p, T.peer_radius_m, 16).where(F.col("n") - 1 >= T.peer_min_pixels)
    n, total, squares = F.col("n") - 1, F.col("total") - F.col("v"), F.col("squares") - F.col("v") * F.col("v")
    mean = total / n
    spread = F.sqrt(squares / n - mean * mean)
    z = F.try_divide(F.col("v") - mean, spread)
    return out.select("id", n.alias("peers"), F.round(z, 4).alias("z"), F.coalesce(F.abs(z) >= T.min_abs_peer_z, F.lit(False)).alias("departs"))


PEERS = f"""WITH p AS (SELECT id, x // 8 AS x, y // 8 AS y, round(v * 100)::BIGINT AS v FROM ({POINTS})),
 z AS (SELECT a.id, count(*) AS peers, (any_value(a.v) - avg(b.v)) / nullif(sqrt(sum(b.v * b.v)::DOUBLE / count(*) - (sum(b.v)::DOUBLE / count(*)) * (sum(b.v)::DOUBLE / count(*))), 0) AS z
 FROM p a JOIN p b ON a.id <> b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 25000000 GROUP BY a.id HAVING count(*) >= 200)
 SELECT id, peers, round(z, 4) AS z, coalesce(abs(z) >= 2, false) AS departs FROM z"""


def split_assign(spark, sf_dir):
    """dev or test by a hash of a point's block; tiles that touch both are buffer."""
    block = lambda v, d=0: F.floor((F.col(v) + d) / 2560).cast("int")
    part = lambda dx, dy: F.when(C.unit_hash(F.lit("salt"), block("x", dx), block("y", dy)) < 0.3, "test").otherwise("dev")
    corners = F.array_distinct(F.array(*[part(dx, dy) for dx in (0, 1279) for dy in (0, 1279)]))
    return _points(spark, sf_dir).select("id", F.when(F.size(corners) > 1, "buffer").otherwise(F.get(corners, F.lit(0))).alias("split"))


def _part(dx, dy):
    return f"CASE WHEN ('0x' || substr(sha256('salt-' || CAST(floor((x + {dx}) / 2560.0) AS INT) || '-' || CAST(floor((y + {dy}) / 2560.0) AS INT)), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.3 THEN 'test' ELSE 'dev' END"


SPLIT = f"SELECT id, CASE WHEN len(ps) > 1 THEN 'buffer' ELSE ps[1] END AS split FROM (SELECT id, list_distinct([{', '.join(_part(a, b) for a in (0, 1279) for b in (0, 1279))}]) AS ps FROM ({POINTS}))"


def dilate(spark, sf_dir):
    return R.dilate(_cells(spark, sf_dir), R.square(1)).where("r BETWEEN 0 AND 60 AND c BETWEEN 0 AND 52")


def opening(spark, sf_dir):
    return R.dilate(R.erode(_cells(spark, sf_dir), R.CROSS), R.CROSS)


OPENING = f"""WITH s AS ({CELLS}), o(dr, dc) AS (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)),
 e AS (SELECT r, c FROM s WHERE (SELECT count(*) FROM o JOIN s b ON b.r = s.r + dr AND b.c = s.c + dc) = 5) SELECT DISTINCT r + dr AS r, c + dc AS c FROM e, o"""


def components(spark, sf_dir):
    """4-connected components of at least 4 cells: their least cell, size and box."""
    parts = R.components(_cells(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    return parts.where("n >= 4")


COMPONENTS = f"""WITH RECURSIVE s AS ({CELLS}), k AS (SELECT r * 1048576::BIGINT + c AS a, r, c FROM s),
 e AS (SELECT a.a, b.a AS b FROM k a JOIN k b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
 reach(a, b) AS (SELECT a, a FROM k UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
 l AS (SELECT a, min(b) AS label FROM reach GROUP BY a)
 SELECT label, count(*) AS n, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM l JOIN k USING (a) GROUP BY label HAVING count(*) >= 4"""


def shadow_project(spark, sf_dir):
    """Cells that cloud cells shade at the five cloud heights: whole offsets away from the sun, inside the scene."""
    return R.dilate(_cells(spark, sf_dir), [(a, b, 1.0) for a, b in shadow_moves(150, 50, 100)]).where("r BETWEEN 0 AND 60 AND c BETWEEN 0 AND 52")


SHADOW = f"SELECT DISTINCT r + dr AS r, c + dc AS c FROM ({CELLS}), (VALUES {', '.join(f'({a},{b})' for a, b in shadow_moves(150, 50, 100))}) o(dr, dc) WHERE r + dr BETWEEN 0 AND 60 AND c + dc BETWEEN 0 AND 52"


def local_sigma(spark, sf_dir):
    """Standard deviation of the 3 x 3 neighbourhood, the edge repeated."""
    value = F.round(F.sqrt(F.greatest(F.avg(F.col("nv") * F.col("nv")) - F.avg("nv") * F.avg("nv"), F.lit(0.0))), 4).alias("sigma")
    return R.weighted(_raster(spark, sf_dir), R.square(1), 48, value)


_SQ = ", ".join(f"({a},{b})" for a, b, _ in R.square(1))
_NEAR = "SELECT a.obs, a.r, a.c, a.v, b.v AS nv, dr, dc FROM g a, (VALUES {o}) o(dr, dc) JOIN g b ON TRUE WHERE b.obs = a.obs AND b.r = greatest(0, least(47, a.r + dr)) AND b.c = greatest(0, least(47, a.c + dc))"
SIGMA = f"WITH g AS ({RASTER}) SELECT obs, r, c, round(sqrt(greatest(avg(nv * nv) - avg(nv) * avg(nv), 0.0)), 4) AS sigma FROM ({_NEAR.format(o=_SQ)}) GROUP BY obs, r, c"


def strong_edges(spark, sf_dir):
    """Cells whose Sobel magnitude is above the 90th percentile of their observation, and those next to them (`edge_band_px`)."""
    grid = R.around(_raster(spark, sf_dir), R.square(1), 48)
    gx = F.sum(F.col("nv") * F.col("dc") * (2 - F.abs("dr")))
    gy = F.sum(F.col("nv") * F.col("dr") * (2 - F.abs("dc")))
    mag = grid.groupBy("obs", "r", "c").agg(F.round(gx * gx + gy * gy, 8).alias("m"))
    strong = mag.withColumn("p", F.percentile("m", 0.9).over(W.partitionBy("obs"))).where("m > p").select("obs", "r", "c")
    for _ in range(T.edge_band_px):
        strong = R.spread(strong, R.CROSS, ["obs"])
    return strong.where("r BETWEEN 0 AND 47 AND c BETWEEN 0 AND 47")


EDGES = f"""WITH g AS ({RASTER}), m AS (SELECT obs, r, c, round(sum(nv * dc * (2 - abs(dr))) ** 2 + sum(nv * dr * (2 - abs(dc))) ** 2, 8) AS m FROM ({_NEAR.format(o=_SQ)}) GROUP BY obs, r, c)
 SELECT DISTINCT obs, r + dr AS r, c + dc AS c FROM (SELECT obs, r, c FROM m JOIN (SELECT obs, quantile_cont(m, 0.9) AS p FROM m GROUP BY obs) USING (obs) WHERE m > p), (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(dr, dc)
 WHERE r + dr BETWEEN 0 AND 47 AND c + dc BETWEEN 0 AND 47"""


def edge_flag(spark, sf_dir):
    """The mask after registration: strong edges of clean cells are flagged where a registered observation's residual is too large."""
    grid = _raster(spark, sf_dir).select("obs", "r", "c", F.when(F.col("v") > 40, CLOUD).otherwise(0).alias("mask"))
    edges = strong_edges(spark, sf_dir).select("obs", "r", "c", F.lit(True).alias("strong"))
    residual, status = F.col("obs") % 4 * 0.3, F.element_at(F.array(*map(F.lit, ("ok", "corrected", "suspect"))), (F.col("obs") % 3 + 1).cast("int"))
    flagged = F.coalesce("strong", F.lit(False)) & (F.col("mask") == 0) & status.isin("ok", "corrected") & (residual > T.residual_edge_suppress_px)
    rows = grid.join(edges, ["obs", "r", "c"], "left")
    return rows.select("obs", "r", "c", F.when(flagged, F.col("mask").bitwiseOR(EDGE)).otherwise(F.col("mask")).alias("mask"))


def terrain(spark, sf_dir):
    """Slope and the cosine of the sun's incidence from differences to the four neighbours, one-sided at the edges."""
    grid = R.around(_raster(spark, sf_dir), [(1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1)])
    side = lambda cond: F.max(F.when(cond, F.col("nv")))
    rows = grid.groupBy("obs", "r", "c").agg(F.first("v").alias("v"), side(F.col("dr") == 1).alias("s"), side(F.col("dr") == -1).alias("n"), side(F.col("dc") == 1).alias("e"), side(F.col("dc") == -1).alias("w"))
    diff = lambda a, b: F.coalesce((F.col(a) - F.col(b)) / 2, F.col(a) - F.col("v"), F.col("v") - F.col(b), F.lit(0.0)) / 10
    gy, gx = diff("s", "n"), diff("e", "w")
    slope, aspect = F.atan(F.sqrt(gx * gx + gy * gy)), F.atan2(-gx, gy)
    zen, az = 0.7853981633974483, 2.6179938779914944
    cos_i = F.cos(slope) * F.cos(F.lit(zen)) + F.sin(slope) * F.sin(F.lit(zen)) * F.cos(F.lit(az) - aspect)
    return rows.select("obs", "r", "c", F.round(slope, 4).alias("slope"), F.round(cos_i, 4).alias("cos_i"), (cos_i < T.terrain_min_cos_i).alias("dark"))


EDGE_FLAG = f"""SELECT g.obs, g.r, g.c, CASE WHEN e.obs IS NOT NULL AND v <= 40 AND g.obs % 3 < 2 AND g.obs % 4 * 0.3::DOUBLE > 0.5 THEN 128 WHEN v > 40 THEN 4 ELSE 0 END AS mask
 FROM ({RASTER}) g LEFT JOIN ({EDGES}) e ON e.obs = g.obs AND e.r = g.r AND e.c = g.c"""

_D = "coalesce(({a} - {b}) / 2, {a} - v, v - {b}, 0.0) / 10"
TERRAIN = f"""WITH g AS ({RASTER}), n AS (SELECT a.obs, a.r, a.c, a.v, s.v AS s, n.v AS n, e.v AS e, w.v AS w FROM g a
 LEFT JOIN g s ON s.obs = a.obs AND s.r = a.r + 1 AND s.c = a.c LEFT JOIN g n ON n.obs = a.obs AND n.r = a.r - 1 AND n.c = a.c
 LEFT JOIN g e ON e.obs = a.obs AND e.r = a.r AND e.c = a.c + 1 LEFT JOIN g w ON w.obs = a.obs AND w.r = a.r AND w.c = a.c - 1 WHERE coalesce(s.v, n.v, e.v, w.v) IS NOT NULL),
 d AS (SELECT obs, r, c, {_D.format(a="s", b="n")} AS gy, {_D.format(a="e", b="w")} AS gx FROM n), t AS (SELECT *, atan(sqrt(gx * gx + gy * gy)) AS sl, atan2(-gx, gy) AS asp FROM d),
 i AS (SELECT *, cos(sl) * cos(0.7853981633974483) + sin(sl) * sin(0.7853981633974483) * cos(2.6179938779914944 - asp) AS ci FROM t)
 SELECT obs, r, c, round(sl, 4) AS slope, round(ci, 4) AS cos_i, ci < 0.15 AS dark FROM i"""


def overviews(spark, sf_dir):
    return _raster(spark, sf_dir).groupBy("obs", F.floor(F.col("r") / 2).cast("int").alias("r"), F.floor(F.col("c") / 2).cast("int").alias("c")).agg(F.round(F.avg("v"), 8).alias("v"), F.min_by("v", F.struct("r", "c")).alias("nearest"))


OVERVIEWS = f"SELECT obs, r // 2 AS r, c // 2 AS c, round(avg(v), 8) AS v, arg_min(v, r * 100 + c) AS nearest FROM ({RASTER}) GROUP BY obs, r // 2, c // 2"


def apply_shift(spark, sf_dir):
    """A raster moved by a part of a cell: four weighted neighbours, all of which must exist."""
    return P.shifted(_raster(spark, sf_dir), -0.25, -0.5, 48).select("obs", "r", "c", F.round("v", 8).alias("v"))


SHIFT = f"WITH g AS ({RASTER}) SELECT obs, r, c, round(sum(nv * w), 8) AS v FROM (SELECT a.obs, a.r, a.c, b.v AS nv, w FROM g a, (VALUES (0,0,0.375::DOUBLE),(1,0,0.125::DOUBLE),(0,1,0.375::DOUBLE),(1,1,0.125::DOUBLE)) o(dr, dc, w) JOIN g b ON TRUE WHERE b.obs = a.obs AND b.r = a.r + dr AND b.c = a.c + dc) GROUP BY obs, r, c HAVING count(*) = 4"


def _series(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", "event_type")
    return e.select("*", (F.col("event_type") != "error").alias("usable"), (F.col("value") >= 60).alias("post"), (F.col("value") < 10).alias("pre"))


SERIES = "SELECT user_id, event_id, ts, value, event_type, event_type <> 'error' AS usable, value >= 60 AS post, value < 10 AS pre FROM events"


def vote_mask(spark, sf_dir):
    """Tiles that were in the state before in most frames of the first half and in the state after in enough of the second."""
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    s = _series(spark, sf_dir).where("usable")
    g = s.groupBy("user_id").agg(F.avg(F.when(F.col("ts") < cut, (F.col("value") < 60).cast("double"))).alias("before"), F.count(F.when(F.col("ts") >= cut, 1)).alias("n"), F.count(F.when((F.col("ts") >= cut) & (F.col("value") >= 15), 1)).alias("votes"))
    return g.select("user_id", F.round("before", 6).alias("before"), "n", "votes", ((F.col("before") >= T.object_pre_share) & (F.col("votes") >= F.greatest(F.lit(1), F.ceil(F.col("n") * T.object_post_share)))).alias("changed"))


VOTE = f"""SELECT user_id, round(before, 6) AS before, n, votes, before >= 0.6 AND votes >= greatest(1, ceil(n * 0.6::DOUBLE)) AS changed FROM (SELECT user_id, avg((value < 60)::INT) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS before,
 count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS n, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16' AND value >= 15) AS votes FROM ({SERIES}) WHERE usable GROUP BY user_id)"""


def first_change(spark, sf_dir):
    s = _series(spark, sf_dir).where("usable")
    return s.groupBy("user_id").agg(F.min(F.when(F.col("post"), F.col("ts"))).alias("first_ts"), F.min_by("event_id", F.when(F.col("post"), F.struct("ts", "event_id"))).alias("first_id"))


FIRST = f"SELECT user_id, min(ts) FILTER (WHERE post) AS first_ts, arg_min(event_id, (epoch_us(ts), event_id)) FILTER (WHERE post) AS first_id FROM ({SERIES}) WHERE usable GROUP BY user_id"


def object_series(spark, sf_dir):
    """Per tile and day: usable share; the post share and area only where enough is usable."""
    s = _series(spark, sf_dir).groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.avg(F.col("usable").cast("double")).alias("u"), F.avg(F.when(F.col("usable"), F.col("post").cast("double"))).alias("p"), F.count("*").alias("n"))
    able = F.col("u") >= T.object_min_usable
    return s.select("user_id", "day", F.round("u", 4).alias("usable_share"), F.round(F.when(able, F.col("p")), 4).alias("post_share"), F.round(F.when(able, F.col("p") * F.col("n") * 0.04), 4).alias("area_ha"))


OBJECT = f"""SELECT user_id, day, round(u, 4) AS usable_share, round(CASE WHEN u >= 0.8 THEN p END, 4) AS post_share, round(CASE WHEN u >= 0.8 THEN p * n * 0.04::DOUBLE END, 4) AS area_ha
 FROM (SELECT user_id, CAST(ts AS DATE) AS day, avg(usable::INT) AS u, avg(post::INT) FILTER (WHERE usable) AS p, count(*) AS n FROM ({SERIES}) GROUP BY ALL)"""


def area_range(spark, sf_dir):
    """Changed area of each tile under strict, stated and loose thresholds."""
    s = _series(spark, sf_dir).where("usable")
    area = lambda t: F.round(F.sum((F.col("value") >= t).cast("int")) * 0.04, 4)
    return s.groupBy("user_id").agg(area(75).alias("strict_ha"), area(60).alias("area_ha"), area(45).alias("loose_ha"))


AREA = f"SELECT user_id, round(sum((value >= 75)::INT) * 0.04::DOUBLE, 4) AS strict_ha, round(sum((value >= 60)::INT) * 0.04::DOUBLE, 4) AS area_ha, round(sum((value >= 45)::INT) * 0.04::DOUBLE, 4) AS loose_ha FROM ({SERIES}) WHERE usable GROUP BY user_id"


def stable_window(spark, sf_dir):
    """Whether the usable observations among the four before each one agree on its state."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-T.stable_window, -1)
    s = _series(spark, sf_dir).where("usable").select("user_id", "event_id", "ts", F.col("post").cast("int").alias("state"))
    s = s.select("user_id", "event_id", F.count("state").over(w).alias("n"), F.avg("state").over(w).alias("share"))
    agree = F.greatest("share", 1 - F.col("share"))
    return s.select("user_id", "event_id", "n", F.round("share", 4).alias("share"), ((F.col("n") >= T.stable_min_obs) & (agree >= T.stable_agreement)).alias("stable"))


STABLE = f"""SELECT user_id, event_id, n, round(share, 4) AS share, coalesce(n >= 3 AND greatest(share, 1 - share) >= 0.8, false) AS stable FROM (SELECT user_id, event_id, count(*) OVER w AS n, avg(post::INT) OVER w AS share
 FROM ({SERIES}) WHERE usable WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))"""


def bracket_gap(spark, sf_dir):
    """Days between neighbouring usable observations, whether the gap is long, how sharp the step is, and its kind.

    Sharpness is the step's share of the change from the observation before it to the one after it; a step is abrupt if that
    reaches `abrupt_sharpness`, gradual if at least `gradual_min_intermediate_obs` intermediate states stand before it.
    """
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.datediff(F.col("ts").cast("date"), F.lag("ts", 1).over(w).cast("date")) * DAYS
    step, whole = F.abs(F.col("value") - F.lag("value", 1).over(w)), F.abs(F.lead("value", 1).over(w) - F.lag("value", 1).over(w))
    between = F.sum((~F.col("post") & ~F.col("pre")).cast("int")).over(w.rowsBetween(-4, -1))
    s = _series(spark, sf_dir).where("usable").select("user_id", "event_id", gap.alias("gap"), F.try_divide(step, F.greatest(whole, step)).alias("sharpness"), between.alias("between"))
    kind = F.when(F.col("sharpness") >= T.abrupt_sharpness, "abrupt").when(F.col("between") >= T.gradual_min_intermediate_obs, "gradual").otherwise("unclear")
    return s.select("user_id", "event_id", "gap", (F.col("gap") >= T.long_gap_days).alias("long_gap"), F.round("sharpness", 6).alias("sharpness"), kind.alias("kind"))


GAP = f"""SELECT user_id, event_id, (gap * 15)::INT AS gap, gap * 15 >= 45 AS long_gap, round(sharpness, 6) AS sharpness, CASE WHEN sharpness >= 0.7 THEN 'abrupt' WHEN between_ >= 3 THEN 'gradual' ELSE 'unclear' END AS kind FROM (SELECT user_id, event_id, date_diff('day', CAST(lag(ts) OVER w AS DATE), CAST(ts AS DATE)) AS gap,
 abs(value - lag(value) OVER w) / nullif(greatest(abs(lead(value) OVER w - lag(value) OVER w), abs(value - lag(value) OVER w)), 0) AS sharpness, sum((NOT post AND NOT pre)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS between_
 FROM ({SERIES}) WHERE usable WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def same_season(spark, sf_dir):
    """Mean of the values of the same tile in the same season, by a range frame on the day number; and whether it is green."""
    w = W.partitionBy("user_id").orderBy("d").rangeBetween(-T.same_season_window_days, T.same_season_window_days)
    s = _series(spark, sf_dir).withColumn("d", _day())
    green = F.month(F.date_add(F.to_date(F.lit("2024-01-01")), F.col("d"))).isin(list(T.green_season_months))
    return s.select("user_id", "event_id", F.count("*").over(w).alias("n"), F.round(F.avg("value").over(w), 8).alias("season_mean"), green.alias("green"))


SEASON = f"SELECT user_id, event_id, count(*) OVER w AS n, round(avg(value) OVER w, 8) AS season_mean, month(DATE '2024-01-01' + d::INT) IN (8, 9, 10, 11) AS green FROM (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 15 AS d FROM ({SERIES})) WINDOW w AS (PARTITION BY user_id ORDER BY d RANGE BETWEEN 45 PRECEDING AND 45 FOLLOWING)"


def state_machine(spark, sf_dir):
    """State of each tile's event from its usable observations in time order.

    Two contradictions in a row end an event: REVERSED if it was confirmed before the second of them, else TRANSIENT.
    CONFIRMED takes two confirmations over the least span, one of them in the green season; below that, a time without
    any usable observation makes it INSUFFICIENT_DATA. A failed gate (here: every tenth tile) makes it SUPPRESSED, and
    an analyst's rejection (every thirteenth) REJECTED; the machine's state stays beside it.
    """
    w, all_of = W.partitionBy("user_id").orderBy("ts", "event_id"), W.partitionBy("user_id")
    s = _series(spark, sf_dir).where("usable").withColumn("d", _day()).withColumn("first_at", F.min(F.when(F.col("post"), F.col("ts"))).over(all_of))
    s = s.withColumn("twice", F.col("pre") & F.coalesce(F.lag("pre", 1).over(w), F.lit(False)) & (F.col("ts") > F.col("first_at")))
    s = s.withColumn("end_at", F.min(F.when(F.col("twice"), F.col("ts"))).over(all_of)).withColumn("gap", F.col("d") - F.lag("d", 1).over(w))
    later = F.col("post") & (F.col("ts") > F.col("first_at")) & (F.col("end_at").isNull() | (F.col("ts") < F.col("end_at")))
    green = F.month(F.date_add(F.to_date(F.lit("2024-01-01")), F.col("d"))).isin(list(T.green_season_months))
    g = s.groupBy("user_id").agg(
        F.max("first_at").alias("first_at"), F.max("end_at").alias("end_at"), F.count(F.when(later, 1)).alias("n_after"), F.max(F.when(later, F.col("d"))).alias("last_d"),
        F.min(F.when(F.col("ts") == F.col("first_at"), F.col("d"))).alias("first_d"), F.max((later & green).cast("int")).alias("green"), F.max(F.when(F.col("ts") > F.col("first_at"), F.col("gap"))).alias("gap"),
    )
    confirmed = (F.col("n_after") >= T.confirmed_confirming_obs) & (F.col("last_d") - F.col("first_d") >= T.confirmed_min_span_days) & (F.col("green") == 1)
    state = F.when(F.col("first_at").isNull(), "NONE").when(F.col("end_at").isNotNull() & confirmed, "REVERSED").when(F.col("end_at").isNotNull(), "TRANSIENT").when(confirmed, "CONFIRMED")
    state = state.when(F.col("gap") >= T.insufficient_data_days, "INSUFFICIENT_DATA").when(F.col("n_after") >= T.provisional_confirming_obs, "PROVISIONAL").otherwise("TENTATIVE")
    shown = F.when(state == "NONE", state).when(F.col("user_id") % 13 == 0, "REJECTED").when(F.col("user_id") % 10 == 0, "SUPPRESSED").otherwise(state)
    return g.select("user_id", state.alias("machine_state"), shown.alias("state"), "n_after", "first_at")


STATE = f"""WITH s AS (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 15 AS d, min(ts) FILTER (WHERE post) OVER (PARTITION BY user_id) AS first_at, lag(pre) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lp FROM ({SERIES}) WHERE usable),
 t AS (SELECT *, d - lag(d) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap, min(ts) FILTER (WHERE pre AND coalesce(lp, false) AND ts > first_at) OVER (PARTITION BY user_id) AS end_at FROM s),
 l AS (SELECT *, coalesce(post AND ts > first_at AND (end_at IS NULL OR ts < end_at), false) AS later FROM t),
 g AS (SELECT user_id, max(first_at) AS first_at, max(end_at) AS end_at, count(*) FILTER (WHERE later) AS n_after, max(d) FILTER (WHERE later) AS last_d, min(d) FILTER (WHERE ts = first_at) AS first_d,
 coalesce(bool_or(later AND month(DATE '2024-01-01' + d::INT) IN (8, 9, 10, 11)), false) AS green, max(gap) FILTER (WHERE ts > first_at) AS gap FROM l GROUP BY user_id),
 c AS (SELECT *, coalesce(n_after >= 2 AND last_d - first_d >= 20 AND green, false) AS ok FROM g),
 m AS (SELECT user_id, n_after, first_at, CASE WHEN first_at IS NULL THEN 'NONE' WHEN end_at IS NOT NULL AND ok THEN 'REVERSED' WHEN end_at IS NOT NULL THEN 'TRANSIENT' WHEN ok THEN 'CONFIRMED'
 WHEN gap >= 60 THEN 'INSUFFICIENT_DATA' WHEN n_after >= 1 THEN 'PROVISIONAL' ELSE 'TENTATIVE' END AS machine_state FROM c)
 SELECT user_id, machine_state, CASE WHEN machine_state = 'NONE' THEN 'NONE' WHEN user_id % 13 = 0 THEN 'REJECTED' WHEN user_id % 10 = 0 THEN 'SUPPRESSED' ELSE machine_state END AS state, n_after, first_at FROM m"""


def gate_funnel(spark, sf_dir):
    """Candidates in and out of each gate, in order, and how many more would pass without it; one pass over the candidates."""
    s = _series(spark, sf_dir).select("usable", (F.col("value") > 5).alias("g2"), (F.col("event_id") % 7 != 0).alias("g3"), F.col("post").alias("g4"), (F.col("user_id") % 10 != 0).alias("g5"))
    gates = ["usable", "g2", "g3", "g4", "g5"]
    every = lambda names: F.sum(F.when(F.expr(" AND ".join(names) or "TRUE"), 1).otherwise(0)).cast("long")
    row = s.agg(*[every(gates[:i]).alias(f"in{i}") for i in range(6)], *[every(gates[:i] + gates[i + 1 :]).alias(f"out{i}") for i in range(5)])
    parts = F.array(*[F.struct(F.lit(f"G{i + 1}").alias("gate"), F.col(f"in{i}").alias("n_in"), F.col(f"in{i + 1}").alias("n_out"), (F.col(f"out{i}") - F.col("in5")).alias("without")) for i in range(5)])
    return row.select(F.explode(parts).alias("x")).select("x.*")


_G = ["event_type <> 'error'", "value > 5", "event_id % 7 <> 0", "value >= 60", "user_id % 10 <> 0"]
FUNNEL = " UNION ALL ".join(f"SELECT 'G{i + 1}' AS gate, count(*) FILTER (WHERE {' AND '.join(_G[:i]) or 'TRUE'}) AS n_in, count(*) FILTER (WHERE {' AND '.join(_G[: i + 1])}) AS n_out, count(*) FILTER (WHERE {' AND '.join(_G[:i] + _G[i + 1 :])}) - count(*) FILTER (WHERE {' AND '.join(_G)}) AS without FROM events" for i in range(5))


def review_rank(spark, sf_dir):
    """The review order of documents: priority, state, confidence; with hash slices for audit and uncertainty."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    u = C.unit_hash(F.lit("review"), F.col("doc_id"))
    conf = F.least(F.lit(1.0), F.col("n_chars") / 4000)
    rows = d.select("doc_id", (F.col("lang") == "en").cast("int").alias("zone"), F.round(conf, 6).alias("confidence"), F.when(u < T.audit_slice_fraction, "audit").when(u < T.audit_slice_fraction + T.uncertainty_slice_fraction, "uncertainty").otherwise("rank").alias("slice"))
    rows = rows.withColumn("level", C.confidence_level(F.col("confidence"), F.col("zone") == 1))
    order = [F.col("zone").desc(), F.col("confidence").desc(), F.col("doc_id")]
    # Few slices and levels: each is numbered in buckets of its order.
    out = ranked_in_buckets(rows, ["slice", "level"], [-F.col("zone"), -F.col("confidence"), F.floor(F.col("doc_id") / 65536)], order, "place")
    return out.withColumn("place", F.col("place").cast("int"))


REVIEW = """WITH r AS (SELECT doc_id, (lang = 'en')::INT AS zone, round(least(1.0, n_chars / 4000.0::DOUBLE), 6) AS confidence, ('0x' || substr(sha256('review-' || doc_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS u FROM documents),
 l AS (SELECT doc_id, zone, confidence, CASE WHEN u < 0.07 THEN 'audit' WHEN u < 0.07::DOUBLE + 0.05::DOUBLE THEN 'uncertainty' ELSE 'rank' END AS slice, CASE WHEN confidence < 0.4 THEN 'LOW' WHEN confidence < 0.7 OR zone <> 1 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM r)
 SELECT *, row_number() OVER (PARTITION BY slice, level ORDER BY zone DESC, confidence DESC, doc_id) AS place FROM l"""


def _judged(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    p = F.least(F.lit(0.999), F.col("n_chars") / 5000)
    return d.select("quality", p.alias("p"), F.floor(p * 10).cast("int").alias("bin"))


def calibration_bins(spark, sf_dir):
    """Reliability of a confidence in ten bins: mean confidence, share of positives, Brier part."""
    return _judged(spark, sf_dir).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("confidence"), F.round(F.avg("quality"), 6).alias("positive"), F.round(F.avg(F.pow(F.col("p") - F.col("quality"), 2)), 6).alias("brier"))


CALIBRATION = "SELECT bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(quality), 6) AS positive, round(avg((p - quality) ** 2), 6) AS brier FROM (SELECT quality, least(0.999::DOUBLE, n_chars / 5000.0::DOUBLE) AS p, CAST(floor(least(0.999::DOUBLE, n_chars / 5000.0::DOUBLE) * 10) AS INT) AS bin FROM documents JOIN labels USING (doc_id)) GROUP BY bin"


def calibration_error(spark, sf_dir):
    """Expected calibration error over the bins, and the Brier score of all rows."""
    bins = _judged(spark, sf_dir).groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("c"), F.avg("quality").alias("y"), F.sum(F.pow(F.col("p") - F.col("quality"), 2)).alias("s"))
    return bins.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("y"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("s") / F.sum("n"), 6).alias("brier"))


ECE = "SELECT sum(n)::BIGINT AS n, round(sum(n * abs(c - y)) / sum(n), 6) AS ece, round(sum(s) / sum(n), 6) AS brier FROM (SELECT count(*) AS n, avg(p) AS c, avg(quality) AS y, sum((p - quality) ** 2) AS s FROM (SELECT quality, least(0.999::DOUBLE, n_chars / 5000.0::DOUBLE) AS p FROM documents JOIN labels USING (doc_id)) GROUP BY floor(p * 10))"


def concept_match(spark, sf_dir):
    """Documents that hold a phrase of the registry, word for word: the longest one, then the first.

    Phrases are the benchmark items, whole. Documents and phrases meet on hashes of a phrase's first words (three, or all of
    fewer); where they do, the words that follow are compared.
    """
    words = lambda c: F.filter(F.split(F.lower(c), "[^\\p{L}]+"), lambda x: x != "")
    items = read(spark, sf_dir, "benchmark").select("item_id", words(F.col("text")).alias("p")).where("size(p) > 0")
    items = items.select("item_id", "p", F.least(F.size("p"), F.lit(3)).alias("k"), F.xxhash64(F.array_join(F.slice("p", 1, 3), " ")).alias("h"))
    docs = read(spark, sf_dir, "documents").select("doc_id", words(F.col("text")).alias("w"))
    after = lambda n: F.slice("w", F.lit(n + 1), F.size("w"))
    join = lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b))
    windows = {1: F.col("w")}
    windows[2] = F.zip_with(windows[1], after(1), join)
    windows[3] = F.zip_with(windows[2], after(2), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat_ws(" ", a, b)))
    sizes = [r.k for r in items.select("k").distinct().collect()]  # three at most

    def hashed(k):
        return F.transform(windows[k], lambda x, i: F.struct(F.lit(k).alias("k"), i.alias("at"), F.when(x.isNotNull(), F.xxhash64(x)).alias("h")))

    hashes = [hashed(k) for k in sizes] or [F.array().cast("array<struct<k:int,at:int,h:bigint>>")]
    # Windows travel as numbers; the planner broadcasts the phrases if their table is measured as small.
    grams = docs.where("size(w) > 0").select("doc_id", F.explode(F.concat(*hashes)).alias("g")).select("doc_id", "g.*").where("h IS NOT NULL")
    met = grams.join(items, ["k", "h"]).select("doc_id", "at", "item_id", "p")
    held = met.join(docs, "doc_id").where(F.slice("w", F.col("at") + 1, F.size("p")) == F.col("p"))
    found = held.select("doc_id", "item_id", F.array_join("p", " ").alias("phrase")).distinct()
    return first_ranked(found, ["doc_id"], [F.length("phrase").desc(), F.col("item_id")], 1).select("doc_id", "item_id", "phrase")


CONCEPT = """WITH i AS (SELECT item_id, array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda x: x <> ''), ' ') AS phrase FROM benchmark),
 d AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\\p{L}]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM documents)
 SELECT doc_id, item_id, phrase FROM d JOIN i ON phrase <> '' AND contains(t, ' ' || phrase || ' ') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(phrase) DESC, item_id) = 1"""


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def cosine_knn(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return nearest(v, v.where("vec_id % 20 = 0"), 5)


KNN = """SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) AS rank
 FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 5"""


def similar_pos_neg(spark, sf_dir):
    """Rows by their likeness to the mean of positives less half that to the mean of negatives; the ten best of each label."""
    v = _vectors(spark, sf_dir)
    mean = lambda cond: v.where(cond).select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    both = mean("label = 0").select(F.col("m").alias("pos")).crossJoin(mean("label = 1").select(F.col("m").alias("neg")))  # one row
    score = C.cosine(F.col("embedding"), F.col("pos")) - T.negative_lambda * C.cosine(F.col("embedding"), F.col("neg"))
    rows = v.join(F.broadcast(both)).select("vec_id", "label", F.round(score, 6).alias("score"))
    return first_ranked(rows, ["label"], [F.col("score").desc(), F.col("vec_id")], 10).select("vec_id", "label", "score")


SIMILAR = """WITH m AS (SELECT label, list(x ORDER BY i) AS m FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IN (0, 1)) GROUP BY label, i) GROUP BY label)
 SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT m FROM m WHERE label = 0)) - 0.5::DOUBLE * list_cosine_similarity(embedding::DOUBLE[], (SELECT m FROM m WHERE label = 1)), 6) AS score
 FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 10"""


def percentile_rank(spark, sf_dir):
    """Each row's score against a background of its label, its `background_sample` rows of smallest hashes: the share with at most its score."""
    v = _vectors(spark, sf_dir).select("vec_id", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("score"))
    some = first_ranked(v.withColumn("k", F.sha2(F.col("vec_id").cast("string"), 256)), ["label"], [F.col("k"), F.col("vec_id")], T.background_sample)
    background = some.groupBy("label").agg(F.sort_array(F.collect_list("score")).alias("b"))  # bounded by the sample
    # The number of sorted scores that are at most the row's, by halving.
    halve = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get("b", F.floor((s["lo"] + s["hi"]) / 2).cast("int")) <= F.col("score"), F.struct((F.floor((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))
    steps = F.sequence(F.lit(0), F.lit(T.background_sample.bit_length()))
    share = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size("b").alias("hi")), halve)["lo"] / F.size("b")
    return v.join(background, "label").select("vec_id", "label", "score", F.round(share, 6).alias("percentile"))


PERCENTILE = f"""WITH v AS (SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS score FROM embeddings),
 b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY sha256(vec_id::VARCHAR), vec_id) <= {T.background_sample}), n AS (SELECT label, count(*) AS n FROM b GROUP BY label)
 SELECT v.vec_id, v.label, v.score, round(count(b.vec_id) / any_value(n), 6) AS percentile FROM v JOIN n ON n.label = v.label LEFT JOIN b ON b.label = v.label AND b.score <= v.score GROUP BY 1, 2, 3"""


def monthly_embed(spark, sf_dir):
    """One observation of each tile and month to embed: that with the greatest usable figure, 0.9 at least (of 50 here)."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.date_format("ts", "yyyy-MM").alias("period"), F.get_json_object("props", "$.k").cast("int").alias("k")).where("k >= 0.9 * 50")
    return first_ranked(e, ["user_id", "period"], [F.col("k").desc_nulls_last(), F.col("event_id")], 1).select("user_id", "period", "event_id", "k")


MONTHLY = "SELECT user_id, strftime(ts, '%Y-%m') AS period, event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 45 QUALIFY row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY k DESC NULLS LAST, event_id) = 1"


def watch_hits(spark, sf_dir):
    """Hits of a watch set's rerun (similar rows) that the run before did not have: it searched the archive without its newest rows."""
    v = _vectors(spark, sf_dir)
    queries = v.where("vec_id % 20 = 0")
    before = nearest(v.where("label <> 0"), queries, 5).select("query_id", "vec_id", F.lit(True).alias("old"))
    hits = cosine_knn(spark, sf_dir).select("query_id", "vec_id", "score").join(before, ["query_id", "vec_id"], "left")
    return hits.select("query_id", "vec_id", "score", F.col("old").isNull().alias("is_new"))


HITS = f"""WITH old AS ({KNN.replace("a.vec_id <> b.vec_id QUALIFY", "a.vec_id <> b.vec_id AND b.label <> 0 QUALIFY")})
 SELECT query_id, vec_id, score, (query_id, vec_id) NOT IN (SELECT (query_id, vec_id) FROM old) AS is_new FROM ({KNN})"""


def mmr_rank(spark, sf_dir):
    """Diverse results of each query: of the T.fetch_k nearest outside the exclusion radius, the first five in greedy order of relevance less likeness to what is chosen.

    A query's candidates are few, so each greedy run is one bounded group.
    """
    import numpy as np
    import pandas as pd

    v = _vectors(spark, sf_dir)
    k = 5
    found = nearest(v, v.where("vec_id % 20 = 0"), T.fetch_k).join(v.select("vec_id", "embedding"), "vec_id")
    place = lambda c: (c * 7919 % 20000, c * 104729 % 20000)  # noqa: E731 - where a vector's tile lies, in metres
    (x, y), (qx, qy) = place(F.col("vec_id")), place(F.col("query_id"))
    found = found.where((x - qx) * (x - qx) + (y - qy) * (y - qy) > T.exclusion_radius_m**2)

    def greedy(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["score", "vec_id"], ascending=[False, True]).reset_index(drop=True)
        m = np.stack(f.embedding.to_numpy()).astype(float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        like, chosen = m @ m.T, []
        while len(chosen) < min(k, len(f)):
            worst = like[:, chosen].max(axis=1) if chosen else np.zeros(len(f))
            value = T.mmr_lambda * f.score.to_numpy() - (1 - T.mmr_lambda) * worst
            value[chosen] = -np.inf
            chosen.append(int(value.argmax()))
        return pd.DataFrame({"query_id": f.query_id[chosen].to_numpy(), "vec_id": f.vec_id[chosen].to_numpy(), "place": range(1, len(chosen) + 1)})

    return found.groupBy("query_id").applyInPandas(greedy, "query_id long, vec_id long, place int")


def kmeans_gallery(spark, sf_dir):
    """k-means clusters of all vectors with each row's distance to its centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = _vectors(spark, sf_dir).select("vec_id", array_to_vector("embedding").alias("features"))
    model = KMeans(k=6, seed=42, maxIter=10).fit(rows)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    out = model.transform(rows).select("vec_id", F.col("prediction").alias("cluster"), vector_to_array("features").alias("v"))
    d2 = F.aggregate(F.zip_with("v", F.get(centres, F.col("cluster")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return out.select("vec_id", "cluster", F.round(F.sqrt(d2), 6).alias("distance"))


def land_cover_model(spark, sf_dir):
    """A forest trained on the dev blocks and applied to all rows, with class weights."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = _vectors(spark, sf_dir).select("vec_id", array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("label"), (C.unit_hash(F.lit("salt"), F.col("vec_id")) < 0.3).alias("test"))
    weights = rows.where("NOT test").groupBy("label").agg((F.lit(1.0) / F.count("*")).alias("weight"))
    model = RandomForestClassifier(numTrees=20, maxDepth=6, seed=42, weightCol="weight").fit(rows.where("NOT test").join(weights, "label"))
    return model.transform(rows).select("vec_id", "test", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))


def phase_shift(spark, sf_dir):
    """The shift between each observation's raster and the first one's, from windows of 24 cells, and its status."""
    g = _raster(spark, sf_dir)
    first = g.where("obs = 1").select("r", "c", F.col("v").alias("ref"))
    both = g.join(first, ["r", "c"]).withColumn("ok", F.lit(True))
    found = g.select("obs").distinct().join(P.registration(P.window_shifts(both, 48, 48, 24)), "obs", "left")
    status = C.registration(F.coalesce("n_windows", F.lit(0)).cast("int"), F.hypot("dy", "dx"), F.col("peak"))
    return found.select("obs", F.coalesce("n_windows", F.lit(0)).alias("n_windows"), *[F.round(c, 4).alias(c) for c in ("dy", "dx", "residual", "peak")], status.alias("status"))


def mask_shift(spark, sf_dir):
    """A mask moved to the nearest cells; places that come from outside are no data."""
    cells = _raster(spark, sf_dir).select("obs", "r", "c", F.when(F.col("v") > 40, CLOUD).otherwise(0).alias("v"))
    return P.shifted(cells, 1.6, -0.7, 48, nearest=True, fill=1).select("obs", "r", "c", F.col("v").cast("int").alias("mask"))


MASK_SHIFT = f"""WITH g AS ({RASTER}) SELECT o.obs, a.r, b.c, coalesce(CASE WHEN v > 40 THEN 4 WHEN v IS NOT NULL THEN 0 END, 1)::INT AS mask FROM (SELECT DISTINCT obs FROM g) o CROSS JOIN (SELECT range::INT AS r FROM range(48)) a CROSS JOIN (SELECT range::INT AS c FROM range(48)) b
 LEFT JOIN g ON g.obs = o.obs AND g.r = a.r - 2 AND g.c = b.c + 1"""


def registration_status(spark, sf_dir):
    """Registration status and usability of observations from their measured figures."""
    e = read(spark, sf_dir, "events").select("event_id", "value", "user_id")
    status = C.registration((F.col("event_id") % 4).cast("int"), F.col("value") / 40, F.col("user_id") % 9 + 1)
    rows = e.select("event_id", "value", status.alias("status"))
    return rows.select("event_id", "status", C.usability(F.col("value") / 100, F.col("status")).alias("usable"))


REGISTRATION = """SELECT event_id, status, CASE WHEN value / 100 < 0.05 THEN 'low_usable_fraction' WHEN status IN ('unusable','suspect') THEN 'registration_' || status ELSE 'usable' END AS usable FROM (SELECT event_id, value,
 CASE WHEN event_id % 4 = 0 THEN 'suspect' WHEN value / 40 > 2 OR user_id % 9 + 1 < 3 THEN 'unusable' WHEN value / 40 >= 0.1 THEN 'corrected' ELSE 'ok' END AS status FROM events)"""

QUERIES = {
    "core_tile": core_tile, "pixel_tile_overlay": tile_overlay, "priority_zone_flag": zone_flags, "aoi_intersect": aoi_intersect, "near_layer": near_layer, "peer_departure": peer_departure,
    "split_assign": split_assign, "dilate": dilate, "opening": opening, "components": components, "shadow_project": shadow_project, "local_sigma": local_sigma, "strong_edges": strong_edges, "edge_flag": edge_flag,
    "terrain": terrain, "overviews": overviews, "apply_shift": apply_shift, "vote_mask": vote_mask, "first_change": first_change, "object_series": object_series, "area_range": area_range,
    "stable_window": stable_window, "bracket_gap": bracket_gap, "same_season": same_season, "state_machine": state_machine, "gate_funnel": gate_funnel, "review_rank": review_rank,
    "calibration_bins": calibration_bins, "calibration_error": calibration_error, "concept_match": concept_match, "cosine_knn": cosine_knn, "similar_pos_neg": similar_pos_neg, "percentile_rank": percentile_rank, "monthly_embed": monthly_embed,
    "watch_hits": watch_hits, "mmr_rank": mmr_rank, "kmeans_gallery": kmeans_gallery, "rf_train_predict": land_cover_model, "phase_shift": phase_shift, "mask_shift": mask_shift, "registration_status": registration_status,
}
ORACLE = {
    "core_tile": CORE, "pixel_tile_overlay": OVERLAY, "priority_zone_flag": ZONE_FLAGS, "aoi_intersect": INTERSECT, "near_layer": NEAR, "peer_departure": PEERS, "split_assign": SPLIT,
    "dilate": f"SELECT DISTINCT r + dr AS r, c + dc AS c FROM ({CELLS}), (VALUES {_SQ}) o(dr, dc) WHERE r + dr BETWEEN 0 AND 60 AND c + dc BETWEEN 0 AND 52",
    "opening": OPENING, "components": COMPONENTS, "shadow_project": SHADOW, "local_sigma": SIGMA, "strong_edges": EDGES, "edge_flag": EDGE_FLAG, "terrain": TERRAIN, "overviews": OVERVIEWS, "apply_shift": SHIFT,
    "vote_mask": VOTE, "first_change": FIRST, "object_series": OBJECT, "area_range": AREA, "stable_window": STABLE, "bracket_gap": GAP, "same_season": SEASON, "state_machine": STATE,
    "gate_funnel": FUNNEL, "review_rank": REVIEW, "calibration_bins": CALIBRATION, "calibration_error": ECE, "concept_match": CONCEPT, "cosine_knn": KNN, "similar_pos_neg": SIMILAR, "percentile_rank": PERCENTILE,
    "monthly_embed": MONTHLY, "mask_shift": MASK_SHIFT, "watch_hits": HITS, "registration_status": REGISTRATION,
}
