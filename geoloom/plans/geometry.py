"""Queries over outlines, warps, boxes, names and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import columns as C
from geoloom.operators import geometry as G
from geoloom.operators import grid as K
from geoloom.operators import raster as R
from geoloom.plans.change import CELLS, RASTER, _cells, _raster
from geoloom.plans.grid import SCENE, scene
from geoloom.plans.pixel import MNDWI, NDVI
from geoloom.sources.fixtures import PIXELS, pixels, read


def warp_nearest(spark, sf_dir):
    return G.warp(_raster(spark, sf_dir), 0.7, 60, 60).select("obs", "r", "c", F.round("v", 8).alias("v"))


def warp_bilinear(spark, sf_dir):
    return G.warp(_raster(spark, sf_dir), 0.7, 60, 60, True).select("obs", "r", "c", F.round(F.col("v") + 1e-9, 4).alias("v"))


_TARGET = f"SELECT obs, r, c FROM (SELECT DISTINCT obs FROM g) o, (SELECT range::INT AS r FROM range(60)) a, (SELECT range::INT AS c FROM range(60)) b"
NEAREST = f"WITH g AS ({RASTER}) SELECT t.obs, t.r, t.c, round(g.v, 8) AS v FROM ({_TARGET}) t JOIN g ON g.obs = t.obs AND g.r = floor((t.r + 0.5) * 0.7::DOUBLE)::INT AND g.c = floor((t.c + 0.5) * 0.7::DOUBLE)::INT"
BILINEAR = f"""WITH g AS ({RASTER}), t AS (SELECT *, (r + 0.5) * 0.7::DOUBLE - 0.5 AS y, (c + 0.5) * 0.7::DOUBLE - 0.5 AS x FROM ({_TARGET})),
 k AS (SELECT t.obs, t.r, t.c, floor(y)::INT + i AS sr, floor(x)::INT + j AS sc, (CASE WHEN i = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE WHEN j = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) AS w FROM t, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j))
 SELECT k.obs, k.r, k.c, round(sum(w * v) / sum(w) + 1e-9, 4) AS v FROM k JOIN g ON g.obs = k.obs AND g.r = sr AND g.c = sc WHERE w > 0 GROUP BY 1, 2, 3"""


#: The raster in degrees over an area, and the area's grid in metres, wider than the raster so that its edge is met.
DEGREES = G.Grid(81.47, 20.65, 0.0028, 48, 48)
METRES = G.Grid(548800.0, 2283520.0, 250.0, 50, 60)


def reproject_nearest(spark, sf_dir):
    return G.reproject(_raster(spark, sf_dir), DEGREES, METRES).select("obs", "r", "c", F.round("v", 8).alias("v"))


def reproject_bilinear(spark, sf_dir):
    return G.reproject(_raster(spark, sf_dir), DEGREES, METRES, True).select("obs", "r", "c", F.round(F.col("v") + 1e-9, 4).alias("v"))


def area_resample(spark, sf_dir):
    return G.averaged(_raster(spark, sf_dir), 1.5).select("obs", "r", "c", F.round(F.col("v") + 1e-9, 4).alias("v"))


_D = "::DOUBLE"
_XI = [f"- {b!r}{_D} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(K.BETA, 1)]
_ETA = [f"- {b!r}{_D} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(K.BETA, 1)]
_PHI = [f"+ {d!r}{_D} * sin({2 * j} * chi)" for j, d in enumerate(K.DELTA, 1)]
_PLACES = f"""g AS ({RASTER}), m AS (SELECT obs, r, c, ({METRES.y0} - (r + 0.5) * {METRES.step}){_D} / {K.SCALE * K.RADIUS!r}{_D} AS xi, ({METRES.x0} + (c + 0.5) * {METRES.step} - {K.EASTING}){_D} / {K.SCALE * K.RADIUS!r}{_D} AS eta
  FROM (SELECT DISTINCT obs FROM g), (SELECT range::INT AS r FROM range({METRES.rows})), (SELECT range::INT AS c FROM range({METRES.columns}))),
 k AS (SELECT obs, r, c, xi {" ".join(_XI)} AS x, eta {" ".join(_ETA)} AS e FROM m), n AS (SELECT *, asin(sin(x) / cosh(e)) AS chi FROM k),
 p AS (SELECT obs, r, c, ({DEGREES.y0}{_D} - degrees(chi {" ".join(_PHI)})) / {DEGREES.step}{_D} AS y, ({K.CENTRE}{_D} + degrees(atan2(sinh(e), cos(x))) - {DEGREES.x0}{_D}) / {DEGREES.step}{_D} AS x FROM n)"""
REPROJECT = f"WITH {_PLACES} SELECT p.obs, p.r, p.c, round(coalesce(g.v, 0), 8) AS v FROM p LEFT JOIN g ON g.obs = p.obs AND g.r = floor(y)::INT AND g.c = floor(x)::INT"
REPROJECT_BILINEAR = f"""WITH {_PLACES}, q AS (SELECT obs, r, c, floor(y - 0.5)::INT + i AS sr, floor(x - 0.5)::INT + j AS sc, (CASE WHEN i = 0 THEN 1 - (y - 0.5 - floor(y - 0.5)) ELSE y - 0.5 - floor(y - 0.5) END) * (CASE WHEN j = 0 THEN 1 - (x - 0.5 - floor(x - 0.5)) ELSE x - 0.5 - floor(x - 0.5) END) AS w FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j))
 SELECT q.obs, q.r, q.c, round(CASE WHEN sum(w) FILTER (v IS NOT NULL) > 0 THEN sum(w * v) / sum(w) FILTER (v IS NOT NULL) ELSE 0 END + 1e-9, 4) AS v FROM q LEFT JOIN g ON g.obs = q.obs AND g.r = sr AND g.c = sc GROUP BY 1, 2, 3"""
AREA_MEAN = f"""WITH g AS ({RASTER}), t AS (SELECT range::INT AS cell, range * 1.5{_D} AS a, (range + 1) * 1.5{_D} AS b FROM range(32)),
 o AS (SELECT s.range::INT AS i, cell, least(b, s.range + 1) - greatest(a, s.range) AS w FROM range(48) s JOIN t ON s.range < b AND s.range + 1 > a)
 SELECT obs, y.cell AS r, x.cell AS c, round(sum(y.w * x.w * v) / sum(y.w * x.w) + 1e-9, 4) AS v FROM g JOIN o y ON y.i = g.r JOIN o x ON x.i = g.c GROUP BY 1, 2, 3"""


def window_subset(spark, sf_dir):
    return G.window(_raster(spark, sf_dir), 8, 4, 20, 30).select("obs", "r", "c", F.round("v", 8).alias("v"))


WINDOW = f"SELECT obs, r - 8 AS r, c - 4 AS c, round(v, 8) AS v FROM ({RASTER}) WHERE r BETWEEN 8 AND 27 AND c BETWEEN 4 AND 33"


def outlines(spark, sf_dir):
    """Area and perimeter of the outline of every component of cells, from its traced rings."""
    return G.outlines(R.components(_cells(spark, sf_dir))).select("label", F.round("area", 4).alias("area"), F.round("perimeter", 4).alias("perimeter"))


OUTLINES = f"""WITH RECURSIVE s AS ({CELLS}), k AS (SELECT r * 1048576::BIGINT + c AS a, r, c FROM s), e AS (SELECT a.a, b.a AS b FROM k a JOIN k b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
 reach(a, b) AS (SELECT a, a FROM k UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b), l AS (SELECT a, min(b) AS label FROM reach GROUP BY a)
 SELECT label, round(count(*)::DOUBLE, 4) AS area, round(sum(4 - (SELECT count(*) FROM e WHERE e.a = l.a))::DOUBLE, 4) AS perimeter FROM l GROUP BY label"""

#: Boxes of events, rows and columns from and to (excluded), and what is measured in them.
BOXES = [(1, 2, 3, 14, 20, "water"), (2, 10, 10, 30, 40, "nonveg"), (3, 0, 20, 25, 47, "veg")]


def box_measures(spark, sf_dir):
    """Area of water, bare or green ground in each event's box by observation, where at least 0.8 of it is usable."""
    raw = scene(spark, sf_dir)
    boxes = spark.createDataFrame(BOXES, "box int, r0 int, c0 int, r1 int, c1 int, measure string")
    ok = ~F.col("scl").isin(0, 1, 3)
    hit = F.when(F.col("measure") == "water", C.mndwi() > 0.1).when(F.col("measure") == "nonveg", (C.ndvi() < 0.2) & (C.mndwi() < 0)).otherwise(C.ndvi() >= 0.4)
    out = G.in_box(raw, boxes).groupBy("box", "obs").agg(F.avg(ok.cast("double")).alias("usable"), F.sum((hit & ok).cast("int")).alias("n"))
    return out.select("box", "obs", F.round("usable", 3).alias("usable_share"), F.when(F.col("usable") >= 0.8, F.round(F.col("n") * 0.04, 2)).alias("value_ha"))


_BOX = ", ".join(f"({b}, {r0}, {c0}, {r1}, {c1}, '{m}')" for b, r0, c0, r1, c1, m in BOXES)
BOX = f"""SELECT box, obs, round(avg(ok::INT), 3) AS usable_share, CASE WHEN avg(ok::INT) >= 0.8 THEN round(sum((ok AND CASE measure WHEN 'water' THEN {MNDWI} > 0.1 WHEN 'nonveg' THEN {NDVI} < 0.2 AND {MNDWI} < 0 ELSE {NDVI} >= 0.4 END)::INT) * 0.04::DOUBLE, 2) END AS value_ha
 FROM (SELECT *, scl NOT IN (0, 1, 3) AS ok FROM ({SCENE})), (VALUES {_BOX}) b(box, r0, c0, r1, c1, measure) WHERE r >= r0 AND r < r1 AND c >= c0 AND c < c1 GROUP BY box, obs"""


def tile_names(spark, sf_dir):
    """Names of the land-cover (3 degrees) and elevation (1 degree) tiles of each place, and a path in a cache."""
    lat, lon = 20 + (F.col("c_custkey") * 7919 % 10000) / 1000, 75 + (F.col("c_custkey") * 104729 % 10000) / 500
    names = read(spark, sf_dir, "customer").select("c_custkey", G.tile_name("cover_", lat, lon, 3).alias("cover"), G.tile_name("dem_", lat, lon, 1).alias("dem"))
    return names.select("*", F.replace(F.concat(F.lit("/store/tiles/"), "dem", F.lit(".tif")), F.lit("/tiles/"), F.lit("/cache/")).alias("path"))


def _name(prefix, step):
    return f"'{prefix}N' || lpad(CAST(CAST(floor((20 + (c_custkey * 7919 % 10000) / 1000.0::DOUBLE) / {step}) * {step} AS BIGINT) AS VARCHAR), 2, '0') || 'E' || lpad(CAST(CAST(floor((75 + (c_custkey * 104729 % 10000) / 500.0::DOUBLE) / {step}) * {step} AS BIGINT) AS VARCHAR), 3, '0')"


NAMES = f"SELECT c_custkey, {_name('cover_', 3)} AS cover, {_name('dem_', 1)} AS dem, '/store/cache/' || {_name('dem_', 1)} || '.tif' AS path FROM customer"


def vector_round_trip(spark, sf_dir):
    """Vectors as text of six significant digits and read again: how many numbers they have, and their sum."""
    v = read(spark, sf_dir, "embeddings").select("vec_id", G.parse_vector(G.vector_text(F.col("embedding"))).alias("v"))
    return v.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


VECTOR = "SELECT vec_id, len(embedding)::INT AS n, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x = 0 THEN 0 ELSE round_even(x * 10.0::DOUBLE ** (5 - floor(log10(abs(x)))), 0) / 10.0::DOUBLE ** (5 - floor(log10(abs(x)))) END)), 4) AS total FROM embeddings"


def missing_features(spark, sf_dir):
    """A model's probability for the rows that have all features; the others keep their place without one."""
    nothing = lambda b: F.nullif(F.col(b), F.lit(0))
    rows = pixels(spark, sf_dir).select("obs_id", "px", *[(nothing(b) / 10000).alias(b) for b in ("b02", "b04", "b08")])
    score = 1 / (1 + F.exp(-(F.col("b08") * 4 - F.col("b04") * 3 - F.col("b02"))))
    return rows.select("obs_id", "px", F.round(score, 6).alias("p"), F.when(score.isNull(), 255).otherwise(F.rint(score * 250)).cast("int").alias("stored"))


MISSING = f"""SELECT obs_id, px, round(p, 6) AS p, CASE WHEN p IS NULL THEN 255 ELSE round_even(p * 250, 0) END::INT AS stored FROM (SELECT obs_id, px,
 1 / (1 + exp(-(nullif(b08, 0) / 10000.0::DOUBLE * 4 - nullif(b04, 0) / 10000.0::DOUBLE * 3 - nullif(b02, 0) / 10000.0::DOUBLE))) AS p FROM ({PIXELS}))"""

QUERIES = {
    "warp_nearest": warp_nearest, "warp_bilinear": warp_bilinear, "reproject_nearest": reproject_nearest, "reproject_bilinear": reproject_bilinear, "area_resample": area_resample, "window_subset": window_subset, "outlines": outlines, "box_measures": box_measures, "tile_names": tile_names,
    "vector_round_trip": vector_round_trip, "missing_features": missing_features,
}
ORACLE = {
    "warp_nearest": NEAREST, "warp_bilinear": BILINEAR, "reproject_nearest": REPROJECT, "reproject_bilinear": REPROJECT_BILINEAR, "area_resample": AREA_MEAN, "window_subset": WINDOW, "outlines": OUTLINES, "box_measures": BOX, "tile_names": NAMES,
    "vector_round_trip": VECTOR, "missing_features": MISSING,
}
