"""Queries that fit: boosted land-cover classes, calibrated confidences, invariant-pixel lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import columns as C
from geoloom.operators import boosting as B
from geoloom.operators import calibration as K
from geoloom.operators import normalise as N
from geoloom.operators.geometry import outlines
from geoloom.operators.raster import components
from geoloom.plans.change import _from
from geoloom.plans.pixel import BANDS, LABEL, MNDWI, NDBI, NDVI
from geoloom.sources.fixtures import pixels, read

CLASSES, ROUNDS, DEPTH, BINS = 5, 6, 3, 32


def samples(spark, sf_dir):
    """label, features (reflectances, four indices, brightness) and whether the block is one of the test split."""
    bright = (F.col("b02") + F.col("b03") + F.col("b04")) / 30000
    features = F.array(*[F.col(b) / 10000 for b in BANDS], C.ndvi(), C.mndwi(), C.ndbi(), C.bsi(), bright)
    test = C.unit_hash(F.lit("block"), F.floor(F.col("obs_id") / 64)) < 0.3
    label = C.refine_label(F.col("cover"), C.ndvi(), C.mndwi())
    return pixels(spark, sf_dir).select("obs_id", "px", label.alias("label"), features.alias("features"), test.alias("test")).where("label >= 0")


def land_cover_boosted(spark, sf_dir):
    """The confusion of boosted trees on the test blocks, trained on all pixels of the others with class weights; accuracy and macro-F1."""
    rows = samples(spark, sf_dir)
    dev = rows.where("NOT test")
    counts = dev.groupBy("label").agg(F.count("*").alias("n"))  # a few classes
    total = dev.count()
    weights = counts.select("label", (F.lit(float(total)) / (F.lit(float(CLASSES)) * F.col("n"))).alias("weight"))
    model = B.fit(dev.join(F.broadcast(weights), "label"), CLASSES, ROUNDS, DEPTH, BINS)
    judged = B.predict(rows.where("test"), model)
    out = B.evaluation(judged, F.col("label"), F.col("predicted"))
    return out.select("label", "predicted", "n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def _labelled(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 10000).alias("length"), ((F.col("doc_id") % 10) / 10).alias("place"))
    return d, d.join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


def calibrated_confidence(spark, sf_dir):
    """Each document's calibrated probability of quality, its features' contributions to the log-odds, and its level; none below 200 labels."""
    d, known = _labelled(spark, sf_dir)
    fit = K.fit(known, "y", ["length", "place"])
    p = fit.probability()
    part = lambda f: F.when(F.lit(fit.shown), F.round(fit.contribution(f), 6)).alias(f"c_{f}")
    return d.select("doc_id", part("length"), part("place"), F.round(p, 6).alias("p"), K.level(p, F.col("doc_id") % 3 == 0).alias("level"))


def _newton(i: int) -> str:
    det = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
    h = ["h00", "h01", "h02", "h01", "h11", "h12", "h02", "h12", "h22"]

    def put(column: int) -> str:
        return det([f"g{k // 3}" if k % 3 == column else x for k, x in enumerate(h)])

    sums = ", ".join([f"sum((y - p) * x{j}) AS g{j}" for j in range(3)] + [f"sum(p * (1 - p) * x{a} * x{b}) AS h{a}{b}" for a in range(3) for b in range(a, 3)])
    inner = f"SELECT x0, x1, x2, y, 1 / (1 + exp(-(b0 * x0 + b1 * x1 + b2 * x2))) AS p, b0, b1, b2 FROM k, b{i}"
    return f"b{i + 1} AS MATERIALIZED (SELECT {', '.join(f'b{j} + {put(j)} / {det(h)} AS b{j}' for j in range(3))} FROM (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, {sums} FROM ({inner})))"


_STEPS = 9
CALIBRATED = f"""WITH d AS (SELECT doc_id, 1.0::DOUBLE AS x0, n_chars / 10000.0::DOUBLE AS x1, (doc_id % 10) / 10.0::DOUBLE AS x2 FROM documents), k AS MATERIALIZED (SELECT d.*, quality::DOUBLE AS y FROM d JOIN labels USING (doc_id)),
 b0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2), {", ".join(_newton(i) for i in range(_STEPS))},
 s AS (SELECT doc_id, b1 * x1 AS c1, b2 * x2 AS c2, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p, (SELECT count(*) FROM k) >= {K.LEAST_LABELS} AS shown FROM d, b{_STEPS})
 SELECT doc_id, CASE WHEN shown THEN round(c1, 6) END AS c_length, CASE WHEN shown THEN round(c2, 6) END AS c_place, CASE WHEN shown THEN round(p, 6) END AS p,
  CASE WHEN NOT shown THEN NULL WHEN p < 0.4 THEN 'LOW' WHEN p < 0.7 OR doc_id % 3 <> 0 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM s"""

#: Two areas' ground, and two observations of it: brighter by a hundredth for each, with small noise, and a tenth of the pixels changed.
GROUND = """SELECT CAST(l_suppkey % 2 AS INT) AS aoi, CAST(l_orderkey % 48 AS INT) AS r, CAST(l_partkey % 48 AS INT) AS c, CAST(max(floor(l_quantity * 60)) + 300 AS INT) AS b02, CAST(max(floor(l_extendedprice / 20)) + 300 AS INT) AS b03,
 CAST(min(floor(l_discount * 30000)) + 300 AS INT) AS b04, CAST(max(floor(l_tax * 50000)) + 900 AS INT) AS b08, CAST(max(l_partkey % 4001) + 300 AS INT) AS b11, CAST(max(l_suppkey % 3001) + 300 AS INT) AS b12 FROM lineitem GROUP BY 1, 2, 3"""
_NOISE = "(r * 7 + c * 13 + obs * 11 + {k} * 5) % 50 - 25"
SEEN = f"""SELECT aoi, obs, r, c, {", ".join(f"CAST(floor({b} * (100 + obs) / 100) + {_NOISE.format(k=k)} AS INT)" + (" * (CASE WHEN (r * 31 + c * 17 + obs) % 10 = 0 THEN 2 ELSE 1 END)" if b == "b08" else "") + f" AS {b}" for k, b in enumerate(BANDS))},
 (r + c * 3 + obs) % 11 <> 0 AS usable FROM (SELECT g.*, CAST(r_regionkey AS INT) AS obs FROM ground g, region WHERE r_regionkey BETWEEN 1 AND 2) t"""


def invariant_fit(spark, sf_dir):
    """The line of each band, observation and area to the area's reference over its invariant pixels, and the greatest residual."""
    ground = _from(spark, sf_dir, GROUND, "lineitem")
    seen = spark.sql(SEEN.replace("FROM ground g, region", "FROM {g} g, {n}"), g=ground, n=read(spark, sf_dir, "region"))
    share = lambda df: df.withColumns({b: F.col(b) / 10000 for b in BANDS})
    out = N.fits(N.invariant(share(ground), share(seen)))
    return out.select("aoi", "obs", "band", "n_pif", *[F.round(c, 6).alias(c) for c in ("gain", "offset", "rmse")])


_SHARE = ", ".join(f"{b} / 10000.0::DOUBLE AS {b}" for b in BANDS)
INVARIANT = f"""WITH ground AS ({GROUND}), seen AS ({SEEN}), g AS (SELECT aoi, r, c, {_SHARE} FROM ground), o AS (SELECT aoi, obs, r, c, {_SHARE} FROM seen WHERE usable),
 gi AS (SELECT *, {NDVI} AS i1, {NDBI} AS i2, {MNDWI} AS i3 FROM g), oi AS (SELECT *, {NDVI} AS i1, {NDBI} AS i2, {MNDWI} AS i3 FROM o),
 s AS (SELECT oi.aoi, oi.obs, oi.r, oi.c, {", ".join(f"oi.{b} AS y_{b}, gi.{b} AS x_{b}" for b in BANDS)}, count(*) OVER (PARTITION BY oi.aoi, oi.obs) AS n_pif FROM oi JOIN gi ON gi.aoi = oi.aoi AND gi.r = oi.r AND gi.c = oi.c
  WHERE abs(oi.i1 - gi.i1) < {N.STABLE} AND abs(oi.i2 - gi.i2) < {N.STABLE} AND abs(oi.i3 - gi.i3) < {N.STABLE}),
 t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY aoi, obs ORDER BY sha256(aoi || '-' || obs || '-' || r || '-' || c), r, c) AS n FROM s WHERE n_pif >= {N.T.invariant_least} QUALIFY n <= {N.T.invariant_cap}),
 u AS MATERIALIZED ({" UNION ALL ".join(f"SELECT aoi, obs, '{b}' AS band, n, n_pif, x_{b} AS x, y_{b} AS y FROM t" for b in BANDS)}),
 p AS (SELECT a.aoi, a.obs, a.band, median((b.x - a.x) / (b.y - a.y)) AS gain FROM u a JOIN u b ON a.aoi = b.aoi AND a.obs = b.obs AND a.band = b.band AND a.n < b.n AND a.y <> b.y GROUP BY 1, 2, 3),
 f AS (SELECT u.aoi, u.obs, u.band, max(n_pif) AS n_pif, any_value(gain) AS gain, median(x) - any_value(gain) * median(y) AS "offset" FROM u JOIN p ON p.aoi = u.aoi AND p.obs = u.obs AND p.band = u.band GROUP BY 1, 2, 3)
 SELECT f.aoi, f.obs, f.band, f.n_pif, round(gain, 6) AS gain, round("offset", 6) AS "offset", round(sqrt(avg((gain * y + "offset" - x) ** 2)), 6) AS rmse FROM f JOIN u ON u.aoi = f.aoi AND u.obs = f.obs AND u.band = f.band GROUP BY f.aoi, f.obs, f.band, f.n_pif, gain, "offset" """

#: Land cover and usable places, each its own raster of one cell a place.
COVER = """SELECT CAST(o_orderkey % 48 AS INT) AS r, CAST(o_custkey % 48 AS INT) AS c, min([10, 20, 30, 50, 60, 80, 90][CAST(o_orderkey % 7 AS INT) + 1]) AS cover FROM orders GROUP BY 1, 2"""
USABLE = "SELECT CAST(event_id % 48 AS INT) AS r, CAST(user_id % 48 AS INT) AS c, count(*) AS seen FROM events WHERE event_type <> 'error' GROUP BY 1, 2"
CORE = 12  # cells of a tile's core here


def training_pixels(spark, sf_dir):
    """Pixels of each area, split and refined label, with their mean NDVI: reflectance, land cover, mask and split meet by their place.

    The split is that of the place's block, by a hash; places that the mask or the cover lacks teach nothing.
    """
    ground = _from(spark, sf_dir, GROUND, "lineitem")
    cover = spark.sql(COVER.replace("FROM orders", "FROM {t}").replace("[10, 20, 30, 50, 60, 80, 90][CAST(o_orderkey % 7 AS INT) + 1]", "array(10, 20, 30, 50, 60, 80, 90)[CAST(o_orderkey % 7 AS INT)]"), t=read(spark, sf_dir, "orders"))
    usable = _from(spark, sf_dir, USABLE, "events")
    block = [F.floor(F.col(x) / CORE).cast("int") for x in ("r", "c")]
    split = ground.select("r", "c").distinct().withColumn("split", F.when(C.unit_hash(F.lit("geoloom"), *block) < 0.3, "test").otherwise("dev"))
    rows = ground.join(cover, ["r", "c"]).join(usable, ["r", "c"], "left_semi").join(split, ["r", "c"])
    label = C.refine_label(F.col("cover"), C.ndvi(), C.mndwi())
    out = rows.select("aoi", "split", label.alias("label"), C.ndvi().alias("v")).where("label >= 0")
    return out.groupBy("aoi", "split", "label").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("ndvi"))


TRAINING = f"""SELECT aoi, split, label, count(*) AS n, round(avg(v), 6) AS ndvi FROM (SELECT aoi, {LABEL} AS label, {NDVI} AS v,
  CASE WHEN ('0x' || substr(sha256('geoloom-' || r // {CORE} || '-' || c // {CORE}), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.3 THEN 'test' ELSE 'dev' END AS split
  FROM ({GROUND}) JOIN ({COVER}) USING (r, c) SEMI JOIN ({USABLE}) USING (r, c)) WHERE label >= 0 GROUP BY 1, 2, 3"""

#: Square metres of a cell of the water raster, and the least area of a reference body of water.
CELL_M2, LEAST_WATER_M2 = 10_000, 40_000
GREEN_SWIR = "SELECT CAST(l_orderkey % 48 AS INT) AS r, CAST(l_partkey % 48 AS INT) AS c, CAST(min(floor(l_extendedprice / 40)) AS INT) AS b03, CAST(min(l_partkey % 4001) AS INT) AS b11 FROM lineitem GROUP BY 1, 2"


def water_polygons(spark, sf_dir):
    """The bodies of water (MNDWI above 0.1) of the least area or more: cells, area and perimeter of their outlines."""
    wet = _from(spark, sf_dir, GREEN_SWIR, "lineitem").where(C.mndwi() > 0.1).select("r", "c")
    out = outlines(components(wet), CELL_M2**0.5).where(F.col("area") >= LEAST_WATER_M2)
    return out.select("label", F.round("area", 2).alias("area"), F.round("perimeter", 2).alias("perimeter"), (F.col("area") / CELL_M2).cast("long").alias("cells"))


WATER_BODIES = f"""WITH RECURSIVE k AS MATERIALIZED (SELECT r * 1048576::BIGINT + c AS a, r, c FROM ({GREEN_SWIR}) WHERE {MNDWI} > 0.1), e AS MATERIALIZED (SELECT p.a, q.a AS b FROM k p JOIN k q ON abs(p.r - q.r) + abs(p.c - q.c) = 1),
 reach(a, b) AS (SELECT a, a FROM k UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b), l AS (SELECT a, min(b) AS label FROM reach GROUP BY a)
 SELECT label, round(count(*)::DOUBLE * {CELL_M2}, 2) AS area, round(sum(4 - (SELECT count(*) FROM e WHERE e.a = l.a))::DOUBLE * sqrt({CELL_M2}::DOUBLE), 2) AS perimeter, count(*) AS cells FROM l GROUP BY label HAVING count(*) * {CELL_M2} >= {LEAST_WATER_M2}"""

QUERIES = {"training_pixels": training_pixels, "water_polygons": water_polygons, "land_cover_boosted": land_cover_boosted, "calibrated_confidence": calibrated_confidence, "invariant_fit": invariant_fit}
ORACLE = {"training_pixels": TRAINING, "water_polygons": WATER_BODIES, "calibrated_confidence": CALIBRATED, "invariant_fit": INVARIANT}
