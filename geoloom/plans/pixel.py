"""Queries over pixels: radiometry, indices, labels, quality statistics and classification figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.config import T
from geoloom.functions import columns as C
from geoloom.operators.timeline import first_ranked
from geoloom.sources.fixtures import PIXELS, observations, pixels, read

BANDS = ["b02", "b03", "b04", "b08", "b11", "b12"]
ND = "CASE WHEN ({a}) + ({b}) = 0 THEN 0.0 ELSE CAST(({a}) - ({b}) AS DOUBLE) / (({a}) + ({b})) END"


def nd(a: str, b: str) -> str:
    return ND.format(a=a, b=b)


NDVI, MNDWI, NDBI, BSI = nd("b08", "b04"), nd("b03", "b11"), nd("b11", "b08"), nd("b11 + b04", "b08 + b02")


def spectral_indices(spark, sf_dir):
    """The four indices of every pixel."""
    made = {"ndvi": C.ndvi(), "mndwi": C.mndwi(), "ndbi": C.ndbi(), "bsi": C.bsi()}
    return pixels(spark, sf_dir).select("obs_id", "px", *BANDS, *[F.round(c, 6).alias(n) for n, c in made.items()])


SPECTRAL = f"""SELECT obs_id, px, b02, b03, b04, b08, b11, b12, round({NDVI}, 6) AS ndvi, round({MNDWI}, 6) AS mndwi,
 round({NDBI}, 6) AS ndbi, round({BSI}, 6) AS bsi FROM ({PIXELS})"""


def standardise_dn(spark, sf_dir):
    """Digital numbers to reflectance with an offset: no data, saturation and floored values as defined for all bands together."""
    valid = F.least(*BANDS) > 0
    refl = lambda b: F.when(valid, F.greatest((F.col(b) - 1000) / 10000, F.lit(0.0001)))
    floored = F.when(valid, sum((F.col(b) <= 1000).cast("int") for b in BANDS)).otherwise(0)
    saturated = (F.greatest(*BANDS) >= T.saturation_dn).cast("int")
    return pixels(spark, sf_dir).select(
        "obs_id", "px", *[C.to_uint16(refl(b)).alias(f"s_{b}") for b in BANDS], floored.alias("floored"), saturated.alias("saturated"),
        F.round(C.from_uint16(C.to_uint16(refl("b08"))), 6).alias("back_b08"),
    )


def _refl(b):
    return f"CASE WHEN least(b02,b03,b04,b08,b11,b12) > 0 THEN greatest(({b} - 1000) / 10000.0::DOUBLE, 0.0001) END"


def _u16(b):
    return f"coalesce(CAST(greatest(1, least(65534, round_even(({_refl(b)}) * 10000, 0))) AS INT), 0)"


def _u16n(b):
    return f"CASE WHEN ({_refl(b)}) IS NULL THEN 0 ELSE {_u16(b)} END"


STANDARDISE = f"""SELECT obs_id, px, {", ".join(f"{_u16n(b)} AS s_{b}" for b in BANDS)},
 CASE WHEN least(b02,b03,b04,b08,b11,b12) > 0 THEN {" + ".join(f"(b{b[1:]} <= 1000)::INT" for b in BANDS)} ELSE 0 END AS floored,
 (greatest(b02,b03,b04,b08,b11,b12) >= 65535)::INT AS saturated, round(nullif({_u16n("b08")}, 0) / 10000.0::DOUBLE, 6) AS back_b08 FROM ({PIXELS})"""


def rgb_stretch(spark, sf_dir):
    return pixels(spark, sf_dir).select("obs_id", "px", *[C.stretch(F.col(b) / 10000).alias(n) for n, b in (("r", "b04"), ("g", "b03"), ("b", "b02"))])


RGB = "SELECT obs_id, px, " + ", ".join(f"CAST(floor(greatest(0.0, least(1.0, {b} / 10000.0::DOUBLE / 0.3::DOUBLE)) * 255) AS INT) AS {n}" for n, b in (("r", "b04"), ("g", "b03"), ("b", "b02"))) + f" FROM ({PIXELS})"


def refine_labels(spark, sf_dir):
    return pixels(spark, sf_dir).select("obs_id", "px", "cover", C.refine_label(F.col("cover"), C.ndvi(), C.mndwi()).alias("label"))


LABEL = f"""CASE WHEN cover = 60 AND {NDVI} < 0.25 AND {MNDWI} < 0 THEN 3 WHEN cover = 50 AND {NDVI} < 0.3 AND {MNDWI} < 0 THEN 4
 WHEN cover IN (20,30,40,90) AND {NDVI} <= 0.2 AND {MNDWI} < 0 THEN 3 WHEN cover IN (20,30,40,90) AND {NDVI} >= 0.4 THEN 2
 WHEN cover IN (10,95) AND {NDVI} >= 0.35 THEN 1 WHEN cover = 80 AND {MNDWI} < -0.2 AND {NDVI} < 0.2 THEN 3
 WHEN cover = 80 AND {MNDWI} > 0 AND {NDVI} < 0.2 THEN 0 ELSE -1 END"""


def pixel_features(spark, sf_dir):
    """The classifier's twelve features: reflectances, indices, brightness of the visible bands, 3 x 3 deviation of B08.

    An observation's pixels are one row of a raster here; beyond its ends the end pixels are repeated. The deviation is
    taken in whole digital numbers.
    """
    w = W.partitionBy("obs_id").orderBy("px", *BANDS)
    near = [F.coalesce(F.lag("b08", 1).over(w), F.col("b08")), F.col("b08"), F.coalesce(F.lead("b08", 1).over(w), F.col("b08"))]
    near = [x.cast("long") for x in near]
    spread = F.sqrt((3 * sum((x * x for x in near), F.lit(0)) - sum(near, F.lit(0)) * sum(near, F.lit(0))).cast("double")) / 3 / 10000
    bright = (F.col("b02") + F.col("b03") + F.col("b04")) / 30000
    made = {"ndvi": C.ndvi(), "mndwi": C.mndwi(), "ndbi": C.ndbi(), "bsi": C.bsi(), "brightness": bright, "nir_std3": spread}
    return pixels(spark, sf_dir).select("obs_id", "px", *[F.round(F.col(b) / 10000, 6).alias(f"r_{b}") for b in BANDS], *[F.round(c, 6).alias(n) for n, c in made.items()])


FEATURES = f"""SELECT obs_id, px, {", ".join(f"round({b} / 10000.0::DOUBLE, 6) AS r_{b}" for b in BANDS)}, round({NDVI}, 6) AS ndvi, round({MNDWI}, 6) AS mndwi, round({NDBI}, 6) AS ndbi, round({BSI}, 6) AS bsi,
 round((b02 + b03 + b04) / 30000.0::DOUBLE, 6) AS brightness, round(sqrt((3 * (b * b + b08::BIGINT * b08 + a * a) - (b + b08 + a) * (b + b08 + a))::DOUBLE) / 3 / 10000, 6) AS nir_std3
 FROM (SELECT *, coalesce(lag(b08) OVER w, b08)::BIGINT AS b, coalesce(lead(b08) OVER w, b08)::BIGINT AS a FROM ({PIXELS}) WINDOW w AS (PARTITION BY obs_id ORDER BY px, b02, b03, b04, b08, b11, b12))"""


def mask_stats(spark, sf_dir):
    """Shares of each quality flag among an observation's pixels, and the usable share."""
    scl = F.col("scl")
    flags = {"nodata": scl == 0, "saturated": scl == 1, "cloud": scl.isin(8, 9), "haze": scl == 10, "shadow": scl == 3, "snow": scl == 11, "terrain": scl == 2}
    bit = {"nodata": 1, "saturated": 2, "cloud": 4, "haze": 8, "shadow": 16, "snow": 32, "terrain": 64}
    mask = F.lit(0)
    for n, c in flags.items():
        mask = mask.bitwiseOR(F.when(c, bit[n]).otherwise(0))
    rows = pixels(spark, sf_dir).select("obs_id", mask.alias("mask"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return rows.groupBy("obs_id").agg(F.count("*").alias("n"), *[share(F.col("mask").bitwiseAND(bit[n]) != 0).alias(n) for n in flags], share(F.col("mask") == 0).alias("usable"), F.bit_or("mask").alias("any_flag"))


MASK = f"""SELECT obs_id, count(*) AS n, {", ".join(f"round(avg((scl IN {codes})::INT), 6) AS {n}" for n, codes in (("nodata", "(0)"), ("saturated", "(1)"), ("cloud", "(8,9)"), ("haze", "(10)"), ("shadow", "(3)"), ("snow", "(11)"), ("terrain", "(2)")))},
 round(avg((scl NOT IN (0,1,8,9,10,3,11,2))::INT), 6) AS usable,
 bit_or(CASE WHEN scl = 0 THEN 1 WHEN scl = 1 THEN 2 WHEN scl IN (8,9) THEN 4 WHEN scl = 10 THEN 8 WHEN scl = 3 THEN 16 WHEN scl = 11 THEN 32 WHEN scl = 2 THEN 64 ELSE 0 END) AS any_flag
 FROM ({PIXELS}) GROUP BY obs_id"""


def landcover_fractions(spark, sf_dir):
    """Share of each land-cover class in each observation, in long form."""
    counts = pixels(spark, sf_dir).where("cover > 0").groupBy("obs_id", "cover").agg(F.count("*").alias("n"))
    return counts.select("obs_id", "cover", F.round(F.col("n") / F.sum("n").over(W.partitionBy("obs_id")), 4).alias("share"))


LANDCOVER = f"SELECT obs_id, cover, round(count(*) / sum(count(*)) OVER (PARTITION BY obs_id), 4) AS share FROM ({PIXELS}) WHERE cover > 0 GROUP BY obs_id, cover"


def class_fractions(spark, sf_dir):
    """Share of each label among the usable pixels; usable pixels without a label count in the denominator."""
    rows = pixels(spark, sf_dir).where(F.col("scl").isin(4, 5, 6, 7)).select("obs_id", C.refine_label(F.col("cover"), C.ndvi(), C.mndwi()).alias("label"))
    counts = rows.groupBy("obs_id", "label").agg(F.count("*").alias("n"))
    share = F.round(F.col("n") / F.sum("n").over(W.partitionBy("obs_id")), 4)
    return counts.select("obs_id", "label", share.alias("share")).where("label >= 0")


CLASSES = f"""SELECT * FROM (SELECT obs_id, label, round(count(*) / sum(count(*)) OVER (PARTITION BY obs_id), 4) AS share
 FROM (SELECT obs_id, {LABEL} AS label FROM ({PIXELS}) WHERE scl IN (4,5,6,7)) GROUP BY obs_id, label) WHERE label >= 0"""


#: Observations of a few thousand pixels each, whose number grows with the table.
SCENE = "CAST(floor(obs_id / 500) AS BIGINT)"


def _scene_pixels(spark, sf_dir):
    return pixels(spark, sf_dir).withColumn("scene", F.floor(F.col("obs_id") / 500))


def haze_mad(spark, sf_dir):
    """Per observation: median and scaled MAD of the haze transform over clear pixels, and the pixels above the haze limit.

    There is no limit with `haze_least_clear` clear pixels or fewer. One scan and one shuffle: both medians are windows
    over an observation's clear pixels.
    """
    w = W.partitionBy("scene")
    hot = F.col("b02") / 10000 - F.col("b04") / 20000 - 0.08
    clear = _scene_pixels(spark, sf_dir).where("scl IN (4, 5)").select("scene", hot.alias("hot")).withColumn("med", F.median("hot").over(w))
    clear = clear.withColumn("mad", F.median(F.abs(F.col("hot") - F.col("med"))).over(w) * 1.4826)
    limit = F.col("med") + T.haze_hot_mad_k * F.greatest(F.col("mad"), F.lit(0.001))
    out = clear.groupBy("scene").agg(F.count("*").alias("n"), F.max("med").alias("med"), F.max("mad").alias("mad"), F.sum(((F.col("hot") > limit) & (F.col("hot") > T.haze_min_hot)).cast("long")).alias("hazy"))
    able = F.col("n") > T.haze_least_clear
    return out.select("scene", "n", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"), F.when(able, F.col("hazy")).otherwise(0).alias("hazy"))


HAZE = f"""WITH c AS (SELECT {SCENE} AS scene, b02 / 10000.0::DOUBLE - b04 / 20000.0::DOUBLE - 0.08::DOUBLE AS hot FROM ({PIXELS}) WHERE scl IN (4, 5)),
 m AS (SELECT scene, median(hot) AS med, count(*) AS n FROM c GROUP BY scene),
 d AS (SELECT scene, median(abs(hot - med)) * 1.4826::DOUBLE AS mad FROM c JOIN m USING (scene) GROUP BY scene)
 SELECT scene, n, round(med, 6) AS med, round(mad, 6) AS mad, CASE WHEN n > 500 THEN
 (SELECT CAST(sum((hot > med + 4.0::DOUBLE * greatest(mad, 0.001::DOUBLE) AND hot > 0.02)::INT) AS BIGINT) FROM c WHERE c.scene = m.scene) ELSE 0 END AS hazy FROM m JOIN d USING (scene)"""


#: Observations of an even grid, read at half resolution: of each two rows and columns the second. Three and four are a thousand
#: brighter, one and four still have an offset to apply, six has no data.
DARK_DN = """SELECT obs, CASE WHEN obs IN (1, 4) THEN -1000 ELSE 0 END AS offset_dn, CASE WHEN obs = 6 OR dn = 0 THEN 0 WHEN obs IN (3, 4) THEN dn + 1000 ELSE dn END AS dn
 FROM (SELECT CAST(l_linenumber AS INT) AS obs, CAST({band} AS INT) AS dn FROM lineitem WHERE l_orderkey % 48 % 2 = 1 AND l_partkey % 48 % 2 = 1) t"""
_DARK_BANDS = ("floor(l_tax * 50000)", "l_partkey % 4001", "l_suppkey % 3001")
DARK_TOLERANCE, DARK_SHARE, DARK_LIMIT = 50, 0.005, 1000


def dark_pixel(spark, sf_dir):
    """The dark-pixel test of each observation's offset, from three bands at half resolution.

    With an offset to apply, it is consistent if no more than a small share lies below the offset's floor; without one, if
    the low percentile is dark, else it cannot be verified.
    """
    lines = read(spark, sf_dir, "lineitem")
    rows = reduce(DataFrame.unionByName, [spark.sql(DARK_DN.format(band=b).replace("FROM lineitem", "FROM {t}"), t=lines) for b in _DARK_BANDS])
    there = F.when(F.col("dn") > 0, F.col("dn"))
    below = F.when(F.col("dn") > 0, (F.col("dn") < -F.col("offset_dn") - DARK_TOLERANCE).cast("double"))
    out = rows.groupBy("obs", "offset_dn").agg(F.percentile(there, DARK_SHARE).alias("p"), F.avg(below).alias("share"), F.count(there).alias("n"))
    shifted = F.col("offset_dn") < 0
    verdict = F.when(F.col("n") == 0, "no_data").when(shifted & (F.col("share") > DARK_SHARE), "inconsistent").when(shifted | (F.col("p") < DARK_LIMIT), "consistent").otherwise("unverified")
    return out.select("obs", "offset_dn", "n", F.round("p", 6).alias("p"), F.round(F.when(shifted, F.col("share")), 6).alias("share"), verdict.alias("verdict"))


DARK = f"""SELECT obs, offset_dn, n, round(p, 6) AS p, CASE WHEN offset_dn < 0 THEN round(share, 6) END AS share,
 CASE WHEN n = 0 THEN 'no_data' WHEN offset_dn < 0 THEN CASE WHEN share > {DARK_SHARE} THEN 'inconsistent' ELSE 'consistent' END WHEN p < {DARK_LIMIT} THEN 'consistent' ELSE 'unverified' END AS verdict
 FROM (SELECT obs, offset_dn, count(*) FILTER (dn > 0) AS n, quantile_cont(dn, {DARK_SHARE}) FILTER (dn > 0) AS p, avg((dn < -offset_dn - {DARK_TOLERANCE})::INT) FILTER (dn > 0) AS share
  FROM ({" UNION ALL ".join(DARK_DN.format(band=b) for b in _DARK_BANDS)}) GROUP BY obs, offset_dn)"""


def band_medians(spark, sf_dir):
    """Median of each band of an observation, without no data; a scene without any (a DEM's fill) has none."""
    return _scene_pixels(spark, sf_dir).groupBy("scene").agg(*[F.round(F.median(F.nullif(F.col(b), F.lit(0))), 6).alias(f"med_{b}") for b in BANDS])


MEDIANS = f"SELECT {SCENE} AS scene, " + ", ".join(f"round(median(nullif({b}, 0)), 6) AS med_{b}" for b in BANDS) + f" FROM ({PIXELS}) GROUP BY 1"


def dem_fill(spark, sf_dir):
    """A band without its no-data places: they take the observation's median, and stay empty where all are."""
    w = W.partitionBy("scene")
    rows = _scene_pixels(spark, sf_dir).select("scene", "obs_id", "px", F.nullif(F.col("b02"), F.lit(0)).alias("dem"))
    return rows.select("scene", "obs_id", "px", F.round(F.coalesce(F.col("dem").cast("double"), F.median("dem").over(w)), 4).alias("dem"))


DEM = f"SELECT scene, obs_id, px, round(coalesce(dem::DOUBLE, median(dem) OVER (PARTITION BY scene)), 4) AS dem FROM (SELECT {SCENE} AS scene, obs_id, px, nullif(b02, 0) AS dem FROM ({PIXELS}))"


def pif_fit(spark, sf_dir):
    """Robust gain of an observation (y) to its reference (x) over stable pixels: the median slope over their pairs.

    At most `invariant_cap` pixels of a group take part, those with the smallest hashes, so the pair join is bounded by
    its square; a group of fewer than `invariant_least` has no fit.
    """
    key = F.sha2(F.concat_ws("-", "event_id"), 256)
    rows = observations(spark, sf_dir).select("role", F.col("value").alias("x"), (F.col("value") * 1.1 + F.col("event_id") % 13).alias("y"), "event_id", key.alias("k"))
    rows = rows.where(F.abs(F.col("y") / 1.1 - F.col("x")) < 10)  # stable
    counts = rows.groupBy("role").agg(F.count("*").alias("n")).where(F.col("n") >= T.invariant_least)
    sample = first_ranked(rows, ["role"], [F.col("k"), F.col("event_id")], T.invariant_cap).join(counts, "role")
    sample = sample.withColumn("r", F.row_number().over(W.partitionBy("role").orderBy("k", "event_id")))  # of the bounded sample
    a, b = sample.alias("a"), sample.alias("b")
    pairs = a.join(b, (F.col("a.role") == F.col("b.role")) & (F.col("a.r") < F.col("b.r")) & (F.col("a.y") != F.col("b.y")))
    slope = pairs.groupBy(F.col("a.role").alias("role")).agg(F.median((F.col("b.x") - F.col("a.x")) / (F.col("b.y") - F.col("a.y"))).alias("gain"), F.count("*").alias("pairs"))
    mids = sample.groupBy("role").agg(F.median("x").alias("mx"), F.median("y").alias("my"), F.max("n").alias("n_pif"))
    fit = slope.join(mids, "role").select("role", "gain", "pairs", "n_pif", (F.col("mx") - F.col("gain") * F.col("my")).alias("shift"))
    rmse = sample.join(fit, "role").groupBy("role").agg(F.sqrt(F.avg(F.pow(F.col("x") - F.col("gain") * F.col("y") - F.col("shift"), 2))).alias("rmse"))
    return fit.join(rmse, "role").select("role", "pairs", "n_pif", *[F.round(c, 6).alias(c) for c in ("gain", "shift", "rmse")])


PIF = f"""WITH t AS (SELECT event_type AS role, value AS x, value * 1.1::DOUBLE + event_id % 13 AS y, event_id FROM events),
 s AS (SELECT *, count(*) OVER (PARTITION BY role) AS n, row_number() OVER (PARTITION BY role ORDER BY sha256(event_id::VARCHAR), event_id) AS r FROM t WHERE abs(y / 1.1::DOUBLE - x) < 10 QUALIFY r <= {T.invariant_cap} AND n >= {T.invariant_least}),
 g AS (SELECT a.role, median((b.x - a.x) / (b.y - a.y)) AS gain, count(*) AS pairs FROM s a JOIN s b ON a.role = b.role AND a.r < b.r AND a.y <> b.y GROUP BY a.role),
 m AS (SELECT role, median(x) AS mx, median(y) AS my, max(n) AS n_pif FROM s GROUP BY role),
 f AS (SELECT role, gain, pairs, n_pif, mx - gain * my AS shift FROM g JOIN m USING (role))
 SELECT role, pairs, n_pif, round(gain, 6) AS gain, round(shift, 6) AS shift, round(sqrt(avg((x - gain * y - shift) ** 2)), 6) AS rmse FROM s JOIN f USING (role) GROUP BY role, pairs, n_pif, gain, shift"""


def normalize_apply(spark, sf_dir):
    """Bands after gain and offset where the fit is good, else as they are."""
    ok = (F.col("obs_id") % 5 != 0) & F.lit(0.03 <= T.max_norm_rmse)
    return pixels(spark, sf_dir).select("obs_id", "px", *[F.round(F.when(ok, F.col(b) / 10000 * 1.05 + 0.002).otherwise(F.col(b) / 10000), 6).alias(f"n_{b}") for b in BANDS])


NORMALIZE = "SELECT obs_id, px, " + ", ".join(f"round(CASE WHEN obs_id % 5 <> 0 THEN {b} / 10000.0::DOUBLE * 1.05::DOUBLE + 0.002::DOUBLE ELSE {b} / 10000.0::DOUBLE END, 6) AS n_{b}" for b in BANDS) + f" FROM ({PIXELS})"


def class_weights(spark, sf_dir):
    rows = pixels(spark, sf_dir).select(C.refine_label(F.col("cover"), C.ndvi(), C.mndwi()).alias("label")).where("label >= 0")
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    every = W.partitionBy()  # over the few classes only
    return counts.select("label", "n", F.round(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")), 6).alias("weight"))


WEIGHTS = f"SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM (SELECT {LABEL} AS label FROM ({PIXELS})) WHERE label >= 0 GROUP BY label"


def _judged(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return labels.join(docs, "doc_id").select("y", (F.col("n_chars") > 900).cast("int").alias("p"))


JUDGED = "SELECT quality AS y, (n_chars > 900)::INT AS p FROM labels JOIN documents USING (doc_id)"


def confusion(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("y", "p").agg(F.count("*").alias("n"))


def class_f1(spark, sf_dir):
    """Precision, recall and F1 of each class from one pass over the confusion counts."""
    both = _judged(spark, sf_dir).select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.lit(1).alias("t"), (F.col("y") == F.col("p")).cast("int").alias("hit")), F.struct(F.col("p").alias("c"), F.lit(0).alias("t"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    sums = both.groupBy("c").agg(F.sum("t").alias("true"), F.sum(1 - F.col("t")).alias("said"), F.sum("hit").alias("hits"))
    return sums.select(F.col("c").alias("label"), F.round(F.try_divide("hits", "said"), 6).alias("precision_"), F.round(F.try_divide("hits", "true"), 6).alias("recall_"), F.round(F.try_divide(2 * F.col("hits"), F.col("said") + F.col("true")), 6).alias("f1"))


F1 = f"""WITH j AS ({JUDGED}), c AS (SELECT y AS label FROM j UNION SELECT p FROM j)
 SELECT label, round((SELECT count(*) FROM j WHERE y = label AND p = label) / nullif((SELECT count(*) FROM j WHERE p = label), 0), 6) AS precision_,
 round((SELECT count(*) FROM j WHERE y = label AND p = label) / nullif((SELECT count(*) FROM j WHERE y = label), 0), 6) AS recall_,
 round(2 * (SELECT count(*) FROM j WHERE y = label AND p = label) / nullif((SELECT count(*) FROM j WHERE p = label) + (SELECT count(*) FROM j WHERE y = label), 0), 6) AS f1 FROM c"""


def stratified_sample(spark, sf_dir):
    """A repeatable bounded sample for each observation and class: the `sample_per_class` smallest hashes."""
    rows = _scene_pixels(spark, sf_dir).select("scene", "obs_id", "px", "b02", "b03", C.refine_label(F.col("cover"), C.ndvi(), C.mndwi()).alias("label")).where("label >= 0")
    key = F.sha2(F.concat_ws("-", F.lit("42"), "obs_id", "px", "b02", "b03"), 256)
    rank = F.row_number().over(W.partitionBy("scene", "label").orderBy("k", "obs_id", "px", "b02", "b03"))
    return rows.withColumn("k", key).withColumn("r", rank).where(F.col("r") <= T.sample_per_class).select("scene", "label", "obs_id", "px", "b02", "b03", "r")


SAMPLE = f"""SELECT scene, label, obs_id, px, b02, b03, row_number() OVER (PARTITION BY scene, label ORDER BY sha256('42-' || obs_id || '-' || px || '-' || b02 || '-' || b03), obs_id, px, b02, b03) AS r
 FROM (SELECT {SCENE} AS scene, obs_id, px, b02, b03, {LABEL} AS label FROM ({PIXELS})) WHERE label >= 0 QUALIFY r <= {T.sample_per_class}"""


def probability_bytes(spark, sf_dir):
    """Class probabilities as bytes (x 250, 255 for none) and the most likely class; rows with a missing feature have none."""
    p = [F.col(b) / F.greatest(F.col("b02") + F.col("b03") + F.col("b04"), F.lit(1)) for b in ("b02", "b03", "b04")]
    able = F.col("b08") > 0
    code = lambda x: F.when(able, F.rint(x * 250)).otherwise(255).cast("int")
    best = F.when(able, F.array_position(F.array(*p), F.greatest(*p)).cast("int") - 1).otherwise(-1)
    return pixels(spark, sf_dir).select("obs_id", "px", *[code(x).alias(f"p{i}") for i, x in enumerate(p)], best.alias("best"))


_P = [f"{b}::DOUBLE / greatest(b02 + b03 + b04, 1)" for b in ("b02", "b03", "b04")]
PROBABILITY = "SELECT obs_id, px, " + ", ".join(f"CASE WHEN b08 > 0 THEN CAST(round_even({x} * 250, 0) AS INT) ELSE 255 END AS p{i}" for i, x in enumerate(_P)) + f", CASE WHEN b08 > 0 THEN list_position([{', '.join(_P)}], greatest({', '.join(_P)}))::INT - 1 ELSE -1 END AS best FROM ({PIXELS})"


def tile_stats(spark, sf_dir):
    """Per tile and day: number of observations, share usable, mean index over usable ones only, share of bad ones."""
    rows = observations(spark, sf_dir).select("tile", "day", "value", (F.get_json_object("props", "$.k").cast("int") >= 20).alias("usable"), (F.col("role") == "error").alias("bad"))
    use = F.coalesce("usable", F.lit(False)) & ~F.col("bad")
    return rows.groupBy(F.col("tile").alias("tile_id"), "day").agg(
        F.count("*").alias("n_obs"), F.round(F.avg(use.cast("double")), 4).alias("usable_fraction"),
        F.round(F.avg(F.when(use, F.col("value"))), 4).alias("mean_index"), F.round(F.avg(F.col("bad").cast("double")), 4).alias("bad_fraction"),
    )


TILES = """SELECT user_id AS tile_id, CAST(ts AS DATE) AS day, count(*) AS n_obs, round(avg((u AND event_type <> 'error')::INT), 4) AS usable_fraction,
 round(avg(CASE WHEN u AND event_type <> 'error' THEN value END), 4) AS mean_index, round(avg((event_type = 'error')::INT), 4) AS bad_fraction
 FROM (SELECT *, coalesce(CAST(json_extract_string(props, '$.k') AS INT) >= 20, false) AS u FROM events) GROUP BY ALL"""

QUERIES = {
    "tile_stats": tile_stats, "spectral_indices": spectral_indices, "standardise_dn": standardise_dn, "rgb_stretch": rgb_stretch, "refine_labels": refine_labels,
    "pixel_features": pixel_features, "mask_stats": mask_stats, "landcover_fractions": landcover_fractions, "class_fractions": class_fractions, "haze_mad": haze_mad,
    "dark_pixel": dark_pixel, "band_medians": band_medians, "dem_fill": dem_fill, "theil_sen": pif_fit, "normalize_apply": normalize_apply, "class_weights": class_weights,
    "confusion_matrix": confusion, "class_f1": class_f1, "stratified_sample": stratified_sample, "probability_bytes": probability_bytes,
}
ORACLE = {
    "tile_stats": TILES, "spectral_indices": SPECTRAL, "standardise_dn": STANDARDISE, "rgb_stretch": RGB,
    "refine_labels": f"SELECT obs_id, px, cover, {LABEL} AS label FROM ({PIXELS})", "pixel_features": FEATURES, "mask_stats": MASK, "landcover_fractions": LANDCOVER,
    "class_fractions": CLASSES, "haze_mad": HAZE, "dark_pixel": DARK, "band_medians": MEDIANS, "dem_fill": DEM, "theil_sen": PIF, "normalize_apply": NORMALIZE, "class_weights": WEIGHTS,
    "confusion_matrix": f"SELECT y, p, count(*) AS n FROM ({JUDGED}) GROUP BY y, p", "class_f1": F1, "stratified_sample": SAMPLE, "probability_bytes": PROBABILITY,
}
