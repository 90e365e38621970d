"""Queries over the intake: rules, policy, quarantine and release, on items built from the scenes of the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import columns as C
from geoloom.operators import intake as I
from geoloom.sources.adapters import STAC
from geoloom.sources.fixtures import read

NOW = "2026-01-01T00:00:00Z"
_BANDS = list(I.BAND_SIZES)


def _apart(df):
    """df as it is; a step that the optimizer does not merge with the next, so that long expressions are written out once."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("x")).select("x.*")


def _items(spark, sf_dir):
    """STAC items as JSON text, with the facts of their files; faults by the scene's number."""
    n = F.col("id")
    s = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    at = F.when(n % 29 == 0, "2010-01-01T00:00:00Z").when(n % 31 == 0, "2021-12-21T05:13:08").when(n % 37 == 0, "soon").otherwise("2021-12-21T05:13:08.025Z")
    properties = F.struct(
        at.alias("datetime"), F.when(n % 7 == 0, "landsat-8").otherwise("Sentinel-2B").alias("platform"), F.array(F.when(n % 11 == 0, "tirs").otherwise("MSI")).alias("instruments"),
        F.when(n % 13 != 0, 32644).alias("proj:epsg"), F.when(n % 3 == 0, "05.00").when(n % 3 == 1, "03.01").otherwise("n/a").alias("s2:processing_baseline"), (n % 4 == 0).alias("earthsearch:boa_offset_applied"),
    )
    item = F.struct(F.when(n % 5 == 0, "S2B_X_L1C").otherwise("S2B_X_L2A").alias("id"), F.when(n % 5 == 0, "sentinel-2-l1c").otherwise("sentinel-2-l2a").alias("collection"), properties.alias("properties"))
    text = F.when(n % 59 == 0, "{broken").otherwise(F.to_json(item))
    files = [_file(b, n) for b in _BANDS]
    files = F.filter(F.array(*files, F.when(n % 53 != 0, _struct("SCL", F.lit(500), F.lit(20.0), F.lit("EPSG:32644"), F.lit("uint8")))), lambda f: f.isNotNull())
    return _apart(s.select("id", text.alias("item"), files.alias("files")))


def _struct(band, side, size, crs, dtype):
    return F.struct(F.lit(band).alias("band"), side.cast("int").alias("height"), side.cast("int").alias("width"), size.cast("double").alias("resolution"), crs.alias("crs"), dtype.alias("dtype"))


def _file(band, n):
    fine = I.BAND_SIZES[band] == 10
    side, size, crs, dtype = F.lit(1000 if fine else 500), F.lit(I.BAND_SIZES[band]), F.lit("EPSG:32644"), F.lit("uint16")
    if band == "B04":
        side, size = F.when(n % 17 == 0, 8).otherwise(side), F.when(n % 23 == 0, 11.0).otherwise(size)
    if band == "B11":
        side, crs = F.when(n % 19 == 0, 300).otherwise(side), F.when(n % 41 == 0, "EPSG:32643").otherwise(crs)
    if band == "B02":
        dtype = F.when(n % 67 == 0, "int16").otherwise(dtype)
    if band == "B12":
        side = F.when(n % 47 != 0, side)
    made = _struct(band, side, size, crs, dtype)
    return F.when(n % 43 != 0, made) if band == "B08" else made


def _judged(spark, sf_dir):
    s = _apart(_items(spark, sf_dir).withColumn("j", F.from_json("item", STAC)))
    p = F.col("j.properties")
    at = I.zoned_time(p["datetime"])
    crs = F.concat(F.lit("EPSG:"), p["proj:epsg"].cast("string"))
    reasons = I.stac_reasons(at, F.to_timestamp(F.lit(NOW)), p["platform"], p["instruments"], F.col("j.id"), F.col("j.collection"), crs, F.col("files"))
    s = _apart(s.select("id", "j", reasons.alias("broken")))
    s = _apart(s.withColumn("found", I.stac_code(p.isNotNull(), at, F.col("broken"))))
    reasons, code = F.col("broken"), F.col("found")
    major, _ = C.baseline(p["s2:processing_baseline"])
    decision = C.offset_decision(major, p["earthsearch:boa_offset_applied"], F.lit(None).cast("int"))
    level = F.when(F.col("j.id").contains("L2A"), "L2A")
    final = I.policy(code, F.lit("sentinel-2"), level, decision, F.col("id") % 61 != 0)
    kept = F.when(code == "validation_failed", reasons).when(final.isNotNull(), F.array(final)).otherwise(F.array().cast("array<string>"))
    return _apart(s.select("id", final.alias("code"), kept.alias("reasons")))


def stac_rules(spark, sf_dir):
    """Code and all reasons of every scene."""
    return _judged(spark, sf_dir).select("id", F.coalesce("code", F.lit("registered")).alias("code"), F.array_join("reasons", ";").alias("reasons"))


def quarantine_log(spark, sf_dir):
    """What goes to quarantine, with its reasons and its audit record."""
    q = I.quarantined(_judged(spark, sf_dir), "id")
    return q.select("original_name", "reason_code", F.size("reasons").alias("n_reasons"), "action", "payload")


def release_override(spark, sf_dir):
    """An administrator releases the inputs whose radiometry was in doubt, with the offset to apply."""
    q = _judged(spark, sf_dir).where("code IS NOT NULL").select("id", F.col("id").alias("original_name"), F.col("code").alias("reason_code"), (F.col("id") % 2 == 0).alias("released"))
    orders = q.where("reason_code = 'radiometry_ambiguous'").select("id", F.lit("checked by hand").alias("reason"), F.lit('{"offset":-1000}').alias("overrides"))
    return I.release(q, orders, "admin", "keeper").select("id", "overrides", "decided_by", "action", "payload")


def sidecar_rules(spark, sf_dir):
    """Code and reasons of rasters with sidecars."""
    n = F.col("id")
    s = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    s = s.select(
        "id", F.when(n % 6 == 0, "2021-12-21").when(n % 8 == 0, "2030-01-01T00:00:00Z").otherwise("2021-12-21T00:00:00+05:30").alias("acquired_at"), F.when(n % 5 == 0, -1000).otherwise(0).alias("offset"),
        F.when(n % 10 == 0, True).alias("applied"), F.when(n % 7 == 0, "EPSG:4326").when(n % 9 != 0, "EPSG:32644").alias("crs"), (F.lit(4) - (n % 11 == 0).cast("int")).alias("bands"),
        F.when(n % 13 == 0, 10).otherwise(100).alias("side"), F.when(n % 17 == 0, 10.6).otherwise(10.4).alias("resolution"), (n % 19 == 0).alias("no_sidecar"),
    )
    at = I.zoned_time(F.col("acquired_at"))
    reasons = I.raster_reasons(at, F.to_timestamp(F.lit(NOW)), F.col("offset"), F.col("applied"), F.col("crs"), F.col("bands"), F.lit(4), F.col("side"), F.col("side"), F.col("resolution"), F.lit(10.0))
    code = F.when(F.col("no_sidecar"), "metadata_missing").when(at.isNull(), "timestamp_invalid").when(F.size(reasons) > 0, "validation_failed").otherwise("registered")
    return s.select("id", code.alias("code"), F.when(code == "validation_failed", F.array_join(reasons, ";")).otherwise("").alias("reasons"))


def _case(cond, name):
    return f"CASE WHEN {cond} THEN '{name}' END"


_RULES = [("id % 29 = 0", "outside_mission"), ("id % 7 = 0", "platform"), ("id % 11 = 0", "instrument"), ("id % 5 = 0", "level"), ("id % 13 = 0", "projection_missing"), ("id % 43 = 0", "missing_B08"), ("id % 47 = 0", "unreadable_B12"), ("id % 53 = 0", "missing_SCL"), ("id % 67 = 0", "dtype_B02"), ("id % 17 = 0", "small_B04"), ("id % 23 = 0", "resolution_B04"), ("id % 41 = 0 AND id % 13 <> 0", "crs_B11"), ("(id % 17 = 0) <> (id % 19 = 0) OR id % 17 = 0", "extent")]
JUDGED = f"""SELECT id, CASE WHEN id % 59 = 0 THEN 'metadata_unreadable' WHEN id % 29 <> 0 AND (id % 31 = 0 OR id % 37 = 0) THEN 'timestamp_invalid' WHEN len(rs) > 0 THEN 'validation_failed'
 WHEN id % 3 = 2 THEN 'radiometry_ambiguous' WHEN id % 61 = 0 THEN 'outside_aoi' END AS code, rs
 FROM (SELECT o_orderkey AS id, list_filter([{", ".join(_case(c.replace("id", "o_orderkey"), r) for c, r in _RULES)}], lambda x: x IS NOT NULL) AS rs FROM orders)"""
_KEPT = f"SELECT id, code, CASE WHEN code = 'validation_failed' THEN rs WHEN code IS NOT NULL THEN [code] ELSE [] END AS rs FROM ({JUDGED})"
RULES = f"SELECT id, coalesce(code, 'registered') AS code, array_to_string(rs, ';') AS reasons FROM ({_KEPT})"
LOG = f"""SELECT id AS original_name, code AS reason_code, len(rs)::INT AS n_reasons, 'ingest.quarantined' AS action,
 '{{"code":"' || code || '","name":"' || id || '","reasons":["' || array_to_string(rs, '","') || '"]}}' AS payload FROM ({_KEPT}) WHERE code IS NOT NULL"""
RELEASE = f"""SELECT id, '{{"offset":-1000}}' AS overrides, 'keeper' AS decided_by, 'ingest.quarantine_released' AS action,
 '{{"original_code":"radiometry_ambiguous","overrides":"{{\\"offset\\":-1000}}","reason":"checked by hand"}}' AS payload FROM ({_KEPT}) WHERE code = 'radiometry_ambiguous' AND id % 2 <> 0"""
_SIDE = [("id % 8 = 0 AND id % 6 <> 0", "in_future"), ("id % 5 = 0 AND id % 10 <> 0", "offset_not_stated"), ("id % 9 = 0 AND id % 7 <> 0", "crs_missing"), ("id % 7 = 0", "crs_geographic"), ("id % 11 = 0", "bands"), ("id % 13 = 0", "small"), ("id % 17 = 0", "resolution")]
SIDE = f"""SELECT id, code, CASE WHEN code = 'validation_failed' THEN array_to_string(rs, ';') ELSE '' END AS reasons FROM (SELECT id, rs, CASE WHEN id % 19 = 0 THEN 'metadata_missing' WHEN id % 6 = 0 THEN 'timestamp_invalid' WHEN len(rs) > 0 THEN 'validation_failed' ELSE 'registered' END AS code
 FROM (SELECT o_orderkey AS id, list_filter([{", ".join(_case(c.replace("id", "o_orderkey"), r) for c, r in _SIDE)}], lambda x: x IS NOT NULL) AS rs FROM orders))"""

QUERIES = {"stac_rules": stac_rules, "quarantine_log": quarantine_log, "release_override": release_override, "sidecar_rules": sidecar_rules}
ORACLE = {"stac_rules": RULES, "quarantine_log": LOG, "release_override": RELEASE, "sidecar_rules": SIDE}
