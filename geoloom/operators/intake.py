"""Gate 0 of the intake: all reasons against a scene, its code, and what becomes of it, as column expressions.

Raster facts come as an array of files (band, height, width, resolution, crs, dtype); a file that cannot be read has no
height. A scene without a code may be registered; any other is quarantined with its reasons and one audit record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bands of a clip with their pixel sizes in metres, the mission's begin, the least size, time zones.
BAND_SIZES = {"B02": 10.0, "B03": 10.0, "B04": 10.0, "B08": 10.0, "B11": 20.0, "B12": 20.0}
MISSION_BEGIN = "2015-06-23T00:00:00Z"
LEAST_SIDE = 16
ZONED = r"(Z|[+-]\d{2}:?\d{2})$"
FILE = "array<struct<band:string,height:int,width:int,resolution:double,crs:string,dtype:string>>"
# The levels that the archive holds of each sensor.
LEVELS = {"sentinel-2": ["L2A"]}


def listed(*rules: Column) -> Column:
    """The reasons that hold, in the order of the rules."""
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def zoned_time(text: Column) -> Column:
    """A time with a zone; null for any other text."""
    return F.when(text.rlike(ZONED), F.try_to_timestamp(text))


def file_of(files: Column, band: str) -> Column:
    return F.get(F.filter(files, lambda f: f["band"] == band), F.lit(0))


def stac_reasons(at: Column, now: Column, platform: Column, instruments: Column, item_id: Column, collection: Column, crs: Column, files: Column) -> Column:
    """The thirteen rules of a clip of STAC bands; null facts break the rule that asks for them."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    rules = [
        F.when((at < F.to_timestamp(F.lit(MISSION_BEGIN))) | (at > now + F.expr("INTERVAL 1 DAY")), "outside_mission"),
        F.when(no(F.lower(platform).startswith("sentinel-2")), "platform"),
        F.when(no(F.exists(instruments, lambda x: F.lower(x) == "msi")), "instrument"),
        F.when(no(item_id.contains("L2A")) & no(collection.endswith("l2a")), "level"),
        F.when(crs.isNull(), "projection_missing"),
    ]
    for band in BAND_SIZES:
        f = file_of(files, band)
        rules += [F.when(f.isNull(), f"missing_{band}"), F.when(f.isNotNull() & f["height"].isNull(), f"unreadable_{band}")]
    rules.append(F.when(file_of(files, "SCL").isNull(), "missing_SCL"))
    for band, size in BAND_SIZES.items():
        f = file_of(files, band)
        rules += [
            F.when((f["height"] < LEAST_SIDE) | (f["width"] < LEAST_SIDE), f"small_{band}"),
            F.when(F.abs(f["resolution"] - size) > 0.01, f"resolution_{band}"),
            F.when(f["crs"] != crs, f"crs_{band}"),
            F.when(f["height"].isNotNull() & no(f["dtype"] == "uint16"), f"dtype_{band}"),
        ]
    fine, coarse = file_of(files, "B04"), file_of(files, "B11")
    rules.append(F.when((F.abs(fine["height"] - 2 * coarse["height"]) > 1) | (F.abs(fine["width"] - 2 * coarse["width"]) > 1), "extent"))
    return listed(*rules)


def stac_code(readable: Column, at: Column, reasons: Column) -> Column:
    """The first failure of a clip: unreadable item, bad time, then all other rules together; null if there is none."""
    return F.when(~readable, "metadata_unreadable").when(at.isNull(), "timestamp_invalid").when(F.size(reasons) > 0, "validation_failed")


def raster_reasons(at: Column, now: Column, offset: Column, applied: Column, crs: Column, bands: Column, listed_bands: Column, width: Column, height: Column, resolution: Column, gsd: Column) -> Column:
    """The rules of a single raster with a sidecar, once its required fields are there and its time is good. crs: EPSG code as text."""
    geographic = crs.rlike("^EPSG:4[0-9]{3}$")
    return listed(
        F.when(at > now + F.expr("INTERVAL 1 DAY"), "in_future"),
        F.when((offset != 0) & applied.isNull(), "offset_not_stated"),
        F.when(crs.isNull(), "crs_missing"),
        F.when(geographic, "crs_geographic"),
        F.when(bands < listed_bands, "bands"),
        F.when((width < LEAST_SIDE) | (height < LEAST_SIDE), "small"),
        F.when(F.abs(resolution - gsd) > 0.05 * gsd, "resolution"),
    )


def policy(code: Column, sensor: Column, level: Column, decision: Column, inside: Column, levels: dict[str, list[str]] | None = None) -> Column:
    """Code after the archive's policy: what validation found, unknown sensor, level, radiometry, place; null: register."""
    known = levels or LEVELS
    accepts = F.coalesce(*[F.when(sensor == s, level.isin(v)) for s, v in known.items()], F.lit(False))
    code = F.when(code.isNotNull(), code).when(~F.coalesce(sensor.isin(list(known)), F.lit(False)), "sensor_unknown").when(~F.coalesce(accepts, F.lit(False)), "processing_level_mismatch")
    return F.when(code.isNotNull(), code).when(decision == "radiometry_ambiguous", decision).when(~F.coalesce(inside, F.lit(False)), "outside_aoi")


def quarantined(judged: DataFrame, name: str = "name", code: str = "code", reasons: str = "reasons") -> DataFrame:
    """original_name, reason_code, reasons and the audit record's action and payload of what has a code."""
    body = F.to_json(F.struct(F.col(code).alias("code"), F.col(name).cast("string").alias("name"), F.col(reasons).alias("reasons")))
    rows = judged.where(F.col(code).isNotNull())
    return rows.select(F.col(name).alias("original_name"), F.col(code).alias("reason_code"), F.col(reasons).alias("reasons"), F.lit("ingest.quarantined").alias("action"), body.alias("payload"))


def release(quarantine: DataFrame, orders: DataFrame, role: str, actor: str) -> DataFrame:
    """An administrator's release of quarantined inputs (id, original_name, reason_code, released) named by orders (id, reason, overrides).

    Gives the rows to register anew with the override that is to be joined to them, and the audit record. An input that
    is not in quarantine, or has left it, is not released again; another role may not release.
    """
    if role != "admin":
        raise PermissionError("only an administrator can release quarantined inputs")
    rows = quarantine.where("NOT released").join(orders, "id")
    body = F.to_json(F.struct(F.col("reason_code").alias("original_code"), "overrides", "reason"))
    return rows.select("id", "original_name", "overrides", F.lit(actor).alias("decided_by"), "reason", F.lit("ingest.quarantine_released").alias("action"), body.alias("payload"))
