"""Intake of scenes: STAC items, raster sidecars and product metadata, read with explicit schemas, judged row by row.

A broken input never stops a scan: what cannot be read becomes a row with reasons. Rules that ask for the rasters take
their headers (`storage.raster_headers`); `judged_stac` and `judged_rasters` apply all rules, with a code for each scene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import columns as C
from geoloom.operators import intake as I

# The fields of STAC items and sidecars that are read, and those that a sidecar must have.
STAC = """id string, collection string, geometry struct<type:string,coordinates:array<array<array<double>>>>, properties struct<
 `datetime`:string,platform:string,instruments:array<string>,`proj:epsg`:int,`proj:code`:string,`s2:processing_baseline`:string,
 `earthsearch:boa_offset_applied`:boolean,`eo:cloud_cover`:double,`view:sun_azimuth`:double,`view:sun_elevation`:double,
 `mgrs:utm_zone`:int,`mgrs:latitude_band`:string,`mgrs:grid_square`:string>"""
SIDECAR = """acquired_at string, sensor string, platform string, instrument string, processing_level string, gsd_m double, bands array<string>, scale double,
 `offset` int, nodata int, offset_already_applied boolean, processing_baseline string, quality_band string, tile_code string, cloud_cover double"""
REQUIRED = ["acquired_at", "sensor", "platform", "processing_level", "gsd_m", "bands", "scale", "offset", "nodata"]
ZONED = I.ZONED
SUFFIX = ".sidecar.json"


def candidates(spark: SparkSession, folder: str, suffix: str = SUFFIX) -> DataFrame:
    """Inputs in a folder: files that are neither hidden, nor sidecars, nor unfinished, in order of name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    inner = F.rlike("name", F.lit(r"^\.|\.part(\.tif)?$")) | F.endswith("name", F.lit(suffix))
    return files.withColumn("name", name).where(~inner).orderBy("path")


#: Adapters by name: the pattern of the paths that each takes; the first that fits is used.
ADAPTERS = {"stac_clip": r"(?i)/item\.json$", "geotiff": r"(?i)\.tiff?$"}


def by_name(name: str) -> str:
    """The pattern of an adapter; an unknown name is an error."""
    if name not in ADAPTERS:
        raise KeyError(f"no adapter {name}; there are {', '.join(ADAPTERS)}")
    return ADAPTERS[name]


def adapter(path: Column) -> Column:
    """The first adapter that takes a path, else null."""
    return F.coalesce(*[F.when(path.rlike(p), n) for n, p in ADAPTERS.items()])


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    raw = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    return raw.select("*", F.col("_metadata.file_path").alias("path"))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def judged_stac(spark: SparkSession, path: str, headers: DataFrame, now: Column | None = None) -> DataFrame:
    """path, source_id, code and reasons of STAC clips: all rules of the item and of its folder's rasters. headers: of `raster_headers`."""
    files = headers.groupBy("folder").agg(F.collect_list(F.struct("band", "height", "width", "resolution", "crs", "dtype")).alias("files"))  # a clip's few files
    raw = _read(spark, path, STAC).withColumn("folder", _folder(F.col("path"))).join(files, "folder", "left")
    p = F.col("properties")
    at = I.zoned_time(p["datetime"])
    code = F.coalesce(p["proj:epsg"].cast("string"), F.regexp_extract(p["proj:code"], r"(\d+)$", 1))
    crs = F.when(F.length(code) > 0, F.concat(F.lit("EPSG:"), code))
    files = F.coalesce("files", F.array().cast(I.FILE))
    reasons = I.stac_reasons(at, now if now is not None else F.current_timestamp(), p["platform"], p["instruments"], F.col("id"), F.col("collection"), crs, files)
    rows = raw.select("path", F.col("id").alias("source_id"), F.col("_corrupt_record").isNull().alias("readable"), at.alias("at"), reasons.alias("reasons"))
    return rows.select("path", "source_id", I.stac_code(F.col("readable"), F.col("at"), F.col("reasons")).alias("code"), "reasons")


def judged_rasters(spark: SparkSession, path: str, headers: DataFrame, suffix: str = SUFFIX, now: Column | None = None) -> DataFrame:
    """path (of the raster), code and reasons of single rasters with sidecars beside them."""
    raw = _read(spark, path, SIDECAR).withColumn("stem", F.regexp_replace("path", f"{suffix}$".replace(".", "[.]"), ""))
    rasters = headers.select(F.regexp_replace("path", r"(?i)\.tiff?$", "").alias("stem"), F.col("path").alias("raster"), F.struct("width", "height", "bands", "resolution", "crs").alias("h"))
    both = rasters.join(raw, "stem", "left")
    at = I.zoned_time(F.col("acquired_at"))
    missing = I.listed(*[F.when(F.col(f).isNull(), f"missing_{f}") for f in REQUIRED])
    rules = I.raster_reasons(at, now if now is not None else F.current_timestamp(), F.col("offset"), F.col("offset_already_applied"), F.col("h.crs"), F.col("h.bands"), F.size("bands"), F.col("h.width"), F.col("h.height"), F.col("h.resolution"), F.col("gsd_m"))
    code = F.when(F.col("path").isNull(), "metadata_missing").when(F.col("_corrupt_record").isNotNull(), "metadata_unreadable").when(F.size("missing") > 0, "metadata_missing").when(F.col("at").isNull(), "timestamp_invalid")
    code = code.when(F.col("h.height").isNull(), "raster_unreadable").when(F.size("rules") > 0, "validation_failed")
    rows = both.select("raster", "path", "_corrupt_record", at.alias("at"), "h", missing.alias("missing"), rules.alias("rules"))
    return rows.select(F.col("raster").alias("path"), code.alias("code"), F.when(code == "metadata_missing", F.col("missing")).when(code == "validation_failed", F.col("rules")).otherwise(F.array().cast("array<string>")).alias("reasons"))


def _reasons(*rules: Column) -> Column:
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def stac_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Scene metadata of STAC items with all reasons against each."""
    raw = _read(spark, path, STAC)
    p = "properties."
    at = F.try_to_timestamp(F.col(f"{p}datetime"))
    major, minor = C.baseline(F.col(f"{p}`s2:processing_baseline`"))
    tile = F.concat(F.col(f"{p}`mgrs:utm_zone`").cast("string"), F.col(f"{p}`mgrs:latitude_band`"), F.col(f"{p}`mgrs:grid_square`"))
    code = F.coalesce(F.col(f"{p}`proj:epsg`").cast("string"), F.regexp_extract(f"{p}`proj:code`", r"(\d+)$", 1))
    reasons = _reasons(
        F.when(F.col("_corrupt_record").isNotNull(), "unreadable_json"),
        F.when(at.isNull(), "acquired_at_missing"),
        F.when(at.isNotNull() & ~F.col(f"{p}datetime").rlike(ZONED), "acquired_at_without_zone"),
        F.when(at > F.current_timestamp() + F.expr("INTERVAL 1 DAY"), "acquired_in_future"),
        F.when(~F.coalesce(F.col("collection").contains("l2a"), F.lit(False)), "collection_not_l2a"),
        F.when(code != "32644", "crs_not_expected"),
        F.when(~F.coalesce(F.col(f"{p}`eo:cloud_cover`").between(0, 100), F.lit(True)), "cloud_cover_out_of_range"),
    )
    decision = C.offset_decision(major, F.col(f"{p}`earthsearch:boa_offset_applied`"), F.lit(None).cast("int"))
    return raw.select(F.col("id").alias("source_id"), at.alias("acquired_at"), F.col(f"{p}platform").alias("platform"), tile.alias("tile_code"), major.alias("major"), minor.alias("minor"), F.col(f"{p}`eo:cloud_cover`").alias("cloud_cover"), decision.alias("offset_decision"), reasons.alias("reasons"))


def sidecar_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Scene metadata of raster sidecars; a missing required field is a reason."""
    raw = _read(spark, path, SIDECAR)
    at = F.try_to_timestamp("acquired_at")
    reasons = _reasons(
        *[F.when(F.col(f).isNull(), f"missing_{f}") for f in REQUIRED],
        F.when(F.col("acquired_at").isNotNull() & ~F.col("acquired_at").rlike(ZONED), "acquired_at_without_zone"),
        F.when((F.col("offset") != 0) & F.col("offset_already_applied").isNull(), "radiometry_ambiguous"),
        F.when(F.col("scale") <= 0, "scale_not_positive"),
    )
    applied = F.coalesce("offset_already_applied", F.col("offset") == 0)
    return raw.select(at.alias("acquired_at"), "sensor", "platform", "processing_level", "gsd_m", applied.alias("offset_applied"), reasons.alias("reasons"))


def product_offsets(xml: Column) -> Column:
    """Map of band number to offset from a product's metadata text."""
    ids = F.regexp_extract_all(xml, F.lit(r'<BOA_ADD_OFFSET band_id="(\d+)">(-?\d+)<'), F.lit(1))
    values = F.regexp_extract_all(xml, F.lit(r'<BOA_ADD_OFFSET band_id="(\d+)">(-?\d+)<'), F.lit(2))
    return F.map_from_arrays(F.transform(ids, lambda x: x.cast("int")), F.transform(values, lambda x: x.cast("int")))


def split_valid(scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What may be registered, and what is quarantined with its reasons."""
    return scenes.where(F.size("reasons") == 0), scenes.where(F.size("reasons") > 0)
