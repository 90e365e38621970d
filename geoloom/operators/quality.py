"""The quality mask: eight flags of each pixel, in the order in which they depend on one another.

Input: obs, r, c, six bands as reflectances (null: no data), the scene class, and `dem`, a height in metres, if there
is one. Neighbourhoods are equi-joins, and a square is grown along rows, then along columns; the haze limit is one median
and one deviation for each observation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.config import CLOUD, HAZE, NODATA, SATURATED, SHADOW, SNOW, TERRAIN, T
from geoloom.functions import columns as C
from geoloom.operators import raster as R


def shadow_moves(azimuth: float | None, elevation: float | None, gsd: float, heights: Sequence[float] = T.shadow_heights_m) -> list[tuple[int, int]]:
    """Whole offsets (rows, columns) from a cloud to its shadow at the possible heights, away from the sun; none without sun data or a sun above the horizon."""
    if azimuth is None or elevation is None or elevation <= 0:
        return []
    zenith, az = math.radians(90 - elevation), math.radians(azimuth)
    far = [h * math.tan(zenith) / gsd for h in heights]
    return sorted({(round(math.cos(az) * d), round(-math.sin(az) * d)) for d in far})


def _grown(cells: DataFrame, radius: int) -> DataFrame:
    """Cells (obs, r, c) within a square of the radius: grown along rows, then along columns."""
    line = range(-radius, radius + 1)
    return R.spread(R.spread(cells, [(d, 0, 1.0) for d in line], ["obs"]), [(0, d, 1.0) for d in line], ["obs"])


def illumination(df: DataFrame, azimuth: float, elevation: float, gsd: float) -> DataFrame:
    """obs, r, c, slope (radians) and cos_i of heights v, from differences to the four neighbours, one-sided at edges."""
    grid = R.around(df, R.CROSS).groupBy("obs", "r", "c")
    side = lambda dr, dc: F.max(F.when((F.col("dr") == dr) & (F.col("dc") == dc), F.col("nv")))
    rows = grid.agg(side(0, 0).alias("v"), side(1, 0).alias("s"), side(-1, 0).alias("n"), side(0, 1).alias("e"), side(0, -1).alias("w"))
    diff = lambda a, b: F.coalesce((F.col(a) - F.col(b)) / 2, F.col(a) - F.col("v"), F.col("v") - F.col(b), F.lit(0.0)) / gsd
    gy, gx = diff("s", "n"), diff("e", "w")
    slope, aspect = F.atan(F.sqrt(gx * gx + gy * gy)), F.atan2(-gx, gy)
    zenith, az = F.lit(math.radians(90 - elevation)), F.lit(math.radians(azimuth))
    cos_i = F.cos(slope) * F.cos(zenith) + F.sin(slope) * F.sin(zenith) * F.cos(az - aspect)
    return rows.select("obs", "r", "c", slope.alias("slope"), cos_i.alias("cos_i"))


def _flag(df: DataFrame, cells: DataFrame, name: str) -> DataFrame:
    return df.join(cells.withColumn(name, F.lit(True)), ["obs", "r", "c"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def quality_mask(df: DataFrame, azimuth: float | None, elevation: float | None, gsd: float, least_clear: int = T.haze_least_clear) -> DataFrame:
    """obs, r, c and mask, under the sun of the scenes; without sun data there is neither a projected shadow nor a terrain bit."""
    rows = df.withColumn("nodata", F.col("b02").isNull() | (F.col("scl") == 0))
    rows = rows.withColumn("valid", F.col("b02").isNotNull()).withColumn("saturated", F.col("scl") == 1)
    rows = _flag(rows, _grown(rows.where("scl IN (8, 9)").select("obs", "r", "c"), T.cloud_dilate_px), "near_cloud").withColumn("cloud", F.col("near_cloud") & F.col("valid"))
    rows = rows.withColumn("hot", C.hot()).withColumn("mndwi", C.mndwi()).withColumn("ndsi", C.mndwi())
    all_of = W.partitionBy("obs")
    clear = rows.where("valid AND NOT cloud AND scl IN (4, 5)").select("obs", "hot").withColumn("med", F.median("hot").over(all_of))
    limits = clear.withColumn("mad", F.median(F.abs(F.col("hot") - F.col("med"))).over(all_of) * 1.4826).groupBy("obs").agg(F.max("med").alias("med"), F.max("mad").alias("mad"), F.count("*").alias("clear"))
    rows = rows.join(limits, "obs", "left")
    hazy = (F.col("clear") > least_clear) & ~(F.col("mndwi") > 0.1) & (F.col("hot") > F.col("med") + T.haze_hot_mad_k * F.greatest(F.col("mad"), F.lit(0.001))) & (F.col("hot") > T.haze_min_hot)
    rows = rows.withColumn("haze", ((F.col("scl") == 10) | F.coalesce(hazy & F.col("valid"), F.lit(False))) & ~F.col("cloud"))
    moves = shadow_moves(azimuth, elevation, gsd)
    if moves:
        rows = _flag(rows, R.spread(rows.where("cloud").select("obs", "r", "c"), [(a, b, 1.0) for a, b in moves], ["obs"]), "cast")
    else:
        rows = rows.withColumn("cast", F.lit(False))
    dark = rows.where((F.col("scl") == 3) | (F.col("cast") & (F.coalesce("b08", F.lit(1.0)) < T.shadow_dark_nir) & (F.col("mndwi") < 0.2))).select("obs", "r", "c")
    rows = _flag(rows, _grown(dark, T.shadow_dilate_px), "near_shadow").withColumn("shadow", F.col("near_shadow") & F.col("valid") & ~F.col("cloud"))
    snow = ((F.col("scl") == 11) | ((F.col("ndsi") > T.snow_ndsi) & (F.col("b03") > T.snow_min_green))) & F.col("valid")
    terrain = F.lit(False)
    if "dem" in df.columns and azimuth is not None and elevation is not None:
        rows = rows.join(illumination(df.select("obs", "r", "c", F.col("dem").alias("v")), azimuth, elevation, gsd), ["obs", "r", "c"], "left")
        steep = (F.col("scl") == 2) & (F.col("slope") > math.radians(T.terrain_min_slope))
        terrain = F.coalesce((F.col("cos_i") < T.terrain_min_cos_i) | steep, F.lit(False)) & F.col("valid")
    rows = rows.withColumns({"snow": snow, "terrain": terrain})
    bits = [("nodata", NODATA), ("saturated", SATURATED), ("cloud", CLOUD), ("haze", HAZE), ("shadow", SHADOW), ("snow", SNOW), ("terrain", TERRAIN)]
    mask = sum((F.when(F.col(n), b).otherwise(0) for n, b in bits), F.lit(0))
    return rows.select("obs", "r", "c", mask.alias("mask"))
