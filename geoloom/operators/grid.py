"""The analysis grid: WGS84 to UTM 44N as column expressions, inward snapping, tiles from global places, block splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.config import BLOCK_M, STRIDE_M, TEST_SHARE, TILE_M
from geoloom.functions.columns import tile_id, unit_hash

# The areas' boxes in degrees (west, south, east, north).
AREAS = [
    ("korba", 82.53, 22.30, 82.70, 22.365),
    ("gangrel", 81.47, 20.56, 81.60, 20.65),
    ("prayagraj", 81.85, 25.40, 81.93, 25.48),
    ("naya_raipur", 81.75, 21.12, 81.82, 21.21),
    ("raipur_kharun", 81.52, 21.18, 81.60, 21.28),
]

# WGS84 and the Krueger series to the fourth order in the third flattening.
A_M, FLAT = 6378137.0, 1 / 298.257223563
N = FLAT / (2 - FLAT)
RADIUS = A_M / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = [
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
]
BETA = [
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
]
DELTA = [
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35,
    4279 * N**4 / 630,
]
ECC = 2 * math.sqrt(N) / (1 + N)
CENTRE, SCALE, EASTING = 81.0, 0.9996, 500000.0


def utm44(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres of degrees."""
    phi, lam = F.radians(lat), F.radians(lon - CENTRE)
    t = F.sinh(F.atanh(F.sin(phi)) - ECC * F.atanh(ECC * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EASTING + SCALE * RADIUS * east, SCALE * RADIUS * north


def lonlat44(east: Column, north: Column) -> tuple[Column, Column]:
    """Degrees (longitude, latitude) of easting and northing in metres."""
    xi, eta = north / (SCALE * RADIUS), (east - EASTING) / (SCALE * RADIUS)
    x, e = xi, eta
    for j, b in enumerate(BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        e = e - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(e))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return CENTRE + F.degrees(F.atan2(F.sinh(e), F.cos(x))), F.degrees(phi)


def areas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AREAS, "aoi string, west double, south double, east double, north double")


def grids(boxes: DataFrame) -> DataFrame:
    """The grid of each area: corners are projected, and the box is snapped inward to whole strides."""
    corners = {k: utm44(F.col(x), F.col(y)) for k, x, y in (("sw", "west", "south"), ("nw", "west", "north"), ("se", "east", "south"), ("ne", "east", "north"))}
    up = lambda a, b: (F.ceil(F.greatest(a, b) / STRIDE_M) * STRIDE_M).cast("int")
    down = lambda a, b: (F.floor(F.least(a, b) / STRIDE_M) * STRIDE_M).cast("int")
    out = boxes.select(
        "aoi",
        up(corners["sw"][0], corners["nw"][0]).alias("xmin"), up(corners["sw"][1], corners["se"][1]).alias("ymin"),
        down(corners["se"][0], corners["ne"][0]).alias("xmax"), down(corners["nw"][1], corners["ne"][1]).alias("ymax"),
    )
    return out.select("*", ((F.col("xmax") - F.col("xmin")) / 10).cast("int").alias("width"), ((F.col("ymax") - F.col("ymin")) / 10).cast("int").alias("height"))


def tiles(grid: DataFrame, salt: str = "geoloom") -> DataFrame:
    """All tiles of the grids: id, place, window in the raster and split."""
    span = lambda low, high: F.explode(F.sequence((F.col(low) / STRIDE_M).cast("int"), ((F.col(high) - TILE_M) / STRIDE_M).cast("int")))
    rows = grid.select("*", span("xmin", "xmax").alias("tc")).select("*", span("ymin", "ymax").alias("tr"))
    block = lambda c, d: F.floor((F.col(c) * STRIDE_M + d) / BLOCK_M).cast("int")
    side = lambda dx, dy: F.when(unit_hash(F.lit(salt), block("tc", dx), block("tr", dy)) < TEST_SHARE, "test").otherwise("dev")
    sides = F.array_distinct(F.array(*[side(dx, dy) for dx in (0, TILE_M - 1) for dy in (0, TILE_M - 1)]))
    row_off = ((F.col("ymax") - F.col("tr") * STRIDE_M - TILE_M) / 10).cast("int")
    return rows.select(
        "aoi", tile_id(F.col("tc"), F.col("tr")).alias("tile_id"), "tc", "tr", ((F.col("tc") * STRIDE_M - F.col("xmin")) / 10).cast("int").alias("col_off"),
        row_off.alias("row_off"), F.when(F.size(sides) > 1, "buffer").otherwise(F.get(sides, F.lit(0))).alias("split"),
    )
