"""Queries of the analysis grid and of the whole quality mask."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import grid as G
from geoloom.operators.quality import quality_mask, shadow_moves
from geoloom.sources.fixtures import read

#: The sun of the fixture's scenes and the size of their pixels.
AZIMUTH, ELEVATION, GSD = 150.0, 50.0, 100.0
MOVES = shadow_moves(AZIMUTH, ELEVATION, GSD)
SCENE = """SELECT CAST(l_linenumber AS INT) AS obs, CAST(l_orderkey % 48 AS INT) AS r, CAST(l_partkey % 48 AS INT) AS c, min(CAST(floor(l_quantity * 60) AS INT)) AS b02,
 max(CAST(floor(l_extendedprice / 20) AS INT)) AS b03, min(CAST(floor(l_discount * 30000) AS INT)) AS b04, max(CAST(floor(l_tax * 50000) AS INT)) AS b08,
 CAST(max(l_partkey % 4001) AS INT) AS b11, [4, 5, 4, 5, 8, 10, 3, 11, 0, 1, 2, 5][CAST(min(l_orderkey) % 12 AS INT) + 1] AS scl, CAST(max(l_quantity) * 4 AS DOUBLE) AS dem FROM lineitem GROUP BY 1, 2, 3"""


def aoi_grid(spark, sf_dir):
    return G.grids(G.areas(spark))


def grid_tiles(spark, sf_dir):
    return G.tiles(G.grids(G.areas(spark)))


def scene(spark, sf_dir):
    # Spark counts the places of an array literal from 0, DuckDB from 1.
    return spark.sql(SCENE.replace("FROM lineitem", "FROM {t}").replace("[4, 5", "array(4, 5").replace("2, 5][CAST(min(l_orderkey) % 12 AS INT) + 1]", "2, 5)[CAST(min(l_orderkey) % 12 AS INT)]"), t=read(spark, sf_dir, "lineitem"))


def quality_flags(spark, sf_dir):
    """The mask of a scene made of the lines: digital numbers are reflectances x 10000, 0 is no data."""
    raw = scene(spark, sf_dir)
    refl = lambda b: F.when(F.least("b02", "b03", "b04", "b08", "b11") > 0, F.col(b) / 10000).alias(b)
    return quality_mask(raw.select("obs", "r", "c", *[refl(b) for b in ("b02", "b03", "b04", "b08", "b11")], "scl", "dem"), AZIMUTH, ELEVATION, GSD)


_A = ", ".join(f"('{n}', {w}::DOUBLE, {s}::DOUBLE, {e}::DOUBLE, {t}::DOUBLE)" for n, w, s, e, t in G.AREAS)


def _utm(lon, lat):
    t = f"sinh(atanh(sin(radians({lat}))) - {G.ECC!r}::DOUBLE * atanh({G.ECC!r}::DOUBLE * sin(radians({lat}))))"
    lam = f"radians({lon} - 81.0::DOUBLE)"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    east = " + ".join([eta, *(f"{a!r}::DOUBLE * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(G.ALPHA, 1))])
    north = " + ".join([xi, *(f"{a!r}::DOUBLE * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(G.ALPHA, 1))])
    k = repr(G.SCALE * G.RADIUS) + "::DOUBLE"
    return f"(500000.0::DOUBLE + {k} * ({east}))", f"({k} * ({north}))"


_SW, _NW, _SE, _NE = _utm("west", "south"), _utm("west", "north"), _utm("east", "south"), _utm("east", "north")
GRID = f"""SELECT *, ((xmax - xmin) // 10)::INT AS width, ((ymax - ymin) // 10)::INT AS height FROM (SELECT aoi, (ceil(greatest({_SW[0]}, {_NW[0]}) / 640) * 640)::INT AS xmin, (ceil(greatest({_SW[1]}, {_SE[1]}) / 640) * 640)::INT AS ymin,
 (floor(least({_SE[0]}, {_NE[0]}) / 640) * 640)::INT AS xmax, (floor(least({_NW[1]}, {_NE[1]}) / 640) * 640)::INT AS ymax FROM (VALUES {_A}) v(aoi, west, south, east, north))"""


def _side(dx, dy):
    return f"CASE WHEN ('0x' || substr(sha256('geoloom-' || CAST(floor((tc * 640 + {dx}) / 2560.0) AS INT) || '-' || CAST(floor((tr * 640 + {dy}) / 2560.0) AS INT)), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.3 THEN 'test' ELSE 'dev' END"


TILES = f"""WITH g AS ({GRID}), t AS (SELECT *, unnest(range(ymin // 640, (ymax - 1280) // 640 + 1))::INT AS tr FROM (SELECT *, unnest(range(xmin // 640, (xmax - 1280) // 640 + 1))::INT AS tc FROM g)),
 s AS (SELECT *, list_distinct([{", ".join(_side(a, b) for a in (0, 1279) for b in (0, 1279))}]) AS sides FROM t)
 SELECT aoi, '32644_g10m_s128s64_c' || tc || '_r' || tr AS tile_id, tc, tr, ((tc * 640 - xmin) // 10)::INT AS col_off, ((ymax - tr * 640 - 1280) // 10)::INT AS row_off, CASE WHEN len(sides) > 1 THEN 'buffer' ELSE sides[1] END AS split FROM s"""

_ND = "CASE WHEN b03 + b11 = 0 THEN 0.0 ELSE (b03 - b11)::DOUBLE / (b03 + b11) END"
MASK = f"""WITH raw AS ({SCENE}), v AS (SELECT obs, r, c, scl, dem, least(b02, b03, b04, b08, b11) > 0 AS valid, b02 / 10000.0::DOUBLE AS b02, b03 / 10000.0::DOUBLE AS b03, b04 / 10000.0::DOUBLE AS b04, b08 / 10000.0::DOUBLE AS b08, b11 / 10000.0::DOUBLE AS b11 FROM raw),
 o3 AS (SELECT a.range - 3 AS dr, b.range - 3 AS dc FROM range(7) a, range(7) b), o2 AS (SELECT a.range - 2 AS dr, b.range - 2 AS dc FROM range(5) a, range(5) b),
 nc AS (SELECT DISTINCT obs, r + dr AS r, c + dc AS c, true AS nc FROM v, o3 WHERE scl IN (8, 9)),
 w AS (SELECT v.*, coalesce(nc, false) AND valid AS cloud, CASE WHEN valid THEN b02 - b04 * 0.5::DOUBLE - 0.08::DOUBLE END AS hot, CASE WHEN valid THEN {_ND} ELSE 0.0 END AS mndwi FROM v LEFT JOIN nc USING (obs, r, c)),
 m AS (SELECT obs, median(hot) AS med, count(*) AS clear FROM w WHERE valid AND NOT cloud AND scl IN (4, 5) GROUP BY obs),
 d AS (SELECT obs, median(abs(hot - med)) * 1.4826::DOUBLE AS mad FROM w JOIN m USING (obs) WHERE valid AND NOT cloud AND scl IN (4, 5) GROUP BY obs),
 h AS (SELECT w.*, (scl = 10 OR coalesce(valid AND clear > 500 AND NOT mndwi > 0.1 AND hot > med + 4.0::DOUBLE * greatest(mad, 0.001::DOUBLE) AND hot > 0.02, false)) AND NOT cloud AS haze FROM w LEFT JOIN m USING (obs) LEFT JOIN d USING (obs)),
 ca AS (SELECT DISTINCT obs, r + dr AS r, c + dc AS c, true AS ca FROM h, (VALUES {", ".join(f"({a},{b})" for a, b in MOVES)}) o(dr, dc) WHERE cloud),
 dk AS (SELECT h.obs, h.r, h.c FROM h LEFT JOIN ca USING (obs, r, c) WHERE scl = 3 OR (coalesce(ca, false) AND CASE WHEN valid THEN b08 ELSE 1.0 END < 0.16 AND mndwi < 0.2)),
 ns AS (SELECT DISTINCT obs, r + dr AS r, c + dc AS c, true AS ns FROM dk, o2),
 nb AS (SELECT v.obs, v.r, v.c, coalesce((s.dem - n.dem) / 2, s.dem - v.dem, v.dem - n.dem, 0.0) / 100.0::DOUBLE AS gy, coalesce((e.dem - w.dem) / 2, e.dem - v.dem, v.dem - w.dem, 0.0) / 100.0::DOUBLE AS gx FROM v
  LEFT JOIN v s ON s.obs = v.obs AND s.r = v.r + 1 AND s.c = v.c LEFT JOIN v n ON n.obs = v.obs AND n.r = v.r - 1 AND n.c = v.c LEFT JOIN v e ON e.obs = v.obs AND e.r = v.r AND e.c = v.c + 1 LEFT JOIN v w ON w.obs = v.obs AND w.r = v.r AND w.c = v.c - 1),
 tr AS (SELECT obs, r, c, sl, cos(sl) * cos(radians(40.0::DOUBLE)) + sin(sl) * sin(radians(40.0::DOUBLE)) * cos(radians(150.0::DOUBLE) - atan2(-gx, gy)) AS ci FROM (SELECT *, atan(sqrt(gx * gx + gy * gy)) AS sl FROM nb))
 SELECT h.obs, h.r, h.c, ((NOT valid OR scl = 0)::INT + 2 * (scl = 1)::INT + 4 * cloud::INT + 8 * haze::INT + 16 * (coalesce(ns, false) AND valid AND NOT cloud)::INT
 + 32 * ((scl = 11 OR (mndwi > 0.4 AND b03 > 0.3)) AND valid)::INT + 64 * (valid AND (ci < 0.15 OR (scl = 2 AND sl > radians(10.0::DOUBLE))))::INT)::INT AS mask FROM h LEFT JOIN ns USING (obs, r, c) JOIN tr USING (obs, r, c)"""

QUERIES = {"aoi_grid": aoi_grid, "grid_tiles": grid_tiles, "quality_mask": quality_flags}
ORACLE = {"aoi_grid": GRID, "grid_tiles": TILES, "quality_mask": MASK}
