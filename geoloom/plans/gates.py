"""Queries over candidate objects: cells that grew from the first observation to the second, through the six gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.config import T
from geoloom.operators import gates as G
from geoloom.operators import raster as R
from geoloom.plans.change import RASTER, _from

#: Values of three observations at the cells that all have: before, after, later. What is steep before is an edge.
SEEN = f"""SELECT a.r, a.c, a.v AS va, b.v AS vb, d.v AS vd FROM ({RASTER}) a JOIN ({RASTER}) b ON b.r = a.r AND b.c = a.c JOIN ({RASTER}) d ON d.r = a.r AND d.c = a.c WHERE a.obs = 1 AND b.obs = 2 AND d.obs = 3"""
STEEP, STABLE, QUARTER = 6, 1, 24


def _cells(spark, sf_dir):
    """The cells with what the gates ask of each, and the lines of each quarter of the raster over its stable cells."""
    rows = _from(spark, sf_dir, RASTER, "lineitem")
    of = lambda k, v: rows.where(F.col("obs") == k).select("r", "c", F.col("v").alias(v))
    seen = of(1, "va").join(of(2, "vb"), ["r", "c"]).join(of(3, "vd"), ["r", "c"])
    right = of(1, "v1").withColumn("c", F.col("c") - 1)
    quarter = [F.floor(F.col(x) / QUARTER).cast("int").alias(f"q{x}") for x in ("r", "c")]
    stable = seen.where(F.abs(F.col("vb") - F.col("va")) < STABLE).select(*quarter, "va", "vb")
    gain = stable.groupBy("qr", "qc").agg(F.median(F.col("va") / F.col("vb")).alias("gain"))
    fit = stable.join(gain, ["qr", "qc"]).groupBy("qr", "qc").agg(F.first("gain").alias("gain"), (F.sqrt(F.avg((F.col("gain") * F.col("vb") - F.col("va")) ** 2)) / 50).alias("rmse"))
    flags = {
        "usable": F.floor(F.col("vb") * 7) % 10 != 0, "edge": F.coalesce(F.abs(F.col("va") - F.col("v1")) > STEEP, F.lit(False)),
        "seasonal": (F.col("vd") * 2).between(*T.jrc_seasonal_occurrence), "post": F.col("vd") > F.col("va"),
    }
    return seen.join(right, ["r", "c"], "left").withColumns(flags), fit


def candidate_gates(spark, sf_dir):
    """Every candidate object's measures and the first gate that stops it."""
    cells, fit = _cells(spark, sf_dir)
    grown = cells.where("vb > va")
    named = grown.join(R.components(grown.select("r", "c")), ["r", "c"])
    kind = F.when(F.col("before") < 22, "water_expansion").when(F.col("before") > 28, "road_development").otherwise("default")
    mean = named.groupBy("label").agg(F.avg("va").alias("before")).select("label", kind.alias("type"))
    quarter = {f"q{x}": F.floor(F.col(y) / QUARTER).cast("int") for x, y in (("r", "top"), ("c", "left"))}
    return G.judged(G.measures(named).join(mean, "label").withColumns(quarter).join(fit, ["qr", "qc"], "left"))


def candidates(spark, sf_dir):
    shown = [F.round(c, 6).alias(c) for c in ("elongation", "usable_share", "edge_share", "seasonal_share", "post_share", "gain", "rmse")]
    return candidate_gates(spark, sf_dir).select("label", "type", "n", "width", *shown, "reason")


def candidate_funnel(spark, sf_dir):
    return G.funnel(candidate_gates(spark, sf_dir))


_HALF = "(rr + cc) / 2"
_ROOT = "sqrt((rr - cc) * (rr - cc) / 4 + rc * rc)"
_OBJECTS = f"""WITH RECURSIVE seen AS MATERIALIZED ({SEEN}), x AS MATERIALIZED (SELECT s.*, floor(vb * 7) % 10 <> 0 AS usable, coalesce(abs(va - n.v) > {STEEP}, false) AS edge, vd * 2 BETWEEN 5 AND 95 AS seasonal, vd > va AS post
  FROM seen s LEFT JOIN (SELECT r, c, v FROM ({RASTER}) WHERE obs = 1) n ON n.r = s.r AND n.c = s.c + 1),
 k AS MATERIALIZED (SELECT r * 1048576::BIGINT + c AS a, * FROM x WHERE vb > va), e AS MATERIALIZED (SELECT p.a, q.a AS b FROM k p JOIN k q ON abs(p.r - q.r) + abs(p.c - q.c) = 1),
 reach(a, b) AS (SELECT a, a FROM k UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b), l AS (SELECT a, min(b) AS label FROM reach GROUP BY a),
 o AS (SELECT label, k.*, (SELECT count(*) FROM k q WHERE abs(q.r - k.r) <= 1 AND abs(q.c - k.c) <= 1) = 9 AS deep FROM k JOIN l USING (a)),
 m AS (SELECT label, count(*) AS n, CASE WHEN bool_or(deep) THEN 3 ELSE 1 END AS width, avg(va) AS before, min(r) AS top, min(c) AS lft, avg(usable::INT) AS usable_share, avg(edge::INT) AS edge_share, avg(seasonal::INT) AS seasonal_share, avg(post::INT) AS post_share,
  avg(r * r) - avg(r) * avg(r) + 1 / 12.0::DOUBLE AS rr, avg(c * c) - avg(c) * avg(c) + 1 / 12.0::DOUBLE AS cc, avg(r * c) - avg(r) * avg(c) AS rc FROM o GROUP BY label),
 st AS (SELECT r // {QUARTER} AS qr, c // {QUARTER} AS qc, va, vb FROM seen WHERE abs(vb - va) < {STABLE}), g AS (SELECT qr, qc, median(va / vb) AS gain FROM st GROUP BY 1, 2),
 f AS (SELECT qr, qc, any_value(gain) AS gain, sqrt(avg((gain * vb - va) ** 2)) / 50 AS rmse FROM st JOIN g USING (qr, qc) GROUP BY 1, 2),
 t AS (SELECT m.*, sqrt(({_HALF} + {_ROOT}) / ({_HALF} - {_ROOT})) AS elongation, gain, rmse, CASE WHEN before < 22 THEN 'water_expansion' WHEN before > 28 THEN 'road_development' ELSE 'default' END AS type FROM m LEFT JOIN f ON f.qr = top // {QUARTER} AND f.qc = lft // {QUARTER}),
 j AS (SELECT *, usable_share >= 0.8 AS "G1", NOT (width <= 1.5 AND edge_share >= 0.6) AS "G2", coalesce(rmse <= 0.04 AND gain BETWEEN 0.8 AND 1.25, false) AS "G3", type NOT LIKE 'water%' OR 1 - seasonal_share >= 0.1::DOUBLE AS "G4",
  n >= CASE WHEN type LIKE 'water%' THEN 20 ELSE 10 END AND (type <> 'road_development' OR elongation >= 5) AS "G5", post_share >= 0.6 AS "G6" FROM t)"""
CANDIDATES = _OBJECTS + " SELECT label, type, n, width, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("elongation", "usable_share", "edge_share", "seasonal_share", "post_share", "gain", "rmse")) + ', CASE WHEN NOT "G1" THEN \'G1\' WHEN NOT "G2" THEN \'G2\' WHEN NOT "G3" THEN \'G3\' WHEN NOT "G4" THEN \'G4\' WHEN NOT "G5" THEN \'G5\' WHEN NOT "G6" THEN \'G6\' END AS reason FROM j'
_ALL = lambda names: " AND ".join(f'"{g}"' for g in names) or "TRUE"
FUNNEL = _OBJECTS + " " + " UNION ALL ".join(
    f"SELECT '{g}' AS gate, count(*) FILTER (WHERE {_ALL(G.GATES[:i])}) AS n_in, count(*) FILTER (WHERE {_ALL(G.GATES[: i + 1])}) AS n_out, count(*) FILTER (WHERE {_ALL([*G.GATES[:i], *G.GATES[i + 1 :]])}) - count(*) FILTER (WHERE {_ALL(G.GATES)}) AS without FROM j"
    for i, g in enumerate(G.GATES)
)

QUERIES = {"candidate_gates": candidates, "candidate_funnel": candidate_funnel}
ORACLE = {"candidate_gates": CANDIDATES, "candidate_funnel": FUNNEL}
