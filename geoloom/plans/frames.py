"""Queries over frames of a series and small decisions: windows of time, clearest frames, predicates, bootstrap, audit append."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.config import BLOCK_M, MARGIN_M, STRIDE_M, T, TEST_SHARE, TILE_M
from geoloom.functions import columns as C
from geoloom.operators import raster as R
from geoloom.operators.timeline import first_ranked
from geoloom.plans.change import CELLS, POINTS, _cells, _points
from geoloom.plans.grid import _side
from geoloom.sources.fixtures import PIXELS, SCENES, pixels, read, scenes


def frame_interval(spark, sf_dir):
    """Frames of each area inside its event's window, by equality on the area and a filter on the date."""
    events = scenes(spark, sf_dir).groupBy("aoi").agg(F.min("acquired_at").alias("a"), F.max("acquired_at").alias("b"))
    win = events.select("aoi", F.date_add(F.col("a").cast("date"), 100).alias("start"), F.date_sub(F.col("b").cast("date"), 100).alias("stop"))
    s = scenes(spark, sf_dir).select("aoi", "scene_id", F.col("acquired_at").cast("date").alias("day"))
    return s.join(win, "aoi").where(F.col("day").between(F.col("start"), F.col("stop"))).select("aoi", "scene_id", "day")


INTERVAL = f"""SELECT s.aoi, scene_id, CAST(acquired_at AS DATE) AS day FROM ({SCENES}) s JOIN (SELECT aoi, CAST(min(acquired_at) AS DATE) + 100 AS a, CAST(max(acquired_at) AS DATE) - 100 AS b FROM ({SCENES}) GROUP BY aoi) w USING (aoi)
 WHERE CAST(acquired_at AS DATE) BETWEEN a AND b"""


HOT = "b02 / 10000.0::DOUBLE - b04 / 20000.0::DOUBLE - 0.08::DOUBLE"


def _hot():
    return F.col("b02") / 10000 - F.col("b04") / 20000 - 0.08


def haze_reference(spark, sf_dir):
    """Per area: the median, over its six clearest frames with pixels, of the 90th percentile of their haze transform."""
    high = pixels(spark, sf_dir).groupBy(F.col("obs_id").alias("scene_id")).agg(F.percentile(_hot(), 0.9).alias("p90"))
    six = first_ranked(scenes(spark, sf_dir).join(high, "scene_id"), ["aoi"], [F.col("cloud"), F.col("scene_id")], 6)
    return six.groupBy("aoi").agg(F.count("*").alias("n"), F.round(F.median("p90"), 6).alias("reference"))


HAZE_REF = f"""SELECT aoi, count(*) AS n, round(median(p90), 6) AS reference FROM (SELECT * FROM ({SCENES}) JOIN (SELECT obs_id AS scene_id, quantile_cont({HOT}, 0.9) AS p90 FROM ({PIXELS}) GROUP BY 1) USING (scene_id)
 QUALIFY row_number() OVER (PARTITION BY aoi ORDER BY cloud, scene_id) <= 6) GROUP BY aoi"""


def last_dry_frame(spark, sf_dir):
    s = scenes(spark, sf_dir).where("month(acquired_at) IN (11, 12, 1, 2) AND cloud < 150000")
    return s.groupBy("aoi").agg(F.max_by("scene_id", F.struct("acquired_at", "scene_id")).alias("scene_id"), F.max("acquired_at").alias("acquired_at"))


DRY = f"SELECT aoi, scene_id, acquired_at FROM ({SCENES}) WHERE month(acquired_at) IN (11, 12, 1, 2) AND cloud < 150000 QUALIFY row_number() OVER (PARTITION BY aoi ORDER BY acquired_at DESC, scene_id DESC) = 1"


def frame_stats(spark, sf_dir):
    """Water share and mean NDVI over the usable pixels of each observation."""
    from geoloom.functions import columns as C

    p = pixels(spark, sf_dir).where("scl IN (4, 5, 6, 7)")
    return p.groupBy("obs_id").agg(F.count("*").alias("n"), F.round(F.avg((C.mndwi() > 0.1).cast("double")), 6).alias("water"), F.round(F.avg(C.ndvi()), 6).alias("mean_ndvi"))


_ND = "CASE WHEN ({a}) + ({b}) = 0 THEN 0.0 ELSE CAST(({a}) - ({b}) AS DOUBLE) / (({a}) + ({b})) END"
FRAME = f"SELECT obs_id, count(*) AS n, round(avg(({_ND.format(a='b03', b='b11')} > 0.1)::INT), 6) AS water, round(avg({_ND.format(a='b08', b='b04')}), 6) AS mean_ndvi FROM ({PIXELS}) WHERE scl IN (4, 5, 6, 7) GROUP BY obs_id"


def demo_states(spark, sf_dir):
    """State before and after of each pixel under the three rule families, and the display's own usable mask: scene class, red, haze above the area's reference."""
    from geoloom.functions import columns as C

    v, w, bright = C.ndvi(), C.mndwi(), (F.col("b02") + F.col("b03") + F.col("b04")) / 30000
    rule = F.col("obs_id") % 3
    before = F.when(rule == 0, v >= 0.3).when(rule == 1, w > 0.1).otherwise(F.lit(True))
    after = F.when(rule == 0, (v < 0.15) & (w < 0)).when(rule == 1, w <= 0.1).otherwise((bright >= 0.2) & (v < 0.25))
    plain = ~F.col("scl").isin(0, 3, 8, 9, 10) & (F.col("b04") > 0)
    usable = plain & ~((_hot() > F.coalesce("reference", F.lit(0.0)) + T.haze_min_hot) & (w < 0.1))
    area = scenes(spark, sf_dir).select(F.col("scene_id").alias("obs_id"), "aoi").join(haze_reference(spark, sf_dir).select("aoi", "reference"), "aoi").select("obs_id", "reference")
    return pixels(spark, sf_dir).join(area, "obs_id", "left").select("obs_id", "px", before.alias("was"), after.alias("became"), usable.alias("usable"))


_V, _WT = _ND.format(a="b08", b="b04"), _ND.format(a="b03", b="b11")
STATES = f"""SELECT obs_id, px, CASE WHEN obs_id % 3 = 0 THEN {_V} >= 0.3 WHEN obs_id % 3 = 1 THEN {_WT} > 0.1 ELSE true END AS was,
 CASE WHEN obs_id % 3 = 0 THEN {_V} < 0.15 AND {_WT} < 0 WHEN obs_id % 3 = 1 THEN {_WT} <= 0.1 ELSE (b02 + b03 + b04) / 30000.0::DOUBLE >= 0.2 AND {_V} < 0.25 END AS became,
 scl NOT IN (0, 3, 8, 9, 10) AND b04 > 0 AND NOT ({HOT} > coalesce(reference, 0) + 0.02::DOUBLE AND {_WT} < 0.1) AS usable
 FROM ({PIXELS}) p LEFT JOIN (SELECT scene_id, reference FROM ({SCENES}) JOIN ({HAZE_REF}) USING (aoi)) a ON a.scene_id = p.obs_id"""


def offset_probe(spark, sf_dir):
    """Offset of each observation by its low percentiles where the baseline is recent (the fixture's scenes of even number)."""
    p = pixels(spark, sf_dir).groupBy(F.floor(F.col("obs_id") / 500).alias("scene")).agg(*[F.percentile(F.col(b) + 940, 0.005).alias(n) for n, b in (("a", "b08"), ("b", "b11"))])
    recent = F.col("scene") % 2 == 0
    return p.select("scene", F.when(recent & (F.greatest("a", "b") > T.probe_offset_dn), -1000).otherwise(0).alias("shift"), F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


PROBE = f"SELECT scene, CASE WHEN scene % 2 = 0 AND greatest(a, b) > 950 THEN -1000 ELSE 0 END AS shift, round(a, 4) AS a, round(b, 4) AS b FROM (SELECT CAST(floor(obs_id / 500) AS BIGINT) AS scene, quantile_cont(b08 + 940, 0.005) AS a, quantile_cont(b11 + 940, 0.005) AS b FROM ({PIXELS}) GROUP BY 1)"


def reference_bootstrap(spark, sf_dir):
    """The first scene of an area with enough usable becomes its reference; scenes before it are suspect. Usable: 1 less the cloud figure's share."""
    s = scenes(spark, sf_dir).withColumn("good", 1 - F.col("cloud") / 300000 >= T.reference_min_usable)
    first = s.where("good").groupBy("aoi").agg(F.min_by(F.struct("acquired_at", "scene_id"), F.struct("acquired_at", "scene_id")).alias("ref"))
    at = F.struct("acquired_at", "scene_id")
    status = F.when(F.col("ref").isNull() | (at < F.col("ref")), "suspect").when(at == F.col("ref"), "reference").otherwise("compare")
    return s.join(first, "aoi", "left").select("scene_id", "aoi", status.alias("reg_status"))


BOOT = f"""WITH s AS ({SCENES}), f AS (SELECT aoi, scene_id AS ref, acquired_at AS at_ref FROM s WHERE 1 - cloud / 300000 >= 0.6 QUALIFY row_number() OVER (PARTITION BY aoi ORDER BY acquired_at, scene_id) = 1)
 SELECT scene_id, s.aoi, CASE WHEN ref IS NULL OR acquired_at < at_ref OR (acquired_at = at_ref AND scene_id < ref) THEN 'suspect' WHEN scene_id = ref THEN 'reference' ELSE 'compare' END AS reg_status FROM s LEFT JOIN f ON s.aoi = f.aoi"""


def shift_median(spark, sf_dir):
    """Component-wise median of the windows' shifts, their robust spread and the median peak."""
    e = read(spark, sf_dir, "events").select("user_id", (F.col("value") / 100).alias("dy"), ((F.col("event_id") % 17) / 10.0).cast("double").alias("dx"), (F.col("event_id") % 9 + 1).alias("peak"))
    med = e.groupBy("user_id").agg(F.median("dy").alias("my"), F.median("dx").alias("mx"), F.median("peak").alias("peak"), F.count("*").alias("windows"))
    far = (F.col("dy") - F.col("my")) * (F.col("dy") - F.col("my")) + (F.col("dx") - F.col("mx")) * (F.col("dx") - F.col("mx"))
    spread = e.drop("peak").join(med.select("user_id", "my", "mx"), "user_id").groupBy("user_id").agg(F.sqrt(F.median(far)).alias("spread"))
    return med.join(spread, "user_id").select("user_id", "windows", F.round("my", 6).alias("dy"), F.round("mx", 6).alias("dx"), F.round(F.when(F.col("windows") == 1, 0.0).otherwise(F.col("spread")), 6).alias("residual"), F.round("peak", 4).alias("peak"))


MEDIAN = """WITH e AS (SELECT user_id, value / 100 AS dy, (event_id % 17) / 10.0::DOUBLE AS dx, event_id % 9 + 1 AS peak FROM events), m AS (SELECT user_id, median(dy) AS my, median(dx) AS mx, median(peak) AS peak, count(*) AS windows FROM e GROUP BY user_id)
 SELECT user_id, windows, round(my, 6) AS dy, round(mx, 6) AS dx, round(CASE WHEN windows = 1 THEN 0.0 ELSE (SELECT sqrt(median((dy - my) ** 2 + (dx - mx) ** 2)) FROM e WHERE e.user_id = m.user_id) END, 6) AS residual, round(peak, 4) AS peak FROM m"""


def split_paint(spark, sf_dir):
    """Pixels with the split of their core tile, of whose corners' blocks a hash decides: buffer where they differ."""
    place = [F.floor((F.col(x) - MARGIN_M) / STRIDE_M).cast("int").alias(t) for x, t in (("x", "tc"), ("y", "tr"))]
    p = _points(spark, sf_dir).select(*place, "v")
    block = lambda t, d: F.floor((F.col(t) * STRIDE_M + d) / BLOCK_M).cast("int")
    side = lambda dx, dy: F.when(C.unit_hash(F.lit("geoloom"), block("tc", dx), block("tr", dy)) < TEST_SHARE, "test").otherwise("dev")
    sides = F.array_distinct(F.array(*[side(dx, dy) for dx in (0, TILE_M - 1) for dy in (0, TILE_M - 1)]))
    split = p.select("tc", "tr").distinct().withColumn("split", F.when(F.size(sides) > 1, "buffer").otherwise(F.get(sides, F.lit(0))))
    return p.join(split, ["tc", "tr"]).groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("v"))


PAINT = f"""SELECT CASE WHEN len(sides) > 1 THEN 'buffer' ELSE sides[1] END AS split, count(*) AS n, round(sum(v), 2) AS v FROM (SELECT v, list_distinct([{", ".join(_side(a, b) for a in (0, 1279) for b in (0, 1279))}]) AS sides
 FROM (SELECT CAST(floor((x - 320) / 640.0) AS INT) AS tc, CAST(floor((y - 320) / 640.0) AS INT) AS tr, v FROM ({POINTS}))) GROUP BY 1"""


def scene_area_lookup(spark, sf_dir):
    """Each scene with its area's segment and grid origin."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("aoi"), "c_mktsegment", (F.col("c_custkey") * 7919 % 100000 / 640).alias("g"))
    return scenes(spark, sf_dir).join(c, "aoi").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_distinct("aoi").alias("areas"), F.sum(F.floor("g").cast("long") * 640).alias("origins"))


LOOKUP = f"SELECT c_mktsegment, count(*) AS n, count(DISTINCT aoi) AS areas, sum(CAST(floor(c_custkey * 7919 % 100000 / 640.0) AS BIGINT) * 640)::BIGINT AS origins FROM ({SCENES}) JOIN customer ON aoi = c_custkey GROUP BY 1"


def sql_predicates(spark, sf_dir):
    """Membership, null-safe inequality, months, JSON numbers and intervals in one filter."""
    e = read(spark, sf_dir, "events")
    keep = F.col("event_type").isin("view", "purchase") & ~F.col("user_id").eqNullSafe(F.lit(7)) & (F.month("ts") == 1) & (F.get_json_object("props", "$.k").cast("int") > 30) & (F.col("ts") < F.lit("2024-01-31").cast("timestamp_ntz") - F.expr("INTERVAL 10 DAYS"))
    return e.where(keep).select("event_id", "user_id", "event_type", "ts")


PREDICATES = "SELECT event_id, user_id, event_type, ts FROM events WHERE event_type IN ('view', 'purchase') AND user_id IS DISTINCT FROM 7 AND month(ts) = 1 AND CAST(json_extract_string(props, '$.k') AS INT) > 30 AND ts < TIMESTAMP '2024-01-31' - INTERVAL 10 DAYS"


def footprint_filter(spark, sf_dir):
    """Scenes in the grid's projection whose footprint, shrunk by a margin, contains their area's box: an equality on the area, then bounds."""
    sc = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 7919 % 100000).alias("x"), (F.col("c_custkey") * 104729 % 100000).alias("y"), (32643 + F.col("c_nationkey") % 3).alias("epsg"), (F.col("c_custkey") % 100 + 1).alias("area"))
    box = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("area"), (F.col("s_suppkey") * 6151 % 100000).alias("x0"), (F.col("s_suppkey") * 49157 % 100000).alias("y0"))
    half, margin, side = 40000, 200, 4000
    inside = (F.col("x") - half + margin <= F.col("x0")) & (F.col("x0") + side <= F.col("x") + half - margin) & (F.col("y") - half + margin <= F.col("y0")) & (F.col("y0") + side <= F.col("y") + half - margin)
    return sc.where("epsg = 32644").join(box, "area").where(inside).select("c_custkey", "area")


FOOTPRINT = """SELECT c_custkey, area FROM (SELECT c_custkey, c_custkey * 7919 % 100000 AS x, c_custkey * 104729 % 100000 AS y, c_custkey % 100 + 1 AS area FROM customer WHERE 32643 + c_nationkey % 3 = 32644)
 JOIN (SELECT s_suppkey AS area, s_suppkey * 6151 % 100000 AS x0, s_suppkey * 49157 % 100000 AS y0 FROM supplier) USING (area) WHERE x - 39800 <= x0 AND x0 + 4000 <= x + 39800 AND y - 39800 <= y0 AND y0 + 4000 <= y + 39800"""


def text_search(spark, sf_dir):
    """Rows whose name holds the query's first token, whose category holds a word, or whose state is settled."""
    token = F.lower(F.element_at(F.split(F.lit("green area near water"), r"\s+"), 1))
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    return p.where(F.lower("p_name").contains(token) | F.lower("p_type").contains("brass") | F.col("p_size").isin(1, 2)).select("p_partkey", "p_name")


TEXT = "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'green') OR contains(lower(p_type), 'brass') OR p_size IN (1, 2)"


def audit_append(spark, sf_dir):
    """New records of each chain linked to its head: in SQL the link hashes what was there with what is new.

    A chain's records are hashed in order by a fold over its own short list; chains are independent of each other.
    """
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"))
    lists = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("rows"))
    fold = F.aggregate("rows", F.lit("0" * 64), lambda h, x: F.sha2(F.concat(h, F.lit('{"action":"'), x["role"], F.lit('","seq":'), x["turn"].cast("string"), F.lit("}")), 256))
    return lists.select("conv_id", F.size("rows").alias("n"), fold.alias("head"))


APPEND = """WITH RECURSIVE c AS (SELECT conv_id, coalesce(role, '') AS role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS k FROM conversations),
 f(conv_id, k, h) AS (SELECT DISTINCT conv_id, 0::BIGINT, repeat('0', 64) FROM c UNION ALL SELECT c.conv_id, c.k, sha256(f.h || '{"action":"' || c.role || '","seq":' || c.turn || '}') FROM f JOIN c ON c.conv_id = f.conv_id AND c.k = f.k + 1)
 SELECT conv_id, max(k)::INT AS n, arg_max(h, k) AS head FROM f GROUP BY conv_id"""


def water_reference(spark, sf_dir):
    """Components of water cells of at least six cells: the reference water body's cells."""
    parts = R.components(_cells(spark, sf_dir))
    size = parts.groupBy("label").agg(F.count("*").alias("n")).where("n >= 6")
    return parts.join(size, "label").select("r", "c", "n")


WATER = f"""WITH RECURSIVE s AS ({CELLS}), k AS (SELECT r * 1048576::BIGINT + c AS a, r, c FROM s), e AS (SELECT a.a, b.a AS b FROM k a JOIN k b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
 reach(a, b) AS (SELECT a, a FROM k UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b), l AS (SELECT a, count(*) AS n FROM reach GROUP BY a) SELECT r, c, n FROM l JOIN k USING (a) WHERE n >= 6"""


def outcome_counts(spark, sf_dir):
    return scenes(spark, sf_dir).groupBy("status", "priority").agg(F.count("*").alias("n"), F.round(F.avg("cloud"), 4).alias("mean_cloud"))


def newest_model(spark, sf_dir):
    """The latest active model of each kind, if its file still has the checksum that was recorded; else the problem.

    A source's documents are its models, those in German inactive; the recorded checksum of every seventh is of another text.
    """
    text = F.coalesce("text", F.lit(""))
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2(text.cast("binary"), 256).alias("found"), F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit("x"))).otherwise(text).cast("binary"), 256).alias("recorded"))
    last = d.where("lang <> 'de'").groupBy("source").agg(F.max_by(F.struct("doc_id", "found", "recorded"), "doc_id").alias("m")).select("source", "m.*")
    ok = F.col("found") == F.col("recorded")
    return last.select("source", "doc_id", F.when(ok, F.concat(F.lit("clf-v1@"), F.substring("recorded", 1, 12))).alias("model_id"), F.when(~ok, "checksum mismatch").alias("problem"))


NEWEST = """SELECT source, doc_id, CASE WHEN found = recorded THEN 'clf-v1@' || substr(recorded, 1, 12) END AS model_id, CASE WHEN found <> recorded THEN 'checksum mismatch' END AS problem
 FROM (SELECT source, doc_id, sha256(coalesce(text, '')) AS found, sha256(CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || 'x' ELSE coalesce(text, '') END) AS recorded FROM documents WHERE lang <> 'de' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1)"""


def confidence_logit(spark, sf_dir):
    """Log-odds contributions of each feature of a calibrated confidence, and its level."""
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("a"), (F.col("doc_id") % 10).alias("b"))
    ca, cb = F.col("a") * 0.4, F.col("b") * -0.15
    p = 1 / (1 + F.exp(-(ca + cb + 0.1)))
    return d.select("doc_id", F.round(ca, 6).alias("c_length"), F.round(cb, 6).alias("c_rank"), F.round(p, 6).alias("p"), F.when(p < 0.4, "LOW").when(p < 0.7, "MEDIUM").otherwise("HIGH").alias("level"))


LOGIT = "SELECT doc_id, round(a * 0.4::DOUBLE, 6) AS c_length, round(b * -0.15::DOUBLE, 6) AS c_rank, round(p, 6) AS p, CASE WHEN p < 0.4 THEN 'LOW' WHEN p < 0.7 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM (SELECT *, 1 / (1 + exp(-(a * 0.4::DOUBLE + b * -0.15::DOUBLE + 0.1::DOUBLE))) AS p FROM (SELECT doc_id, n_chars / 1000.0::DOUBLE AS a, doc_id % 10 AS b FROM documents))"

QUERIES = {
    "frame_interval": frame_interval, "haze_reference": haze_reference, "last_dry_frame": last_dry_frame, "frame_stats": frame_stats, "demo_states": demo_states, "offset_probe": offset_probe,
    "reference_bootstrap": reference_bootstrap, "shift_median": shift_median, "split_paint": split_paint, "scene_area_lookup": scene_area_lookup, "sql_predicates": sql_predicates,
    "footprint_filter": footprint_filter, "text_search": text_search, "audit_append": audit_append, "water_reference": water_reference, "outcome_counts": outcome_counts, "newest_model": newest_model,
    "confidence_logit": confidence_logit,
}
ORACLE = {
    "frame_interval": INTERVAL, "haze_reference": HAZE_REF, "last_dry_frame": DRY, "frame_stats": FRAME, "demo_states": STATES, "offset_probe": PROBE, "reference_bootstrap": BOOT, "shift_median": MEDIAN,
    "split_paint": PAINT, "scene_area_lookup": LOOKUP, "sql_predicates": PREDICATES, "footprint_filter": FOOTPRINT, "text_search": TEXT, "audit_append": APPEND, "water_reference": WATER,
    "outcome_counts": f"SELECT status, priority, count(*) AS n, round(avg(cloud), 4) AS mean_cloud FROM ({SCENES}) GROUP BY ALL", "newest_model": NEWEST, "confidence_logit": LOGIT,
}
