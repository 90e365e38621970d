"""Queries over scenes and their intake: identity, validation, duplicates, lineage, ranking, audit and jobs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.config import GENESIS, JOB_PRIORITY
from geoloom.functions import columns as C
from geoloom.operators.chains import chain_state
from geoloom.operators.timeline import as_of, first_ranked, runs
from geoloom.sources.fixtures import SCENES, read, scenes


def offset_decision(spark, sf_dir):
    s = scenes(spark, sf_dir)
    text = F.concat(F.lpad(F.col("major").cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("scene_id") % 100).cast("string"), 2, "0"))
    text = F.when(F.col("scene_id") % 11 == 0, "n/a").otherwise(text)
    major, minor = C.baseline(text)
    applied = F.when(F.col("scene_id") % 3 == 0, F.lit(None).cast("boolean")).otherwise(F.col("scene_id") % 3 == 1)
    product = F.when(F.col("scene_id") % 13 == 0, 0).when(F.col("scene_id") % 17 == 0, -1200)
    return s.select("scene_id", text.alias("baseline"), major.alias("b_major"), minor.alias("b_minor"), C.offset_decision(major, applied, product.cast("int")).alias("decision"))


OFFSET = f"""WITH s AS (SELECT scene_id, CASE WHEN scene_id % 11 = 0 THEN 'n/a' ELSE lpad(major::VARCHAR, 2, '0') || '.' || lpad((scene_id % 100)::VARCHAR, 2, '0') END AS baseline,
 CASE WHEN scene_id % 3 = 0 THEN NULL ELSE scene_id % 3 = 1 END AS applied, CASE WHEN scene_id % 13 = 0 THEN 0 WHEN scene_id % 17 = 0 THEN -1200 END AS product FROM ({SCENES})),
 p AS (SELECT *, TRY_CAST(nullif(regexp_extract(baseline, '^\\s*(\\d+)\\.(\\d+)\\s*$', 1), '') AS INT) AS b_major, TRY_CAST(nullif(regexp_extract(baseline, '^\\s*(\\d+)\\.(\\d+)\\s*$', 2), '') AS INT) AS b_minor FROM s),
 z AS (SELECT *, coalesce(product, CASE WHEN b_major >= 4 THEN -1000 ELSE 0 END) AS size FROM p)
 SELECT scene_id, baseline, b_major, b_minor, CASE WHEN b_major IS NULL THEN 'radiometry_ambiguous' WHEN size = 0 THEN 'apply:0'
 WHEN applied IS NULL THEN 'radiometry_ambiguous' WHEN applied THEN 'apply:0' ELSE 'apply:' || size END AS decision FROM z"""


def scene_keys(spark, sf_dir):
    s = scenes(spark, sf_dir)
    platform, tile = F.lit("sentinel-2a"), F.concat(F.lit("44Q"), F.substring("priority", 3, 2))
    return s.select("scene_id", C.scene_uid(platform, F.col("acquired_at"), tile, F.col("major").cast("string"), F.lit("L2A")).alias("uid"), C.acquisition_key(platform, F.col("acquired_at")).alias("acq_key"), C.safe_name(F.col("priority")).alias("file_name"))


KEYS = f"""SELECT scene_id, 'sentinel-2a|' || strftime(acquired_at, '%Y%m%dT%H%M%S') || '|44Q' || substr(priority, 3, 2) || '|' || major || '|L2A' AS uid,
 'sentinel-2a|' || strftime(acquired_at, '%Y%m%dT%H%M') AS acq_key, substr(regexp_replace(priority, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 120) AS file_name FROM ({SCENES})"""


def validation_reasons(spark, sf_dir):
    """All rules a scene breaks, in the order of the rules; and the first policy code."""
    rules = [("cloud_cover_out_of_range", F.col("cloud") > 250000), ("baseline_missing", F.col("major") == 0), ("acquired_in_future", F.col("acquired_at") > F.to_timestamp(F.lit("1998-06-01")).cast("timestamp_ntz")), ("area_unknown", F.col("aoi") % 10 == 0), ("status_open", F.col("status") == "O")]
    reasons = F.filter(F.array(*[F.when(c, n) for n, c in rules]), lambda x: x.isNotNull())
    code = F.when(F.col("major") == 6, "sensor_unknown").when(F.size("reasons") > 0, "validation_failed").when(F.col("status") == "P", "processing_level_mismatch").otherwise("registered")
    return scenes(spark, sf_dir).withColumn("reasons", reasons).select("scene_id", F.array_join("reasons", ";").alias("reasons"), F.size("reasons").alias("n_reasons"), code.alias("code"))


REASONS = f"""WITH r AS (SELECT scene_id, major, status, list_filter([CASE WHEN cloud > 250000 THEN 'cloud_cover_out_of_range' END, CASE WHEN major = 0 THEN 'baseline_missing' END,
 CASE WHEN acquired_at > TIMESTAMP '1998-06-01' THEN 'acquired_in_future' END, CASE WHEN aoi % 10 = 0 THEN 'area_unknown' END, CASE WHEN status = 'O' THEN 'status_open' END], lambda x: x IS NOT NULL) AS rs FROM ({SCENES}))
 SELECT scene_id, array_to_string(rs, ';') AS reasons, len(rs)::INT AS n_reasons, CASE WHEN major = 6 THEN 'sensor_unknown' WHEN len(rs) > 0 THEN 'validation_failed' WHEN status = 'P' THEN 'processing_level_mismatch' ELSE 'registered' END AS code FROM r"""


def quarantine_split(spark, sf_dir):
    """What is registered and what is quarantined, by code."""
    v = validation_reasons(spark, sf_dir)
    return v.groupBy("code").agg(F.count("*").alias("n"), F.sum((F.col("code") != "registered").cast("int")).alias("quarantined"), F.min("scene_id").alias("first_scene"))


QUARANTINE = f"SELECT code, count(*) AS n, sum((code <> 'registered')::INT)::BIGINT AS quarantined, min(scene_id) AS first_scene FROM ({REASONS}) GROUP BY code"


def content_dedupe(spark, sf_dir):
    """For each distinct content hash the first document; the others are duplicates of it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("raw_sha"))
    first = docs.groupBy("raw_sha").agg(F.min("doc_id").alias("original"))
    return docs.join(first, "raw_sha").select("doc_id", "raw_sha", "original", (F.col("doc_id") != F.col("original")).alias("duplicate"))


CONTENT = "SELECT doc_id, sha256(coalesce(text, '')) AS raw_sha, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS original, doc_id <> min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS duplicate FROM documents"


def uid_dedupe(spark, sf_dir):
    """Scenes whose identity, with a null-safe area, an earlier scene has."""
    s = scenes(spark, sf_dir).select("scene_id", F.nullif(F.col("aoi") % 5, F.lit(0)).alias("area"), F.date_format("acquired_at", "yyyyMM").alias("uid"), "major")
    a, b = s.alias("a"), s.groupBy("uid", "area", "major").agg(F.min("scene_id").alias("first")).alias("b")
    same = (F.col("a.uid") == F.col("b.uid")) & F.col("a.area").eqNullSafe(F.col("b.area")) & (F.col("a.major") == F.col("b.major"))
    return a.join(b, same & (F.col("a.scene_id") > F.col("b.first"))).select("a.scene_id", "a.uid", "a.area", "b.first")


UID = f"""WITH s AS (SELECT scene_id, nullif(aoi % 5, 0) AS area, strftime(acquired_at, '%Y%m') AS uid, major FROM ({SCENES}))
 SELECT scene_id, uid, area, first FROM (SELECT *, min(scene_id) OVER (PARTITION BY uid, area, major) AS first FROM s) WHERE scene_id > first"""


def supersede(spark, sf_dir):
    """Per area and month: a scene with a higher baseline than all before it supersedes; one that is not higher is rejected."""
    s = scenes(spark, sf_dir).select("scene_id", "aoi", F.date_format("acquired_at", "yyyyMM").alias("acq"), "major")
    w = W.partitionBy("aoi", "acq").orderBy("scene_id")
    best = F.max("major").over(w.rowsBetween(W.unboundedPreceding, -1))
    action = F.when(best.isNull(), "register").when(F.col("major") > best, "supersede").otherwise("reject")
    final = F.max_by("scene_id", F.struct("major", -F.col("scene_id"))).over(W.partitionBy("aoi", "acq"))
    return s.select("scene_id", "acq", "major", action.alias("action"), (final == F.col("scene_id")).alias("current"))


SUPERSEDE = f"""WITH s AS (SELECT scene_id, aoi, strftime(acquired_at, '%Y%m') AS acq, major, max(major) OVER (PARTITION BY aoi, strftime(acquired_at, '%Y%m') ORDER BY scene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ({SCENES}))
 SELECT scene_id, acq, major, CASE WHEN best IS NULL THEN 'register' WHEN major > best THEN 'supersede' ELSE 'reject' END AS action,
 row_number() OVER (PARTITION BY aoi, acq ORDER BY major DESC, scene_id) = 1 AS current FROM s"""


def missing_tiles(spark, sf_dir):
    orders, lines = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), read(spark, sf_dir, "lineitem").select("l_orderkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


def insert_if_absent(spark, sf_dir):
    """Rows to append: new keys only, one row for each."""
    new = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_orderkey").alias("v"))
    have = read(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("k"))
    return new.join(have, "k", "left_anti")


def upsert(spark, sf_dir):
    """New values replace old ones by key, the rest stays: a full outer join, for one overwrite of the partition."""
    old = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("old"))
    new = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("new"))
    return old.join(new, "k", "full").select("k", F.coalesce("new", "old").alias("v"), F.col("new").isNotNull().alias("updated"))


UPSERT = "SELECT coalesce(c_custkey, k) AS k, coalesce(new, c_acctbal) AS v, new IS NOT NULL AS updated FROM customer FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS new FROM orders GROUP BY 1) ON k = c_custkey"


def lineage(spark, sf_dir):
    """Observations of an event with their scenes, one event being a customer's nation: counts and spans after a three-way join."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    o, c = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_nationkey").agg(F.count("*").alias("n_obs"), F.count_distinct("o_orderkey").alias("n_scenes"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), F.round(F.sum("l_quantity"), 2).alias("qty"))


LINEAGE = "SELECT c_nationkey, count(*) AS n_obs, count(DISTINCT o_orderkey) AS n_scenes, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey"


def provenance_rows(spark, sf_dir):
    """Records of every event, or of the observations and scenes in its lists, each type matched with its own list.

    An event is a customer: its observations are the customer's orders, its scenes the parts of these orders; a record
    tells of one artifact, so the rows follow the lists.
    """
    records = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("artifact"), "o_orderkey")
    sc = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("event_id")).join(orders, "o_orderkey").select("artifact", "event_id").distinct()
    names = ["artifact", "event_id", "user_id", "event_type"]
    a = records.where("event_type = 'view'").join(orders.withColumnRenamed("o_orderkey", "event_id"), "event_id").select(*names)
    b = records.where("event_type = 'click'").join(sc, "event_id").select(*names)
    of = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("artifact"))
    own = records.where("event_type = 'error'").join(of, F.col("event_id") == F.col("artifact")).select(*names)
    return a.unionByName(b).unionByName(own)


PROVENANCE = """SELECT o_custkey AS artifact, event_id, user_id, event_type FROM events JOIN orders ON event_id = o_orderkey WHERE event_type = 'view'
 UNION ALL SELECT DISTINCT o_custkey, event_id, user_id, event_type FROM events JOIN lineitem ON event_id = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE event_type = 'click'
 UNION ALL SELECT c_custkey, event_id, user_id, event_type FROM events JOIN customer ON event_id = c_custkey WHERE event_type = 'error'"""


def choose_reference(spark, sf_dir):
    """The reference scene of each area in the dry months: least cloud, then newest baseline, then latest."""
    s = scenes(spark, sf_dir).where("month(acquired_at) IN (11, 12, 1, 2, 3)").withColumn("cloud", F.when(F.col("scene_id") % 4 != 0, F.col("cloud")))
    order = [F.col("cloud").asc_nulls_last(), F.col("major").desc_nulls_first(), F.col("acquired_at").desc(), F.col("scene_id")]
    return first_ranked(s, ["aoi"], order, 1).select("aoi", "scene_id", "major", "acquired_at")


REFERENCE = f"""SELECT aoi, scene_id, major, acquired_at FROM (SELECT * REPLACE (CASE WHEN scene_id % 4 <> 0 THEN cloud END AS cloud) FROM ({SCENES}) WHERE month(acquired_at) IN (11,12,1,2,3))
 QUALIFY row_number() OVER (PARTITION BY aoi ORDER BY cloud ASC NULLS LAST, major DESC NULLS FIRST, acquired_at DESC, scene_id) = 1"""


def scene_per_date(spark, sf_dir):
    order = [F.col("major").desc(), F.col("cloud").asc(), F.col("scene_id")]
    s = scenes(spark, sf_dir).withColumn("day", F.col("acquired_at").cast("date"))
    return first_ranked(s, ["day"], order, 1).select("day", "scene_id", "major")


DATE = f"SELECT CAST(acquired_at AS DATE) AS day, scene_id, major FROM ({SCENES}) QUALIFY row_number() OVER (PARTITION BY CAST(acquired_at AS DATE) ORDER BY major DESC, cloud, scene_id) = 1"


def scene_per_bin(spark, sf_dir):
    s = scenes(spark, sf_dir).withColumn("bin", F.floor(F.datediff(F.col("acquired_at").cast("date"), F.to_date(F.lit("1992-01-01"))) / 15).cast("int"))
    return first_ranked(s, ["bin"], [F.col("cloud"), F.col("scene_id")], 1).select("bin", "scene_id", F.round("cloud", 2).alias("cloud"))


BIN = f"SELECT CAST(floor(date_diff('day', DATE '1992-01-01', CAST(acquired_at AS DATE)) / 15) AS INT) AS bin, scene_id, round(cloud, 2) AS cloud FROM ({SCENES}) QUALIFY row_number() OVER (PARTITION BY bin ORDER BY cloud, scene_id) = 1"


def holdback(spark, sf_dir):
    """The newest three scenes of each area are held back; the others are staged unless they are there already."""
    s = scenes(spark, sf_dir)
    rank = F.row_number().over(W.partitionBy("aoi").orderBy(F.col("acquired_at").desc(), F.col("scene_id").desc()))
    return s.select("aoi", "scene_id", (rank <= 3).alias("held"))


HOLD = f"SELECT aoi, scene_id, row_number() OVER (PARTITION BY aoi ORDER BY acquired_at DESC, scene_id DESC) <= 3 AS held FROM ({SCENES})"


def time_spread(spark, sf_dir):
    """At most 14 evenly spaced scenes of each area: ranks at half-even rounded steps."""
    s = scenes(spark, sf_dir)
    w = W.partitionBy("aoi")
    n, rank = F.count("*").over(w), F.row_number().over(w.orderBy("acquired_at", "scene_id")) - 1
    picks = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.rint(i * (F.col("n") - 1) / F.lit(13.0)).cast("int"))
    return s.withColumn("n", n).withColumn("rank", rank).where((F.col("n") <= 14) | F.array_contains(picks, F.col("rank"))).select("aoi", "scene_id", "rank")


SPREAD = f"""WITH s AS (SELECT aoi, scene_id, count(*) OVER (PARTITION BY aoi) AS n, (row_number() OVER (PARTITION BY aoi ORDER BY acquired_at, scene_id) - 1)::INT AS rank FROM ({SCENES}))
 SELECT aoi, scene_id, rank FROM s WHERE n <= 14 OR list_contains([round_even(i * (n - 1) / 13.0::DOUBLE, 0)::INT FOR i IN range(14)], rank)"""


def audit_verify(spark, sf_dir):
    """Each conversation is a chain of records; one in seven has a broken link. The first bad record and the records up to it."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chain"), F.col("turn").alias("seq"), F.coalesce("role", F.lit("")).alias("payload"))
    own = F.sha2(F.concat(F.lit(GENESIS), F.col("chain"), F.lit("-"), F.col("seq"), F.col("payload")), 256)
    w = W.partitionBy("chain").orderBy("seq")
    stored = F.when((F.col("chain") % 7 == 3) & (F.col("seq") == 1), F.lit("broken")).otherwise(own)
    rows = c.withColumn("record_hash", stored).withColumn("prev_hash", F.coalesce(F.lag(own, 1).over(w), F.lit(GENESIS)))
    return chain_state(rows, "chain", "seq", "prev_hash", "record_hash", own)


AUDIT = """WITH c AS (SELECT conv_id AS chain, turn AS seq, sha256(repeat('0', 64) || conv_id || '-' || turn || coalesce(role, '')) AS own FROM conversations),
 r AS (SELECT *, CASE WHEN chain % 7 = 3 AND seq = 1 THEN 'broken' ELSE own END AS record_hash, coalesce(lag(own) OVER (PARTITION BY chain ORDER BY seq), repeat('0', 64)) AS prev_hash FROM c),
 b AS (SELECT *, CASE WHEN prev_hash <> coalesce(lag(record_hash) OVER (PARTITION BY chain ORDER BY seq), repeat('0', 64)) THEN 'link' WHEN record_hash <> own THEN 'content' END AS problem FROM r)
 SELECT chain, count(*) AS total, min(seq) FILTER (WHERE problem IS NOT NULL) AS first_bad, arg_min(problem, seq) FILTER (WHERE problem IS NOT NULL) AS problem,
 max(record_hash) FILTER (WHERE seq = m) AS head FROM (SELECT *, max(seq) OVER (PARTITION BY chain) AS m FROM b) GROUP BY chain"""


def claim_order(spark, sf_dir):
    """The next pending job of each queue: priority, then id; leases that went stale are pending again."""
    s = scenes(spark, sf_dir)
    kinds = list(JOB_PRIORITY)
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("scene_id") % len(kinds) + 1).cast("int"))
    priority = F.element_at(F.create_map(*[F.lit(x) for kv in JOB_PRIORITY.items() for x in kv]), kind)
    jobs = s.select((F.col("aoi") % 20).alias("queue"), "scene_id", kind.alias("kind"), priority.alias("p"), ((F.col("status") == "O") | ((F.col("status") == "P") & (F.col("major") > 4))).alias("pending"))
    return first_ranked(jobs.where("pending"), ["queue"], [F.col("p"), F.col("scene_id")], 1).select("queue", "scene_id", "kind", "p")


_KINDS = "[" + ", ".join(f"'{k}'" for k in JOB_PRIORITY) + "]"
_PRIORITIES = "[" + ", ".join(str(v) for v in JOB_PRIORITY.values()) + "]"
CLAIM = f"""SELECT aoi % 20 AS queue, scene_id, {_KINDS}[scene_id % 8 + 1] AS kind, {_PRIORITIES}[scene_id % 8 + 1] AS p FROM ({SCENES})
 WHERE status = 'O' OR (status = 'P' AND major > 4) QUALIFY row_number() OVER (PARTITION BY queue ORDER BY p, scene_id) = 1"""


def job_transitions(spark, sf_dir):
    """Failed attempts: retry while attempts are left, else failed with an end time; counts by outcome."""
    s = scenes(spark, sf_dir)
    after = F.when(F.col("status") == "F", "done").when(F.col("major") < 3, "retry").otherwise("failed")
    ended = F.when(after != "retry", F.col("acquired_at"))
    return s.select(after.alias("outcome"), ended.alias("ended")).groupBy("outcome").agg(F.count("*").alias("n"), F.count("ended").alias("n_ended"), F.max("ended").alias("last_end"))


TRANSITIONS = f"""SELECT outcome, count(*) AS n, count(ended) AS n_ended, max(ended) AS last_end FROM (SELECT CASE WHEN status = 'F' THEN 'done' WHEN major < 3 THEN 'retry' ELSE 'failed' END AS outcome,
 CASE WHEN status = 'F' OR major >= 3 THEN acquired_at END AS ended FROM ({SCENES})) GROUP BY outcome"""


def job_summary(spark, sf_dir):
    return scenes(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


def enqueue_dedupe(spark, sf_dir):
    """One active job for each key; a null key never dedupes."""
    s = scenes(spark, sf_dir).select("scene_id", F.when(F.col("aoi") % 3 != 0, F.concat(F.lit("change:"), F.col("aoi"))).alias("dedupe_key"), "status")
    keyed = s.where("dedupe_key IS NOT NULL AND status <> 'F'").groupBy("dedupe_key").agg(F.min("scene_id").alias("scene_id"))
    return keyed.select("scene_id", "dedupe_key").unionByName(s.where("dedupe_key IS NULL").select("scene_id", "dedupe_key"))


ENQUEUE = f"""SELECT min(scene_id) AS scene_id, 'change:' || aoi AS dedupe_key FROM ({SCENES}) WHERE aoi % 3 <> 0 AND status <> 'F' GROUP BY aoi
 UNION ALL SELECT scene_id, NULL FROM ({SCENES}) WHERE aoi % 3 = 0"""


def archive_status(spark, sf_dir):
    s = scenes(spark, sf_dir)
    return s.agg(F.count("*").alias("scenes"), F.count_distinct("aoi").alias("areas"), F.min("acquired_at").alias("first_at"), F.max("acquired_at").alias("last_at"), F.sum((F.col("status") == "F").cast("int")).cast("long").alias("processed"))


STATUS = f"SELECT count(*) AS scenes, count(DISTINCT aoi) AS areas, min(acquired_at) AS first_at, max(acquired_at) AS last_at, sum((status = 'F')::INT)::BIGINT AS processed FROM ({SCENES})"


def search_filter(spark, sf_dir):
    """The conjunction of those filters that are given."""
    given = {"aoi": None, "since": "1994-01-01", "until": "1997-12-31", "statuses": ["F", "P"], "max_cloud": 200000, "min_major": 2}
    made = {"aoi": lambda v: F.col("aoi") == v, "since": lambda v: F.col("acquired_at") >= F.lit(v).cast("timestamp_ntz"), "until": lambda v: F.col("acquired_at") <= F.lit(v).cast("timestamp_ntz"), "statuses": lambda v: F.col("status").isin(v), "max_cloud": lambda v: F.col("cloud") <= v, "min_major": lambda v: F.col("major") >= v}
    out = scenes(spark, sf_dir)
    for name, value in given.items():
        out = out if value is None else out.where(made[name](value))
    return out.select("scene_id", "aoi", "acquired_at", "status")


SEARCH = f"SELECT scene_id, aoi, acquired_at, status FROM ({SCENES}) WHERE acquired_at BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1997-12-31' AND status IN ('F','P') AND cloud <= 200000 AND major >= 2"


def fileset_hash(spark, sf_dir):
    """An order-independent hash of each scene's set of files: an order's lines, which are a bounded list."""
    d = read(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit('["'), F.col("l_linenumber"), F.lit('","'), F.sha2(F.concat_ws("|", "l_partkey", "l_suppkey", "l_returnflag").cast("binary"), 256), F.lit('"]')).alias("pair"))
    return d.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sha2(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("pair")), ","), F.lit("]")), 256).alias("raw_sha256"))


FILESET = """SELECT l_orderkey, count(*) AS n, sha256('[' || string_agg(pair, ',' ORDER BY pair) || ']') AS raw_sha256 FROM (SELECT l_orderkey, '["' || l_linenumber || '","' || sha256(l_partkey || '|' || l_suppkey || '|' || l_returnflag) || '"]' AS pair FROM lineitem) GROUP BY l_orderkey"""


def sidecar_parse(spark, sf_dir):
    """Fields of a page's metadata by patterns: declared language, title length, links, per-tag counts."""
    p = read(spark, sf_dir, "pages").select("page_id", "html")
    return p.select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), F.length(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("title_len"), F.size(F.regexp_extract_all("html", F.lit("<p[ >]"), F.lit(0))).alias("paragraphs"), F.regexp_count("html", F.lit("<a ")).alias("links"))


SIDECAR = """SELECT page_id, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, length(regexp_extract(html, '(?s)<title>(.*?)</title>', 1))::INT AS title_len,
 len(regexp_extract_all(html, '<p[ >]'))::INT AS paragraphs, len(regexp_extract_all(html, '<a '))::INT AS links FROM pages"""


def geojson_export(spark, sf_dir):
    """One GeoJSON feature a row, with whole-number coordinates."""
    c = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 7919 % 100000).alias("x"), (F.col("c_custkey") * 104729 % 100000).alias("y"), "c_mktsegment")
    feature = F.concat(F.lit('{"type":"Feature","id":'), F.col("c_custkey"), F.lit(',"geometry":{"type":"Point","coordinates":['), F.col("x"), F.lit(","), F.col("y"), F.lit(']},"properties":'), F.to_json(F.struct("c_mktsegment")), F.lit("}"))
    return c.select("c_custkey", feature.alias("feature"))


GEOJSON = """SELECT c_custkey, '{"type":"Feature","id":' || c_custkey || ',"geometry":{"type":"Point","coordinates":[' || (c_custkey * 7919 % 100000) || ',' || (c_custkey * 104729 % 100000) || ']},"properties":{"c_mktsegment":"' || c_mktsegment || '"}}' AS feature FROM customer"""


def as_of_clean(spark, sf_dir):
    """For each purchase the latest view of the same tile strictly before it."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select(F.col("event_id").alias("prior_id"), "user_id", "ts")
    return as_of(left, right, ["user_id"], "ts", ["prior_id"]).select("event_id", "user_id", "prior_id")


ASOF = """SELECT l.event_id, l.user_id, r.event_id AS prior_id FROM (SELECT * FROM events WHERE event_type = 'purchase') l
 ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts > r.ts"""


def contradict_runs(spark, sf_dir):
    """Runs of one role in each tile's time order, with their lengths; runs of two or more errors reverse an event."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    out = runs(e, ["user_id"], ["ts", "event_id"], "event_type")
    return out.groupBy("user_id", "event_type", "run").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.min("ts").alias("begin_ts")).select("user_id", "event_type", "n", "first_id", "begin_ts", ((F.col("event_type") == "error") & (F.col("n") >= 2)).alias("reverses"))


RUNS = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS run FROM events)
 SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id, min(ts) AS begin_ts, event_type = 'error' AND count(*) >= 2 AS reverses FROM r GROUP BY user_id, event_type, run"""

QUERIES = {
    "offset_decision": offset_decision, "scene_keys": scene_keys, "validation_reasons": validation_reasons, "quarantine_split": quarantine_split, "content_dedupe": content_dedupe,
    "uid_dedupe_nullsafe": uid_dedupe, "supersede_baseline": supersede, "missing_tiles": missing_tiles, "insert_if_absent": insert_if_absent, "upsert": upsert, "lineage": lineage,
    "provenance_rows": provenance_rows, "choose_reference": choose_reference, "scene_per_date": scene_per_date, "scene_per_bin": scene_per_bin, "holdback": holdback, "time_spread": time_spread,
    "audit_verify": audit_verify, "claim_order": claim_order, "job_transitions": job_transitions, "job_summary": job_summary, "enqueue_dedupe": enqueue_dedupe, "archive_status": archive_status,
    "search_filter": search_filter, "fileset_hash": fileset_hash, "sidecar_parse": sidecar_parse, "geojson_export": geojson_export, "asof_last_clean_pre": as_of_clean, "contradict_runs": contradict_runs,
}
ORACLE = {
    "offset_decision": OFFSET, "scene_keys": KEYS, "validation_reasons": REASONS, "quarantine_split": QUARANTINE, "content_dedupe": CONTENT, "uid_dedupe_nullsafe": UID, "supersede_baseline": SUPERSEDE,
    "missing_tiles": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "insert_if_absent": "SELECT l_partkey AS k, min(l_orderkey) AS v FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY l_partkey",
    "upsert": UPSERT, "lineage": LINEAGE, "provenance_rows": PROVENANCE, "choose_reference": REFERENCE, "scene_per_date": DATE, "scene_per_bin": BIN, "holdback": HOLD, "time_spread": SPREAD,
    "audit_verify": AUDIT, "claim_order": CLAIM, "job_transitions": TRANSITIONS, "job_summary": f"SELECT status, count(*) AS n FROM ({SCENES}) GROUP BY status", "enqueue_dedupe": ENQUEUE,
    "archive_status": STATUS, "search_filter": SEARCH, "fileset_hash": FILESET, "sidecar_parse": SIDECAR, "geojson_export": GEOJSON, "asof_last_clean_pre": ASOF, "contradict_runs": RUNS,
}
