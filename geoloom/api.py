"""The archive's methods: reads return DataFrames, changes return the table to write in place of the old one.

An Archive holds one DataFrame for each relation by name; nothing is read until a result is used.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.config import GENESIS, JOB_AFTER, JOB_PRIORITY, T
from geoloom.functions.columns import confidence_level, cosine, unit_hash
from geoloom.operators import intake, planning
from geoloom.operators.spatial import within
from geoloom.operators.timeline import first_ranked, ranked_in_buckets
from geoloom.operators.vectors import VectorIndex, build_index
from geoloom.sources import sinks

ACTIVE = ("pending", "running", "retry")
# The order of event states in review.
STATE_RANK = ["CONFIRMED", "PROVISIONAL", "TENTATIVE", "INSUFFICIENT_DATA", "REVERSED", "TRANSIENT", "SUPPRESSED", "REJECTED"]
# Guarded transitions of jobs.
LEVELS = ["LOW", "MEDIUM", "HIGH"]
JOB_MOVES = {"complete": ({"running"}, "done"), "retry": ({"failed", "cancelled"}, "pending"), "cancel": ({"pending", "retry"}, "cancelled")}


def _review_order() -> list[Column]:
    """Events by zone, state, confidence and magnitude."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATE_RANK]), F.col("machine_state"))
    return [F.col("in_zone").desc(), rank, F.col("confidence").desc(), F.col("magnitude").desc(), F.col("id")]


class Archive:
    def __init__(self, tables: Mapping[str, DataFrame]) -> None:
        self.tables = dict(tables)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    # Reads of single relations

    def scan(self, name: str, order: str | None = None, **equal) -> DataFrame:
        """Rows of a relation whose columns equal the given values; None means any."""
        conditions = [F.col(c) == v for c, v in equal.items() if v is not None]
        rows = reduce(DataFrame.where, conditions, self[name])
        return rows.orderBy(order) if order else rows

    def current_user(self, name: str) -> DataFrame:
        return self.scan("users", name=name)

    def models(self) -> DataFrame:
        return self.scan("models")

    def aois(self) -> DataFrame:
        return self.scan("aois")

    def tiles(self, aoi: str) -> DataFrame:
        return self.scan("grid_tiles", aoi_id=aoi)

    def priority_zones(self) -> DataFrame:
        return self.scan("priority_zones")

    def jobs(self) -> DataFrame:
        return self.scan("jobs", order="id")

    def exports(self) -> DataFrame:
        return self.scan("exports")

    def audit(self, limit: int = 200) -> DataFrame:
        return self["audit_log"].orderBy(F.col("seq").desc()).limit(limit)

    def provenance(self, kind: str | None = None, artifact: int | None = None) -> DataFrame:
        return self.scan("provenance", artifact_type=kind, artifact_id=artifact)

    # Joined and aggregated reads

    def observations(self, aoi: str) -> DataFrame:
        scenes = self["scenes"].select(F.col("id").alias("scene_id"), "scene_uid", "platform")
        return self["observations"].where(F.col("aoi_id") == aoi).join(scenes, "scene_id").orderBy("acquired_at")

    def system_status(self) -> DataFrame:
        counts = [self[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("relation"), "n") for n in ("scenes", "observations", "grid_tiles", "change_events") if n in self.tables]
        return reduce(DataFrame.unionByName, counts)

    def datasets(self) -> DataFrame:
        return self["scenes"].groupBy("platform", "status").agg(F.count("*").alias("n"), F.min("acquired_at").alias("first_at"), F.max("acquired_at").alias("last_at"))

    def events(self, filters: Mapping | None = None) -> DataFrame:
        """Events under the conjunction of the filters that are given."""
        f = {k: v for k, v in (filters or {}).items() if v is not None}
        ranks = F.array(*map(F.lit, STATE_RANK))
        made = {
            "aoi": lambda v: F.col("aoi_id") == v,
            "since": lambda v: F.col("first_supported") >= F.lit(v),
            "until": lambda v: F.col("first_supported") <= F.lit(v),
            "change_types": lambda v: F.col("change_type").isin(list(v)),
            "states": lambda v: F.col("machine_state").isin(list(v)),
            "min_confidence": lambda v: F.col("confidence") >= v,
            "max_distance_m": lambda v: F.col("distance_m") <= v,
            "sensor": lambda v: F.col("sensor") == v,
            "max_gsd": lambda v: F.col("gsd_m") <= v,
            "min_state": lambda v: F.array_position(ranks, F.col("machine_state")).between(1, STATE_RANK.index(v) + 1),
            "min_level": lambda v: F.array_position(F.array(*map(F.lit, LEVELS)), confidence_level(F.col("confidence"), F.col("machine_state") == "CONFIRMED")) > LEVELS.index(v),
            "reference_layer": lambda v: F.col("near_layer") == v,
        }
        if f.get("watch_set") is not None:  # members are joined, not listed
            members = self["watch_set_members"].where(F.col("watch_set_id") == f.pop("watch_set")).select("tile_id").distinct()
            return Archive({**self.tables, "change_events": self["change_events"].join(members, "tile_id", "left_semi")}).events(f)
        rows = reduce(DataFrame.where, [made[k](v) for k, v in f.items() if k in made], self["change_events"])
        hidden = [s for s, k in (("SUPPRESSED", "include_suppressed"), ("TRANSIENT", "include_transient")) if not f.get(k)]
        return rows.where(~F.col("machine_state").isin(hidden)) if hidden else rows

    def event(self, event_id: int) -> DataFrame:
        """An event with its observations, gates and history as arrays: one event's rows, a bounded group."""
        e = self["change_events"].where(F.col("id") == event_id)
        for name, order in (("event_observations", "acquired_at"), ("gate_results", "gate"), ("event_state_history", "at")):
            if name in self.tables:
                t = self[name].where(F.col("event_id") == event_id)
                body = F.struct(F.col(order), *[F.col(c) for c in t.columns if c not in (order, "event_id")])
                e = e.join(t.groupBy(F.col("event_id").alias("id")).agg(F.array_sort(F.collect_list(body)).alias(name)), "id", "left")
        return e

    def search(self, filters: Mapping | None = None) -> tuple[DataFrame, DataFrame]:
        """Events that match, and those that are suppressed, apart."""
        every = self.events({**(filters or {}), "include_suppressed": True})
        return every.where("machine_state <> 'SUPPRESSED'"), every.where("machine_state = 'SUPPRESSED'")

    def vector_index(self, model_id: str, lists: int = 256) -> VectorIndex:
        """The index of one model's vectors: those of different models are never mixed in a search."""
        rows = self["embeddings"].where(F.col("model_id") == model_id)
        return build_index(rows, lists, id_col="id")

    def nearest(self, index: VectorIndex, model_id: str, queries: DataFrame, k: int = T.fetch_k, probes: int = 16) -> DataFrame:
        """query_id, vec_id, score, rank: the k nearest indexed vectors of query vectors (id, embedding) of the same model."""
        return index.search(queries.where(F.col("model_id") == model_id), k, probes, "id")

    def ranked_search(self, filters: Mapping | None = None, positives: DataFrame | None = None, negatives: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """`search`, its matches in order: by the likeness of their tiles to examples (`score`), or without any in the order of review.

        A tile's score is that of its best vector; events without one come last. What is suppressed stays apart, unranked.
        """
        found, suppressed = self.search(filters)
        if positives is None:
            return found.orderBy(*_review_order()), suppressed
        scores = self._likeness(positives, negatives, 0.0).join(self["embeddings"].select("vec_id", "tile_id"), "vec_id")
        best = scores.groupBy(F.col("tile_id").alias("of")).agg(F.max("score").alias("score"))
        return found.join(best, F.col("tile_id") == F.col("of"), "left").drop("of").orderBy(F.col("score").desc_nulls_last(), "id"), suppressed

    def similar(self, positives: DataFrame, negatives: DataFrame | None = None, k: int = T.fetch_k, exclude_m: float = 0.0) -> DataFrame:
        """vec_id, score: rows by their likeness to the positives' mean, less `negative_lambda` times that to the negatives'.

        The examples themselves, and rows (with x, y) within `exclude_m` of a positive, are left out; the k best stay.
        """
        return self._likeness(positives, negatives, exclude_m).orderBy(F.col("score").desc(), "vec_id").limit(k)

    def _likeness(self, positives: DataFrame, negatives: DataFrame | None, exclude_m: float) -> DataFrame:
        rows = self["embeddings"]
        mean = lambda df: df.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
        like = rows.crossJoin(F.broadcast(mean(positives).withColumnRenamed("m", "pos")))  # one row
        score = cosine(F.col("embedding"), F.col("pos"))
        if negatives is not None:
            like = like.crossJoin(F.broadcast(mean(negatives).withColumnRenamed("m", "neg")))
            score = score - T.negative_lambda * F.coalesce(cosine(F.col("embedding"), F.col("neg")), F.lit(0.0))
        used = positives if negatives is None else positives.unionByName(negatives, allowMissingColumns=True)
        like = like.join(used.select("vec_id").distinct(), "vec_id", "left_anti")
        if exclude_m:
            points = rows.select(F.col("vec_id").alias("id"), "x", "y")
            near = within(points, positives.select(F.col("x").alias("ox"), F.col("y").alias("oy")), int(exclude_m)).select(F.col("id").alias("vec_id")).distinct()
            like = like.join(near, "vec_id", "left_anti")
        return like.select("vec_id", F.round(score, 6).alias("score"))

    def thresholds(self) -> dict:
        """The threshold set in force, by key."""
        return asdict(T)

    def water_reference(self, aoi: str) -> DataFrame:
        """The latest reference water body of an area: its date and geometry; no row if there is none."""
        return self["water_references"].where(F.col("aoi_id") == aoi).groupBy("aoi_id").agg(F.max_by(F.struct("date", "geometry"), "date").alias("w")).select("aoi_id", "w.*")

    def plan(self, text: str, today: dt.date, gsd_m: float = 10.0) -> dict:
        """The query plan of a text under the archive's concept registry and loaded layers."""
        layers = [r.kind for r in self["layers"].select("kind").distinct().collect()] if "layers" in self.tables else []  # a few kinds
        return planning.plan(self["concepts"].sparkSession, text, self["concepts"], today, gsd_m, layers, T.near_default_m)

    def review_queue(self) -> DataFrame:
        """Undecided events by zone, state, confidence and magnitude, with hash slices for audit and uncertainty."""
        decided = self["analyst_decisions"].select(F.col("event_id").alias("id")).distinct()
        u = unit_hash(F.lit("review"), F.col("id"))
        piece = F.when(u < T.audit_slice_fraction, "audit").when(u < T.audit_slice_fraction + T.uncertainty_slice_fraction, "uncertainty").otherwise("rank")
        return self["change_events"].join(decided, "id", "left_anti").withColumn("slice", piece).orderBy(*_review_order())

    def held_back(self, keep: int) -> DataFrame:
        return first_ranked(self["scenes"], ["aoi_id"], [F.col("acquired_at").desc(), F.col("id").desc()], keep)

    def watch_sets(self) -> DataFrame:
        hits = self["watch_set_hits"].groupBy("watch_set_id").agg(F.sum(F.col("is_new").cast("int")).alias("new_hits"))
        members = self["watch_set_members"].groupBy("watch_set_id").agg(F.count("*").alias("members"))
        sets = self["watch_sets"].withColumnRenamed("id", "watch_set_id")
        return sets.join(members, "watch_set_id", "left").join(hits, "watch_set_id", "left").fillna(0, ["members", "new_hits"])

    def rerun_watch_set(self, watch_set: int, found: DataFrame) -> DataFrame:
        """The hits of a run (tile_id, score), new where no earlier run had them."""
        before = self["watch_set_hits"].where(F.col("watch_set_id") == watch_set).select("tile_id").distinct().withColumn("__old", F.lit(True))
        return found.join(before, "tile_id", "left").select(F.lit(watch_set).alias("watch_set_id"), "tile_id", "score", F.col("__old").isNull().alias("is_new"))

    def lineage(self, event_id: int) -> DataFrame:
        """Observations and scenes behind an event, in order of time."""
        eo = self["event_observations"].where(F.col("event_id") == event_id).select("observation_id", "role")
        obs = self["observations"].select(F.col("id").alias("observation_id"), "scene_id", "acquired_at")
        scenes = self["scenes"].select(F.col("id").alias("scene_id"), "scene_uid")
        return eo.join(obs, "observation_id").join(scenes, "scene_id").orderBy("acquired_at")

    def verify_audit(self) -> DataFrame:
        """Total, first bad place, its problem, and the head of the log, which is one chain.

        Records are numbered in buckets of their sequence and meet the one before by its number: no task sees all of them.
        """
        log = self["audit_log"].withColumn("__all", F.lit(0))
        log = ranked_in_buckets(log, ["__all"], [F.floor(F.col("seq") / 65536)], [F.col("seq")], "__rank")
        before = log.select((F.col("__rank") + 1).alias("__rank"), F.col("record_hash").alias("__before"))
        rows = log.join(before, "__rank", "left")
        broken = F.col("prev_hash") != F.coalesce("__before", F.when(F.col("__rank") == 1, F.lit(GENESIS)), F.lit(""))
        problem = F.when(broken, "link").when(F.col("record_hash") != F.sha2(F.concat("prev_hash", "payload"), 256), "content")
        bad = F.min(F.when(problem.isNotNull(), F.struct(F.col("seq").alias("at"), problem.alias("what"))))
        out = rows.agg(F.count("*").alias("total"), bad.alias("bad"), F.max_by("record_hash", "seq").alias("head"))
        return out.select("total", F.col("bad.at").alias("first_bad"), F.col("bad.what").alias("problem"), "head")

    def append_audit(self, action: str, payload: Mapping) -> DataFrame:
        """The log with one more record, linked to its head (one row is read)."""
        log = self["audit_log"]
        head = log.agg(F.max("seq").alias("seq"), F.max_by("record_hash", "seq").alias("head")).first()
        body = json.dumps({"action": action, **payload}, sort_keys=True, separators=(",", ":"))
        prev = head["head"] or GENESIS
        row = log.sparkSession.range(1).select(F.lit((head["seq"] or 0) + 1).cast(log.schema["seq"].dataType).alias("seq"), F.lit(body).alias("payload"), F.lit(prev).alias("prev_hash"))
        row = row.withColumn("record_hash", F.sha2(F.concat("prev_hash", "payload"), 256))
        return log.unionByName(row, allowMissingColumns=True)

    def _needs(self, role: str, *allowed: str) -> None:
        if role not in allowed:
            raise PermissionError(f"{role} may not do this")

    # Changes: each returns the table to write

    def decide(self, decision: DataFrame, role: str = "analyst") -> tuple[DataFrame, DataFrame]:
        """Decisions with one more, and the audit log with its record; an event's analyst state is that of its latest decision, its machine state stays."""
        self._needs(role, "analyst", "admin")
        row = decision.first()
        return self["analyst_decisions"].unionByName(decision), self.append_audit("event.decided", {"decision": row["decision"], "event_id": row["event_id"], "role": role})

    def release(self, orders: DataFrame, role: str, actor: str) -> DataFrame:
        """What an administrator's orders release from quarantine (`operators.intake.release`)."""
        return intake.release(self["quarantine"], orders, role, actor)

    def analyst_states(self) -> DataFrame:
        return self["analyst_decisions"].groupBy("event_id").agg(F.max_by("decision", F.struct("created_at", "id")).alias("analyst_state"))

    def create(self, name: str, rows: DataFrame) -> DataFrame:
        """A relation (watch sets, zones) with more rows."""
        return self[name].unionByName(rows)

    def set_zone_active(self, zone: int, active: bool) -> DataFrame:
        return self["priority_zones"].withColumn("active", F.when(F.col("id") == zone, F.lit(active)).otherwise(F.col("active")))

    def enqueue(self, new: DataFrame) -> DataFrame:
        """Jobs with the new ones (id, kind, dedupe_key), but for those whose key an active job has; a null key never dedupes."""
        active = self["jobs"].where(F.col("status").isin(*ACTIVE) & F.col("dedupe_key").isNotNull()).select("dedupe_key")
        keyed = new.where("dedupe_key IS NOT NULL").join(active, "dedupe_key", "left_anti")
        keyed = first_ranked(keyed, ["dedupe_key"], [F.col("id")], 1).select(*new.columns)
        priority = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in JOB_PRIORITY.items() for x in kv]), F.col("kind")), F.lit(100))
        rows = keyed.unionByName(new.where("dedupe_key IS NULL")).withColumn("status", F.lit("pending")).withColumn("priority", priority).withColumn("attempts", F.lit(0))
        return self["jobs"].unionByName(rows, allowMissingColumns=True)

    def next_job(self, kinds: Sequence[str] | None = None) -> DataFrame:
        """The job that a worker takes next: the most urgent that waits, of the kinds if any are named."""
        waiting = self["jobs"].where(F.col("status").isin("pending", "retry"))
        return (waiting.where(F.col("kind").isin(*kinds)) if kinds else waiting).orderBy("priority", "id").limit(1)

    def claim(self, now: str, worker: str, kinds: Sequence[str] | None = None, seconds: int = 600) -> tuple[DataFrame, Row | None]:
        """Jobs after a worker has claimed the next one, and that job (none if none waits).

        Jobs that run without a sign of life for so long wait again first. The claimed job runs under the worker's name, with
        one attempt more.
        """
        own = Archive({**self.tables, "jobs": self.release_stale(now, seconds)})
        job = own.next_job(kinds).first()
        if job is None:
            return own["jobs"], None
        at = F.col("id") == job["id"]
        made = {"status": "running", "locked_by": worker, "heartbeat_at": now}
        jobs = own["jobs"].withColumn("attempts", F.when(at, F.col("attempts") + 1).otherwise(F.col("attempts")))
        for c, value in made.items():
            old = F.col(c) if c in jobs.columns else F.lit(None).cast("string")
            jobs = jobs.withColumn(c, F.when(at, F.lit(value).cast(jobs.schema[c].dataType if c in jobs.columns else "string")).otherwise(old))
        return jobs, jobs.where(at).first()

    def move_job(self, job: int, move: str) -> DataFrame:
        """Jobs after a guarded move; a job in another state stays as it is."""
        allowed, to = JOB_MOVES[move]
        able = (F.col("id") == job) & F.col("status").isin(*sorted(allowed))
        return self["jobs"].withColumn("status", F.when(able, to).otherwise(F.col("status")))

    def fail_job(self, job: int, max_attempts: int = 3) -> DataFrame:
        after = F.when(F.col("attempts") < max_attempts, "retry").otherwise("failed")
        return self["jobs"].withColumn("status", F.when(F.col("id") == job, after).otherwise(F.col("status")))

    def heartbeat(self, job: int, now: str) -> DataFrame:
        """Jobs with the time of a running job's last sign of life."""
        return self["jobs"].withColumn("heartbeat_at", F.when((F.col("id") == job) & (F.col("status") == "running"), F.lit(now)).otherwise(F.col("heartbeat_at")))

    def release_stale(self, now: str, seconds: int = 600) -> DataFrame:
        """Jobs, those that run without a sign of life for so long in retry."""
        age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("heartbeat_at").cast("timestamp"))
        return self["jobs"].withColumn("status", F.when((F.col("status") == "running") & (age > seconds), "retry").otherwise(F.col("status")))

    def run_one(self, handlers: Mapping[str, Callable], now: str, max_attempts: int = 3, kinds: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, str | None]:
        """Run the next job with its kind's handler: jobs and scenes as they are after it, and the error's text.

        Any failure is recorded; the final failure of a process_scene job marks its scene as failed.
        """
        job = self.next_job(kinds).first()
        if job is None:
            return self["jobs"], self["scenes"], None
        attempt, error, after = job["attempts"] + 1, None, "done"
        try:
            if job["kind"] not in handlers:
                raise RuntimeError(f"no handler for job kind {job['kind']}")
            handlers[job["kind"]](job.asDict())
        except Exception as e:  # a job's failure is its result
            error, after = str(e) or type(e).__name__, "retry" if attempt < max_attempts else "failed"
        own = F.col("id") == job["id"]
        jobs = self["jobs"].withColumn("status", F.when(own, after).otherwise(F.col("status"))).withColumn("attempts", F.when(own, attempt).otherwise(F.col("attempts")))
        if "heartbeat_at" in jobs.columns:
            jobs = jobs.withColumn("heartbeat_at", F.when(own, F.lit(now)).otherwise(F.col("heartbeat_at")))
        scenes = self["scenes"]
        if after == "failed" and job["kind"] == "process_scene":
            scenes = scenes.withColumn("status", F.when(F.col("id") == job["scene_id"], "failed").otherwise(F.col("status")))
        return jobs, scenes, error

    def follow_up(self, done: DataFrame) -> DataFrame:
        """New jobs (kind, dedupe_key, scene_id, observation_id, aoi_id) after finished ones, by the kinds' order.

        A scene is processed once for each area, an observation is classified and embedded once, and an area's change is
        updated once, however many finished jobs ask for it; rows without a part of the key ask for nothing.
        """
        names = ("scene_id", "observation_id", "aoi_id")
        rows = done.select("kind", *[F.col(c).cast("string").alias(c) if c in done.columns else F.lit(None).cast("string").alias(c) for c in names])
        parts = []
        for kind, steps in JOB_AFTER.items():
            for after, key, columns in steps:
                own = rows.where((F.col("kind") == kind))
                for c in columns:
                    own = own.where(F.col(c).isNotNull())
                parts.append(own.select(F.lit(after).alias("kind"), F.concat_ws(":", F.lit(key), *columns).alias("dedupe_key"), *names))
        return first_ranked(reduce(DataFrame.unionByName, parts), ["dedupe_key"], [F.col(c) for c in names], 1)

    def export_events(self, path: str, filters: Mapping | None = None) -> None:
        sinks.geojson_lines(self.events(filters), path, "x", "y", ["id", "machine_state", "change_type"])

    def latest_embeddings(self) -> DataFrame:
        """One embedding of each tile, period and model: the newest."""
        w = W.partitionBy("tile_id", "period", "model_id").orderBy(F.col("id").desc())
        return self["embeddings"].withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
