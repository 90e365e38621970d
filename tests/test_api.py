"""The archive's methods on small relations."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from geoloom.api import Archive
from geoloom.config import GENESIS


@pytest.fixture(scope="module")
def archive(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    one = sha(GENESIS + "{}")
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    return Archive({
        "scenes": t([(1, "u1", "s2a", "a", "processed", "2024-01-01"), (2, "u2", "s2b", "a", "processed", "2024-02-01"), (3, "u3", "s2a", "b", "registered", "2024-03-01")], "id int, scene_uid string, platform string, aoi_id string, status string, acquired_at string"),
        "observations": t([(10, 1, "a", "2024-01-01"), (11, 2, "a", "2024-02-01")], "id int, scene_id int, aoi_id string, acquired_at string"),
        "grid_tiles": t([("t1", "a")], "tile_id string, aoi_id string"),
        "change_events": t([(1, "a", "construction", "CONFIRMED", 0.9, "2024-01-05", 3.0, True, 10.0, 1.0, 2.0), (2, "a", "clearance", "SUPPRESSED", 0.2, "2024-02-05", 1.0, False, 10.0, 1.0, 2.0), (3, "b", "clearance", "TENTATIVE", 0.5, "2024-03-05", 2.0, False, 900.0, 5.0, 6.0)], "id int, aoi_id string, change_type string, machine_state string, confidence double, first_supported string, magnitude double, in_zone boolean, distance_m double, x double, y double"),
        "event_observations": t([(1, 10, "pre", "2024-01-01"), (1, 11, "post", "2024-02-01")], "event_id int, observation_id int, role string, acquired_at string"),
        "gate_results": t([(1, "G1", "pass")], "event_id int, gate string, outcome string"),
        "analyst_decisions": t([(1, 3, "confirm", "2024-03-06"), (2, 3, "reject", "2024-03-07")], "id int, event_id int, decision string, created_at string"),
        "watch_sets": t([(1, "w")], "id int, name string"),
        "watch_set_members": t([(1, "t1")], "watch_set_id int, tile_id string"),
        "watch_set_hits": t([(1, "t9", 0.9, True)], "watch_set_id int, tile_id string, score double, is_new boolean"),
        "priority_zones": t([(1, True), (2, True)], "id int, active boolean"),
        "provenance": t([(1, "event", 1), (2, "scene", 1)], "id int, artifact_type string, artifact_id int"),
        "audit_log": t([(1, "{}", GENESIS, one), (2, "{}", one, sha(one + "{}"))], "seq int, payload string, prev_hash string, record_hash string"),
        "jobs": t([(1, "embed", "pending", 60, "k1", 0), (2, "classify", "pending", 50, "k2", 3), (3, "embed", "done", 60, "k3", 0)], "id int, kind string, status string, priority int, dedupe_key string, attempts int"),
    })


def test_reads(archive):
    assert [r.scene_uid for r in archive.observations("a").collect()] == ["u1", "u2"]
    assert {r.relation: r.n for r in archive.system_status().collect()} == {"scenes": 3, "observations": 2, "grid_tiles": 1, "change_events": 3}
    assert archive.tiles("a").count() == 1 and archive.provenance("event").count() == 1 and archive.provenance().count() == 2
    assert [r.seq for r in archive.audit(1).collect()] == [2] and archive.verify_audit().first().first_bad is None
    assert {r.id for r in archive.held_back(1).collect()} == {2, 3}


def test_events(archive):
    assert {r.id for r in archive.events().collect()} == {1, 3}
    assert [r.id for r in archive.events({"min_confidence": 0.8, "aoi": "a", "max_distance_m": None}).collect()] == [1]
    found, hidden = archive.search({"change_types": ["clearance"]})
    assert [r.id for r in found.collect()] == [3] and [r.id for r in hidden.collect()] == [2]
    e = archive.event(1).first()
    assert [o.observation_id for o in e.event_observations] == [10, 11] and e.gate_results[0].outcome == "pass"
    assert [r.scene_uid for r in archive.lineage(1).collect()] == ["u1", "u2"]
    assert [r.id for r in archive.review_queue().collect()] == [1, 2]
    assert archive.analyst_states().first().analyst_state == "reject"


def test_changes(archive, spark, tmp_path):
    new = spark.createDataFrame([(9, "embed", "k1"), (10, "cluster", "k9"), (11, "other", None), (12, "cluster", "k9")], "id int, kind string, dedupe_key string")
    jobs = archive.enqueue(new)
    assert {(r.id, r.priority) for r in jobs.where("id > 8").collect()} == {(10, 120), (11, 100)}
    assert archive.next_job().first().id == 2
    status = lambda df, i: df.where(F.col("id") == i).first().status
    assert status(archive.move_job(1, "cancel"), 1) == "cancelled" and status(archive.move_job(3, "cancel"), 3) == "done"
    assert status(archive.fail_job(1), 1) == "retry" and status(archive.fail_job(2), 2) == "failed"
    assert [r.active for r in archive.set_zone_active(2, False).orderBy("id").collect()] == [True, False]
    hits = archive.rerun_watch_set(1, spark.createDataFrame([("t9", 0.8), ("t8", 0.7)], "tile_id string, score double"))
    assert {r.tile_id: r.is_new for r in hits.collect()} == {"t9": False, "t8": True}
    assert archive.watch_sets().first().new_hits == 1
    archive.export_events(str(tmp_path / "e"))
    assert {json.loads(r.value)["properties"]["id"] for r in spark.read.text(str(tmp_path / "e")).collect()} == {1, 3}


def test_broken_logs(archive, spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows, prev = [], GENESIS
    for i in (1, 2, 5, 70000, 70001, 200000):  # numbers may be left out
        rows.append((i, f"{{{i}}}", prev, sha(prev + f"{{{i}}}")))
        prev = rows[-1][3]
    state = lambda r: tuple(Archive({"audit_log": spark.createDataFrame(r, "seq int, payload string, prev_hash string, record_hash string")}).verify_audit().first())
    assert state(rows) == (6, None, None, prev)
    assert state(rows[:2] + rows[3:])[1:3] == (70000, "link")
    assert state([*rows[:3], (70000, "changed", *rows[3][2:]), *rows[4:]])[1:3] == (70000, "content")
    log = Archive({"audit_log": spark.createDataFrame(rows, "seq int, payload string, prev_hash string, record_hash string")}).append_audit("x", {"b": 1, "a": "é"})
    assert Archive({"audit_log": log}).verify_audit().first().total == 7 and state(list(map(tuple, log.collect())))[1] is None


def test_roles_and_decisions(archive, spark):
    one = spark.createDataFrame([(3, 1, "confirm", "2024-04-01")], "id int, event_id int, decision string, created_at string")
    with pytest.raises(PermissionError):
        archive.decide(one, "guest")
    decisions, log = archive.decide(one)
    assert decisions.count() == 3 and json.loads(log.orderBy(F.col("seq").desc()).first().payload) == {"action": "event.decided", "decision": "confirm", "event_id": 1, "role": "analyst"}
    q = spark.createDataFrame([(1, "x", "radiometry_ambiguous", False), (2, "y", "outside_aoi", True)], "id int, original_name string, reason_code string, released boolean")
    orders = spark.createDataFrame([(1, "seen", "{}"), (2, "seen", "{}"), (9, "seen", "{}")], "id int, reason string, overrides string")
    held = Archive({"quarantine": q})
    with pytest.raises(PermissionError):
        held.release(orders, "analyst", "me")
    assert [r.original_name for r in held.release(orders, "admin", "me").collect()] == ["x"]


def test_jobs(archive, spark):
    jobs = spark.createDataFrame([(1, "process_scene", "pending", 40, None, 2, "2024-01-01 00:00:00", 7), (2, "embed", "running", 60, None, 0, "2024-01-01 00:00:00", 7)], "id int, kind string, status string, priority int, dedupe_key string, attempts int, heartbeat_at string, scene_id int")
    a = Archive({"jobs": jobs, "scenes": spark.createDataFrame([(7, "registered")], "id int, status string")})

    def bad(job):
        raise ValueError("no raster")

    after, scenes, error = a.run_one({"process_scene": bad}, "2024-01-01 01:00:00")
    assert error == "no raster" and scenes.first().status == "failed" and after.where("id = 1").first().status == "failed"
    after, scenes, error = a.run_one({"process_scene": dict}, "2024-01-01 01:00:00")
    assert error is None and after.where("id = 1").first().status == "done" and scenes.first().status == "registered"
    assert a.heartbeat(2, "2024-01-02 00:00:00").where("id = 2").first().heartbeat_at == "2024-01-02 00:00:00"
    assert a.release_stale("2024-01-01 00:05:00").where("id = 2").first().status == "running" and a.release_stale("2024-01-01 00:11:00").where("id = 2").first().status == "retry"
    job, claimed = a.claim("2024-01-01 00:11:00", "me")
    assert (claimed.id, claimed.status, claimed.attempts, claimed.locked_by) == (1, "running", 3, "me")
    assert {r.id: r.status for r in job.collect()} == {1: "running", 2: "retry"}
    assert a.claim("2024-01-01 00:11:00", "me", ["embed"])[1].id == 2 and a.claim("2024-01-01 00:01:00", "me", ["embed"])[1] is None


def test_jobs_that_follow(archive, spark):
    """Embedding and the area's change follow the classification of an observation, which follows its processing."""
    done = spark.createDataFrame([("process_scene", 7, 70, "a"), ("process_scene", 8, 80, "a"), ("classify_observation", 7, 70, "a"), ("classify_observation", 8, 80, "a"), ("classify_observation", 8, 80, "a"), ("ingest_scan", 9, None, "b"), ("ingest_scan", None, None, "b"), ("embed_observation", 7, 70, "a")], "kind string, scene_id int, observation_id int, aoi_id string")
    got = sorted((r.kind, r.dedupe_key) for r in archive.follow_up(done).collect())
    assert got == [("change_update", "change:a"), ("classify_observation", "classify:70"), ("classify_observation", "classify:80"), ("embed_observation", "embed:70"), ("embed_observation", "embed:80"), ("process_scene", "process:9:b")]


def test_filters_similar_and_water(archive, spark):
    e = archive["change_events"].withColumns({"sensor": F.lit("s2"), "gsd_m": F.lit(10.0), "near_layer": F.when(F.col("id") == 3, "road"), "tile_id": F.concat(F.lit("t"), "id")})
    a = Archive({**archive.tables, "change_events": e})
    ids = lambda f: {r.id for r in a.events(f).collect()}
    assert ids({"min_state": "PROVISIONAL"}) == {1} and ids({"min_level": "MEDIUM"}) == {1, 3} and ids({"min_level": "HIGH"}) == {1}
    assert ids({"reference_layer": "road", "sensor": "s2", "max_gsd": 10}) == {3} and ids({"watch_set": 1}) == {1} and ids({"max_gsd": 5}) == set()
    v = spark.createDataFrame([(1, [1.0, 0.0], 0, 0), (2, [0.9, 0.1], 5000, 0), (3, [0.0, 1.0], 9000, 0), (4, [0.8, 0.2], 100, 0)], "vec_id int, embedding array<double>, x int, y int")
    b = Archive({"embeddings": v, "water_references": spark.createDataFrame([("a", "2024-01-01", "g1"), ("a", "2024-02-01", "g2")], "aoi_id string, date string, geometry string")})
    assert [r.vec_id for r in b.similar(v.where("vec_id = 1")).collect()] == [2, 4, 3]
    assert [r.vec_id for r in b.similar(v.where("vec_id = 1"), v.where("vec_id = 3"), exclude_m=1500).collect()] == [2]
    assert b.water_reference("a").first().geometry == "g2" and b.water_reference("z").count() == 0 and b.thresholds()["near_default_m"] == 500


def test_ranked_search_and_the_index_of_a_model(archive, spark):
    found, suppressed = archive.ranked_search()
    assert [r.id for r in found.collect()] == [1, 3] and [r.id for r in suppressed.collect()] == [2]
    e = archive["change_events"].withColumn("tile_id", F.concat(F.lit("t"), "id"))
    v = spark.createDataFrame([(1, 1, "t1", [0.1, 1.0], "m"), (2, 2, "t3", [1.0, 0.1], "m"), (3, 3, "t3", [0.0, 1.0], "m"), (4, 4, "t9", [1.0, 0.0], "m"), (5, 5, "t9", [1.0, 0.0], "other")], "id int, vec_id int, tile_id string, embedding array<double>, model_id string")
    a = Archive({**archive.tables, "change_events": e, "embeddings": v})
    found, _ = a.ranked_search(None, v.where("id = 4"))
    assert [(r.id, r.score) for r in found.collect()] == [(3, 0.995037), (1, 0.099504)]
    index = a.vector_index("m", 2)
    near = a.nearest(index, "m", v.where("id = 4"), 2, 2).orderBy("rank").collect()
    assert [r.vec_id for r in near] == [2, 1]  # the same vector of another model is not met


def test_worker_needs_handlers(spark, tmp_path):
    from geoloom import cli

    root = str(tmp_path)
    cli.main(["--root", root, "db-init"], spark)
    jobs = spark.createDataFrame([(1, "cluster", "pending", 120, None, 0, None, None, None, None, None), (2, "strange", "pending", 10, None, 0, None, None, None, None, None)], cli.RELATIONS["jobs"])
    cli.replace(jobs, root, "jobs")
    assert cli.main(["--root", root, "worker"], spark) == 1
    status = lambda: {r.id: r.status for r in cli.archive(spark, root)["jobs"].collect()}
    assert status() == {1: "pending", 2: "pending"}
    assert cli.main(["--root", root, "worker", "--handlers", "test_api:HANDLERS", "--max-jobs", "5"], spark) == 0
    assert status() == {1: "done", 2: "pending"}


HANDLERS = {"cluster": lambda job: None}
