"""Streams over several batches, with rows that come late, against the batch results."""

import pytest
from pyspark.sql import functions as F

from geoloom.streaming import watch as S


@pytest.fixture(scope="module")
def split(spark, sf_small, tmp_path_factory):
    """The events as five files in order of time, some rows a file late (within the watermark)."""
    at = tmp_path_factory.mktemp("stream")
    e = spark.read.parquet(f"{sf_small}/events.parquet")
    first = e.agg(F.min("ts")).first()[0]
    day = F.datediff(F.col("ts"), F.lit(first))
    last = e.agg(F.max(day)).first()[0]
    part = F.least(F.floor(day * 5 / (last + 1)).cast("int"), F.lit(4))
    late = (F.col("event_id") % 10 == 0) & (F.floor((day + 1) * 5 / (last + 1)).cast("int") > part) & (part < 4)
    rows = e.withColumn("part", F.when(late, part + 1).otherwise(part)).cache()
    assert rows.where(late).count() > 0
    for i in range(5):
        rows.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(at / "events.parquet"))
    return str(at), rows


def _same(a, b):
    assert a.count() > 0 and a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


def test_several_batches(spark, split):
    at, rows = split
    day = F.col("ts").cast("date").alias("day")
    _same(S.stream_tile_stats(spark, at, 1), rows.groupBy("user_id", day).agg(F.count("*").alias("n_obs"), F.sum(F.rint(F.col("value") * 100).cast("long")).alias("cents")))
    _same(S.stream_window_counts(spark, at, 1), rows.groupBy(day, "event_type").agg(F.count("*").alias("n")))
    _same(S.stream_dedupe(spark, at, 1), rows.select(F.concat_ws(":", "event_type", "user_id").alias("dedupe_key")).distinct())
    _same(S.backfill_recompute(spark, at, 1), rows.groupBy("user_id").agg(F.count("*").alias("n_obs"), F.max("ts").alias("last_ts")))


def test_one_state_a_tile(spark, split):
    at, rows = split
    want, of = {}, {}
    for r in rows.where("event_type <> 'error'").orderBy("part", "ts", "event_id").collect():
        c, x, best = want.get(r.user_id, (0, 0, 0))
        if r.value >= 60:
            c, x = c + 1, 0
        elif r.value < 10 and c:
            x += 1
            if x == 2:
                best, c, x = 1, 0, 0
        else:
            x = 0
        want[r.user_id] = (c, x, best)
    for r in S.stream_state_machine(spark, at, 1).collect():
        assert r.user_id not in of
        of[r.user_id] = (r.confirmations, r.ended)
    assert of == {k: (c, b) for k, (c, _, b) in want.items()}


def test_states_after_several_batches(spark, split, tmp_path):
    """Late rows within the watermark change nothing; silence comes by a timer. Some tiles have few rows here, some none after the first files."""
    import duckdb

    from geoloom.plans import stream
    from geoloom.streaming import states

    _, rows = split
    thin = rows.where("(user_id % 4 <> 1 OR part < 1) AND (user_id % 4 <> 2 OR event_id % 6 = 0)").cache()
    for i in range(5):
        thin.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    names = ["user_id", "machine_state", "state", "n_after", "silent"]
    want = {tuple(r) for r in con.execute(f"SELECT {', '.join(names)} FROM ({stream.STREAM_STATES})").fetchall()}
    got = {tuple(r[c] for c in names) for r in states.stream_states(spark, str(tmp_path), 1).collect()}
    assert got == want and any(r[4] for r in got)
    assert len({r[2] for r in got} | {r[1] for r in got}) >= 7, {r[1:3] for r in got}


def test_steps_of_a_tile():
    from geoloom.streaming import states

    day = 86_400_000_000
    base = 19_723 * day  # 2024-01-01

    def run(rows, silent=False):
        s = dict(states.SETTLED)
        for at, value in rows:
            states._step(s, base + int(at * day), value, 15)
        return states.machine_state(s, silent)

    assert run([(0, 30), (1, None)]) == "NONE"
    assert run([(0, 70)]) == "TENTATIVE" and run([(0, 70)], True) == "INSUFFICIENT_DATA"
    assert run([(0, 70), (1, 70)]) == "PROVISIONAL" and run([(0, 70), (4, 70)]) == "INSUFFICIENT_DATA"
    green = [(15 + i, 70) for i in range(3)]  # day 15 stands for 225: August
    assert run(green) == "CONFIRMED" and run(green, True) == "CONFIRMED"
    assert run([*green, (18, 5), (19, 5)]) == "REVERSED" and run([*green, (18, 5), (19, 30), (20, 5)]) == "CONFIRMED"
    assert run([(0, 70), (1, 5), (2, 5)]) == "TRANSIENT" and run([(0, 5), (0, 5), (1, 70)]) == "TENTATIVE"
    assert run([(0, 70), (1, 70), (1, 5), (1, 5)]) == "TRANSIENT"
