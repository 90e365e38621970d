"""Every query with SQL is held against DuckDB; the others against their own invariants."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import oracle  # noqa: E402

from geoloom.plans import registry  # noqa: E402

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_duckdb(spark, sf_small, name):
    oracle.compare(spark, QUERIES[name], ORACLE[name], sf_small)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_phase_shift_finds_nothing_to_move(spark, sf_small):
    rows = QUERIES["phase_shift"](spark, "/root/testdata/sf0.01").collect()
    first = next(r for r in rows if r.obs == 1)
    assert (first.dy, first.dx) == (0, 0) and all(r.status in ("ok", "corrected", "unusable", "suspect") for r in rows)


def test_models_and_diversity(spark, sf_small):
    clusters = QUERIES["kmeans_gallery"](spark, sf_small).collect()
    assert {r.cluster for r in clusters} <= set(range(6)) and all(r.distance >= 0 for r in clusters)
    judged = QUERIES["rf_train_predict"](spark, sf_small).collect()
    assert sum(r.label == r.predicted for r in judged) > len(judged) / 3
    places = QUERIES["mmr_rank"](spark, sf_small).collect()
    by = {}
    for r in places:
        by.setdefault(r.query_id, []).append(r.place)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values())


def test_state_machine_in_a_stream(spark, sf_small):
    want = {}
    rows = spark.read.parquet(f"{sf_small}/events.parquet").where("event_type <> 'error'").orderBy("ts", "event_id").collect()
    for r in rows:
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
    got = {r.user_id: (r.confirmations, r.ended) for r in QUERIES["stream_state_machine"](spark, sf_small).collect()}
    assert got == {k: (c, b) for k, (c, _, b) in want.items()}
