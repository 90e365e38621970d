"""The eight event states as a stream: rows settle in order of time behind the watermark, and a timer tells of silence.

Rows that the watermark has not passed wait in a tile's state, a bounded time's worth of them, and are read in order of time
each time the tile is judged; so late rows within the watermark change nothing. A tile that has no usable row for the set's
days becomes INSUFFICIENT_DATA by an event-time timer, without a row arriving.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from geoloom.config import T
from geoloom.streaming.watch import LATE, drain, watch

DAY_MS = 86_400_000
SETTLED = {"first_at": None, "first_d": None, "last_d": None, "prev_d": None, "prev_pre": False, "n_after": 0, "green": False, "gap": -1, "ended": False, "at": None, "before": None}


def _step(s: dict, ts: int, value: float | None, stretch: int) -> None:
    """One usable row of a tile, in order of time (microseconds)."""
    day = (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=ts)).date()
    d = (day - dt.date(2024, 1, 1)).days * stretch
    post, pre = value is not None and value >= 60, value is not None and value < 10
    if ts != s["at"]:  # what stood before this moment: an end takes back what shares its time
        s["at"], s["before"] = ts, [s["n_after"], s["last_d"], s["green"]]
    after = s["first_at"] is not None and ts > s["first_at"]
    if after and s["prev_d"] is not None:
        s["gap"] = max(s["gap"], d - s["prev_d"])
    if post and s["first_at"] is None:
        s["first_at"], s["first_d"] = ts, d
    elif post and after and not s["ended"]:
        green = (dt.date(2024, 1, 1) + dt.timedelta(days=d)).month in T.green_season_months
        s["n_after"], s["last_d"], s["green"] = s["n_after"] + 1, d, s["green"] or green
    if pre and s["prev_pre"] and after and not s["ended"]:
        s["ended"] = True
        s["n_after"], s["last_d"], s["green"] = s["before"]
    s["prev_d"], s["prev_pre"] = d, pre


def machine_state(s: dict, silent: bool) -> str:
    confirmed = s["n_after"] >= T.confirmed_confirming_obs and s["last_d"] - s["first_d"] >= T.confirmed_min_span_days and s["green"]
    if s["first_at"] is None:
        return "NONE"
    if s["ended"]:
        return "REVERSED" if confirmed else "TRANSIENT"
    if confirmed:
        return "CONFIRMED"
    if silent or s["gap"] >= T.insufficient_data_days:
        return "INSUFFICIENT_DATA"
    return "PROVISIONAL" if s["n_after"] >= T.provisional_confirming_obs else "TENTATIVE"


def _judge(stretch: int):
    quiet = T.insufficient_data_days * DAY_MS // stretch

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        settled, waiting, last = json.loads(state.get[0]) if state.exists else (dict(SETTLED), [], None)
        for f in frames:
            for ts, event, value in zip(f["ts_us"], f["event_id"], f["value"], strict=True):
                waiting.append([int(ts), int(event), None if pd.isna(value) else float(value)])
        waiting.sort(key=lambda r: r[:2])
        line = state.getCurrentWatermarkMs() * 1000
        done = [r for r in waiting if r[0] < line]
        for ts, _, value in done:
            _step(settled, ts, value, stretch)
        waiting = waiting[len(done) :]
        now = json.loads(json.dumps(settled))
        for ts, _, value in waiting:
            _step(now, ts, value, stretch)
        last = max([x for x in (last, *(r[0] for r in done), *(r[0] for r in waiting)) if x is not None])
        silent = last // 1000 + quiet < state.getCurrentWatermarkMs()
        state.update((json.dumps([settled, waiting, last]),))
        if not silent:
            state.setTimeoutTimestamp(max(last // 1000 + quiet, state.getCurrentWatermarkMs() + 1))
        judged = machine_state(now, silent)
        shown = judged if judged == "NONE" else "REJECTED" if key[0] % 13 == 0 else "SUPPRESSED" if key[0] % 10 == 0 else judged
        yield pd.DataFrame({"user_id": [key[0]], "machine_state": [judged], "state": [shown], "n_after": [now["n_after"]], "silent": [silent]})

    return run


def stream_states(spark: SparkSession, sf_dir: str, per_trigger: int = 8, stretch: int = 15) -> DataFrame:
    """State of each tile's event after all rows that arrived, by the rules of `plans.change.state_machine`, and whether the tile has
    fallen silent as of the watermark. A failed gate (every tenth tile) and a rejection (every thirteenth) show beside it.

    stretch: the days that a day of the events stands for.
    """
    e = watch(spark, sf_dir, per_trigger=per_trigger).where("event_type <> 'error' AND user_id IS NOT NULL AND ts IS NOT NULL")
    rows = e.select("user_id", "event_id", "value", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", LATE)
    rows = rows.select("user_id", "event_id", "value", "at", F.unix_micros("at").alias("ts_us"))
    out = "user_id long, machine_state string, state string, n_after long, silent boolean"
    return drain(rows.groupBy("user_id").applyInPandasWithState(_judge(stretch), out, "kept string", "update", GroupStateTimeout.EventTimeTimeout), ["user_id"])
