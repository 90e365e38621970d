"""Streaming queries: each drains its folder; the SQL is the batch result it must equal."""

from __future__ import annotations

from geoloom.plans.change import STATE
from geoloom.streaming import states
from geoloom.streaming import watch as S

#: The batch states; a tile without a usable row for the set's days before the last watermark (two days before the last row) is silent.
STREAM_STATES = f"""WITH b AS ({STATE}), l AS (SELECT user_id, epoch_ms(max(ts)) + 345600000 < (SELECT epoch_ms(max(ts)) - 172800000 FROM events WHERE event_type <> 'error') AS silent FROM events WHERE event_type <> 'error' GROUP BY user_id),
 j AS (SELECT b.user_id, CASE WHEN silent AND machine_state IN ('PROVISIONAL', 'TENTATIVE') THEN 'INSUFFICIENT_DATA' ELSE machine_state END AS machine_state, n_after, silent FROM b JOIN l ON l.user_id = b.user_id)
 SELECT user_id, machine_state, CASE WHEN machine_state = 'NONE' THEN 'NONE' WHEN user_id % 13 = 0 THEN 'REJECTED' WHEN user_id % 10 = 0 THEN 'SUPPRESSED' ELSE machine_state END AS state, n_after, silent FROM j"""

QUERIES = {
    "stream_tile_stats": S.stream_tile_stats,
    "stream_window_counts": S.stream_window_counts,
    "stream_dedupe": S.stream_dedupe,
    "stream_state_machine": S.stream_state_machine,
    "backfill_recompute": S.backfill_recompute,
    "stream_states": states.stream_states,
}
ORACLE = {
    "stream_tile_stats": "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_obs, sum(CAST(round_even(value * 100, 0) AS BIGINT))::BIGINT AS cents FROM events GROUP BY ALL",
    "stream_window_counts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_dedupe": "SELECT DISTINCT event_type || ':' || user_id AS dedupe_key FROM events",
    "backfill_recompute": "SELECT user_id, count(*) AS n_obs, max(ts) AS last_ts FROM events GROUP BY user_id",
    "stream_states": STREAM_STATES,
}
