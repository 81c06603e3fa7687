"""Streaming queries over the events file, run to the end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brindle.plans.tables import read
from brindle.streaming import sightings as S


def stream_statuses(spark, d):
    stream = S.statuses(S.event_stream(spark, d, "events.parquet"))
    return S.run_to_end(stream, f"statuses_{uuid.uuid4().hex[:8]}")


def windows(spark, d):
    """Batch form of the windowed counts."""
    out = S.windowed_counts(read(spark, d, "events"), size="1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))


def stream_windows(spark, d):
    """Streaming form, in complete mode."""
    stream = S.windowed_counts(S.event_stream(spark, d, "events.parquet"), size="1 day")
    out = S.run_to_end(stream, f"windows_{uuid.uuid4().hex[:8]}", "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))


def sessions(spark, d):
    out = S.sessions(read(spark, d, "events"))
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES = {"q_stream_sightings": stream_statuses, "q_window_counts": windows, "q_stream_windows": stream_windows, "q_sessions": sessions}

_WINDOWS = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"
ORACLE_SQL = {
    "q_stream_sightings": """WITH s AS (SELECT event_id, user_id AS listing, ts, event_type,
max(CASE WHEN event_type <> 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events)
SELECT event_id, listing, CASE WHEN seen IS NULL THEN 'unknown' WHEN seen < ts - INTERVAL 3 DAYS THEN 'expired' ELSE 'unreachable' END AS status FROM s WHERE event_type = 'error'""",
    "q_window_counts": _WINDOWS,
    "q_stream_windows": _WINDOWS,
    "q_sessions": """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT user_id, sum((p IS NULL OR ts >= p + INTERVAL 6 HOURS)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l),
c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
}
