"""Queries of event-time streams over the events table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace.streaming.refresh import awaited_once, counts_once


def q66_awaited_results(spark, sf_dir):
    """Sign-ups that wait ten days for a user's purchases, as a join of two streams; rows without a purchase have run out."""
    found = awaited_once(spark, f"{sf_dir}/events.parquet")
    return found.select("fixture", "team", F.date_format("day", "yyyy-MM-dd HH:mm:ss").alias("day"), "report", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "score")


def q67_windowed_counts(spark, sf_dir):
    """Weeks of events that the watermark has passed, by type."""
    found = counts_once(spark, f"{sf_dir}/events.parquet")
    return found.select(F.date_format("window.start", "yyyy-MM-dd").alias("week"), "event_type", "n", F.round("total", 2).alias("total"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] == "q" and n[1:3].isdigit()}

ORACLES = {
    "q66_awaited_results": """WITH f AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), r AS (SELECT * FROM events WHERE event_type = 'purchase'),
    w AS (SELECT date_trunc('milliseconds', least((SELECT max(ts) FROM f), (SELECT max(ts) FROM r))) - INTERVAL 2 DAY AS mark)
    SELECT f.event_id AS fixture, f.user_id AS team, strftime(f.ts, '%Y-%m-%d %H:%M:%S') AS day, r.event_id AS report, strftime(r.ts, '%Y-%m-%d %H:%M:%S') AS at, value AS score
    FROM f LEFT JOIN r ON r.user_id = f.user_id AND r.ts >= f.ts AND r.ts <= f.ts + INTERVAL 10 DAY, w WHERE r.event_id IS NOT NULL OR f.ts + INTERVAL 10 DAY < mark""",
    "q67_windowed_counts": """WITH e AS (SELECT *, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS start FROM events)
    SELECT strftime(start, '%Y-%m-%d') AS week, event_type, count(*) AS n, round(sum(value), 2) AS total FROM e
    WHERE start + INTERVAL 7 DAY <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 DAY FROM events) GROUP BY start, event_type""",
}
