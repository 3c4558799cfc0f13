"""Event-window queries: the streaming operators applied to the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.streaming import events as E

from .base import query


@query("event_tumbling", "SELECT DATE_TRUNC('hour', ts) AS start, event_type, COUNT(*) AS n, SUM(CAST(ROUND(value * 100) AS BIGINT))::BIGINT AS total FROM events GROUP BY ALL")
def event_tumbling(p):
    return E.windowed(p.table("events"), "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("event_sliding", "SELECT DATE_TRUNC('hour', ts) - INTERVAL (k) HOUR AS start, event_type, COUNT(*) AS n, SUM(CAST(ROUND(value * 100) AS BIGINT))::BIGINT AS total FROM events, (VALUES (0), (1), (2)) s(k) GROUP BY ALL")
def event_sliding(p):
    return E.windowed(p.table("events"), "3 hours", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("event_sessions", ", g AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, SUM(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, MIN(ts) AS start, COUNT(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(p):
    return E.sessions(p.table("events"), "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("event_props", "SELECT event_type, COUNT(*) AS n, SUM(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type")
def event_props(p):
    return p.table("events").withColumn("k", F.from_json("props", "k bigint")["k"]).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"))
