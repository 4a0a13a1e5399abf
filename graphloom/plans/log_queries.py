"""Queries over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events
from ..sources import bridge
from .registry import query

NOW = "2024-01-30 12:00:00"


@query("SELECT event_id, ts AS at, user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-23 12:00:00'")
def timeline_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the last seven days, to the second."""
    log = bridge.log(spark, sf_dir)
    return events.timeline(log, kind="error", since_=events.since("7d", NOW)).select("event_id", "at", "user_id")


@query("SELECT event_id, event_type AS kind FROM events WHERE ts >= TIMESTAMP '2024-01-15' ORDER BY ts DESC, event_id LIMIT 50")
def timeline_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty latest events since a date."""
    return events.timeline(bridge.log(spark, sf_dir), since_=events.since("2024-01-15", NOW), limit=50).select("event_id", "kind")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 20")
def events_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty in file order."""
    return events.last_n(bridge.log(spark, sf_dir), 20, "event_id").select("event_id")


@query(
    """WITH d AS (SELECT unnest(generate_series(DATE '2024-01-24', DATE '2024-01-30', INTERVAL 1 DAY))::DATE AS day),
    c AS (SELECT day, count(event_id) AS n FROM d LEFT JOIN events ON ts::DATE = day GROUP BY day)
    SELECT day, n, substr('▁▂▃▄▅▆▇█', ceil(n / greatest(max(n) OVER (), 1) * 7)::INT + 1, 1) AS bar FROM c"""
)
def activity_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last seven days with bars."""
    return events.activity(bridge.log(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query(
    """WITH u AS (SELECT user_id AS key, max(ts) AS t FROM events WHERE event_type = 'signup' GROUP BY user_id),
    a AS (SELECT key, floor(epoch(TIMESTAMP '2024-01-30 12:00:00' - t) / 86400)::BIGINT AS d FROM u)
    SELECT key, CASE WHEN d >= 0 THEN d END AS age_days, coalesce(d >= 0 AND d > 3, false) AS stale FROM a"""
)
def heartbeat_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose last sign-up is older than three days, strictly."""
    last = bridge.log(spark, sf_dir).filter("kind = 'signup'").groupBy(F.col("user_id").alias("key")).agg(F.max("at").alias("last_updated"))
    return events.heartbeat(last, F.lit(NOW).cast("timestamp_ntz"), 3)


@query(
    """SELECT event_id::VARCHAR AS message, event_type AS kind, '.' AS cwd, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS n_files
    FROM events WHERE event_type IN ('click', 'error') AND event_id % 7 <> 0"""
)
def json_log_permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as JSON lines, one in seven broken, read permissively (S04): other kinds and broken lines are skipped."""
    log = bridge.log(spark, sf_dir)
    files = F.when(F.col("event_id") % 5 == 0, F.lit('["a.md", 1]')).otherwise(F.lit("[]"))
    line = F.concat(F.lit('{"timestamp": "'), F.col("at").cast("string"), F.lit('", "kind": "'), "kind", F.lit('", "message": "'), F.col("event_id").cast("string"), F.lit('", "files": '), files, F.lit("}"))
    lines = log.select(F.when(F.col("event_id") % 7 == 0, F.substring(line, F.lit(1), F.length(line) - 9)).otherwise(line).alias("value"))
    return events.parse_log(lines, ("click", "error")).select("message", "kind", "cwd", F.size("files").alias("n_files"))


@query("SELECT event_type AS kind, round(avg(value), 6) AS mean, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type ORDER BY n DESC")
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind: mean value, number, sum of a JSON field."""
    k = F.get_json_object("props", "$.k").cast("long")
    return bridge.log(spark, sf_dir).groupBy("kind").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"), F.sum(k).alias("k"))
