"""Queries over recorded interactions, with their SQL twins: events are requests and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalith.plans.catalog import read
from catalith.streaming import recording as R


def _key():
    return F.concat_ws("/", "user_id", "event_type")


def _answers(spark, sf_dir):
    """Two events of three as answers, some failed, some with a secret."""
    n = F.col("event_id")
    failed = n % 7 == 0
    return read(spark, sf_dir, "events").where("event_id % 3 <> 0").select(
        _key().alias("key"), F.concat(F.lit("id="), n.cast("string"), F.lit("&token=t"), n.cast("string"), F.lit(" v="), F.col("event_type")).alias("response"), F.when(failed, "Timeout").alias("error_type"),
        F.when(failed & (n % 2 == 0), F.concat(F.lit("after api_key=k"), n.cast("string"))).alias("error_message"), (n % 100 - 5).cast("double").alias("latency"), F.col("ts").alias("captured_at"),
    )


def recorded_latest(spark, sf_dir):
    """One record a key: the last captured, failures too, without secrets."""
    out = R.latest(R.scrubbed(_answers(spark, sf_dir)))
    return out.select("key", "outcome", "response", "error_type", "error_message", F.col("captured_at").cast("timestamp_ntz").alias("captured_at"))


def recorded_replay(spark, sf_dir):
    """Requests against the records: answered, failed again, or never recorded."""
    requests = read(spark, sf_dir, "events").select("event_id", _key().alias("key"))
    return R.replayed(requests, R.scrubbed(_answers(spark, sf_dir))).select("event_id", "key", "outcome", "response", "error_type")


QUERIES = {f.__name__: f for f in (recorded_latest, recorded_replay)}

_LATEST = """
    WITH answers AS (
        SELECT user_id || '/' || event_type AS key, ts, CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'success' END AS outcome, CASE WHEN event_id % 7 <> 0 THEN 'id=' || event_id || '&token=[REDACTED] v=' || event_type END AS response,
               CASE WHEN event_id % 7 = 0 THEN 'Timeout' END AS error_type, CASE WHEN event_id % 7 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'after api_key=[REDACTED]' ELSE '' END END AS error_message
        FROM events WHERE event_id % 3 <> 0
    ), latest AS (
        SELECT * FROM answers QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, outcome DESC, coalesce(response, '') DESC, coalesce(error_type, '') DESC, coalesce(error_message, '') DESC) = 1
    )
"""
ORACLE_SQL = {
    "recorded_latest": f"{_LATEST} SELECT key, outcome, response, error_type, error_message, ts AS captured_at FROM latest",
    "recorded_replay": f"{_LATEST} SELECT event_id, e.user_id || '/' || e.event_type AS key, CASE WHEN l.key IS NULL THEN 'MISS' WHEN outcome = 'error' THEN 'ERROR' ELSE 'HIT' END AS outcome, response, error_type FROM events e LEFT JOIN latest l ON l.key = e.user_id || '/' || e.event_type",
}
