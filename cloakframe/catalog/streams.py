"""Streaming twins, driven over the events table as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import audit_streams as ops
from ..streaming.protect import protect_stream
from . import audit
from .base import SALT, r, rounded, sql_flip, sql_laplace, table


def _log_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    events = ops.read_events(spark, sf, "events.parquet", schema)
    return audit.derive_log(events)


def stream_daily_activity(spark, sf):
    return ops.run_updates(ops.daily_activity(_log_stream(spark, sf)), ["day", "action"])


def stream_performance(spark, sf):
    return rounded(ops.run_updates(ops.performance_windows(_log_stream(spark, sf)), ["window_start"]))


def stream_failed_by_ip(spark, sf):
    return ops.suspicious(ops.run_updates(ops.failed_by_ip(_log_stream(spark, sf)), ["ip_address"]))


def stream_budget_ledger(spark, sf):
    return rounded(ops.run_updates(ops.budget_by_session(_log_stream(spark, sf)), ["session_id"]))


def stream_protect(spark, sf):
    events = ops.read_events(spark, sf, "events.parquet", table(spark, sf, "events").schema)
    masked = events.select("event_id", F.col("user_id").cast("string").alias("user_id"), "event_type", "value")
    hidden = protect_stream(
        masked, ["event_id"], SALT, 1.0, ["user_id"], {"value": (0.0, 200.0)}, {"event_type": ["click", "error", "purchase", "signup", "view"]}
    )
    return rounded(ops.run_append(hidden), 4)


QUERIES = {f.__name__: f for f in (stream_daily_activity, stream_performance, stream_failed_by_ip, stream_budget_ledger, stream_protect)}

ORACLES = {
    "stream_daily_activity": f"WITH {audit.LOG} SELECT strftime(timestamp, '%Y-%m-%d') AS day, action, count(*) AS events FROM logs GROUP BY 1, 2",
    "stream_performance": f"WITH {audit.LOG} SELECT strftime(time_bucket(INTERVAL 4 HOURS, timestamp), '%Y-%m-%d %H:%M') AS window_start, {r('avg(execution_time)')} AS average_time, count(*) AS events FROM logs GROUP BY 1",
    "stream_failed_by_ip": f"WITH {audit.LOG} SELECT ip_address, count(*) AS failures FROM logs WHERE regexp_matches(action, 'login|auth|upload|download|access|error') AND NOT success GROUP BY 1 HAVING count(*) > 10",
    "stream_budget_ledger": f"WITH {audit.LOG} SELECT coalesce(session_id, 'default') AS session_id, {r('sum(epsilon)')} AS total_epsilon, {r('sum(delta)')} AS total_delta, count(*) AS operations FROM logs WHERE epsilon IS NOT NULL GROUP BY 1",
    "stream_protect": "SELECT event_id, 'anon_' || (('0x' || substr(sha256('s1|' || user_id), 1, 13))::BIGINT % 10000) AS user_id, "
    f"{sql_flip('events', 'event_type', 'event_id', 1.0, SALT)} AS event_type, {r('least(greatest(value, 0.0), 200.0) + ' + sql_laplace(SALT, 'lap:value', 'event_id', '200.0'), 4)} AS value FROM events",
}
