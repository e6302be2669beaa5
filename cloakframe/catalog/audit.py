"""Audit analytics over a log derived from events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import audit as ops
from ..session import scratch_path
from .base import r, rounded, table

AS_OF = datetime(2024, 1, 31)
START, END = datetime(2024, 1, 5), datetime(2024, 1, 20)

_ACTIONS = {"view": "data_access", "click": "file_upload", "purchase": "anonymize_data", "signup": "privacy_assessment", "error": "login_error"}


def log(spark, sf):
    return derive_log(table(spark, sf, "events"))


def derive_log(events):
    """The events table (or stream) as an audit log."""
    k = F.get_json_object("props", "$.k").cast("int")
    action = F.coalesce(*[F.when(F.col("event_type") == e, a) for e, a in _ACTIONS.items()])
    spends = F.col("event_type").isin("purchase", "signup")
    return events.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.col("ts").alias("timestamp"),
        F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string")).alias("user_id"),
        F.when(F.col("user_id") % 15 != 0, F.concat(F.lit("s"), F.col("user_id"))).alias("session_id"),
        action.alias("action"), F.concat(F.lit("resource_"), k % 7).alias("resource"),
        F.create_map(F.lit("epsilon"), (k / 1000.0).cast("string")).alias("details"),
        F.concat(F.lit("10.0.0."), F.col("user_id") % 50).alias("ip_address"), F.lit("agent").alias("user_agent"),
        ((F.col("event_type") != "error") | (k % 4 == 0)).alias("success"), F.col("value").alias("execution_time"),
        F.when(spends, k / 1000.0).alias("epsilon"), F.when(spends, F.lit(1e-6)).alias("delta"),
        F.when(spends & (k % 3 > 0), F.when(k % 3 == 1, "gaussian").otherwise("laplace")).alias("mechanism"),
        (k / 1000.0).alias("detail_epsilon"),
    )


_KSQL = "json_extract(props, '$.k')::INT"
_CASE = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{a}'" for e, a in _ACTIONS.items()) + " END"
_SPENDS = "event_type IN ('purchase', 'signup')"
LOG = (
    "logs AS MATERIALIZED (SELECT lpad(event_id::VARCHAR, 12, '0') AS id, ts AS timestamp, CASE WHEN user_id % 10 <> 0 THEN user_id::VARCHAR END AS user_id, "
    f"CASE WHEN user_id % 15 <> 0 THEN 's' || user_id END AS session_id, {_CASE} AS action, 'resource_' || ({_KSQL} % 7) AS resource, "
    f"'10.0.0.' || (user_id % 50) AS ip_address, event_type <> 'error' OR {_KSQL} % 4 = 0 AS success, value AS execution_time, "
    f"CASE WHEN {_SPENDS} THEN {_KSQL} / 1000.0::DOUBLE END AS epsilon, CASE WHEN {_SPENDS} THEN 1e-6::DOUBLE END AS delta, "
    f"CASE WHEN {_SPENDS} AND {_KSQL} % 3 = 1 THEN 'gaussian' WHEN {_SPENDS} AND {_KSQL} % 3 = 2 THEN 'laplace' END AS mechanism, {_KSQL} / 1000.0::DOUBLE AS detail_epsilon FROM events)"
)
_IN = "timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20'"


def _shown(df):
    return df.select("id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "user_id", "action", "success")


_SHOWN = "id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, user_id, action, success"


def query_audit_log(spark, sf):
    return _shown(ops.query_audit_log(log(spark, sf), START, END, action="file_upload", limit=None))


def query_audit_log_first(spark, sf):
    return _shown(ops.query_audit_log(log(spark, sf), START, END, user_id="8"))


def newest_events(spark, sf):
    return _shown(ops.query_audit_log(log(spark, sf), limit=50, newest_first=True))


def audit_summary(spark, sf):
    return rounded(ops.audit_summary(log(spark, sf)))


def event_counts(spark, sf):
    return ops.event_counts(log(spark, sf), "action", "resource")


def privacy_compliance(spark, sf):
    return rounded(ops.privacy_compliance(log(spark, sf)))


def session_budgets(spark, sf):
    return rounded(ops.session_budgets(log(spark, sf)))


def mechanisms_used(spark, sf):
    return ops.mechanisms_used(log(spark, sf))


def security_summary(spark, sf):
    return ops.security_summary(log(spark, sf))


def security_events(spark, sf):
    return ops.security_events(log(spark, sf))


def processing_stats(spark, sf):
    return rounded(ops.processing_stats(log(spark, sf)))


def performance_stats(spark, sf):
    return rounded(ops.performance_stats(log(spark, sf)))


def hourly_histogram(spark, sf):
    return ops.hourly_histogram(log(spark, sf))


def compliance_report(spark, sf):
    return rounded(ops.compliance_report(log(spark, sf), START, END))


def retention_cleanup(spark, sf):
    return _shown(ops.retention_cleanup(log(spark, sf), AS_OF, 14))


def export_audit(spark, sf):
    rows, path = log(spark, sf).drop("details"), scratch_path(spark, "export")
    ops.export_audit(rows, START, END, path)
    return _shown(spark.read.schema(rows.schema).json(path))


def audit_statistics(spark, sf):
    return rounded(ops.audit_statistics(log(spark, sf), AS_OF, 20))


def recent_status(spark, sf):
    return ops.recent_status(log(spark, sf), AS_OF)


QUERIES = {
    f.__name__: f
    for f in (
        query_audit_log, query_audit_log_first, newest_events, audit_summary, event_counts, privacy_compliance, session_budgets, mechanisms_used,
        security_summary, security_events, processing_stats, performance_stats, hourly_histogram, compliance_report, retention_cleanup,
        export_audit, audit_statistics, recent_status,
    )
}

_SECURITY = "regexp_matches(lower(action), 'login|auth|upload|download|access|error')"
_PROCESSING = "regexp_matches(lower(action), 'upload|anonymize|download|process|generate')"
_BUDGET = "(epsilon IS NOT NULL OR delta IS NOT NULL OR contains(lower(action), 'privacy'))"


def _median(source: str) -> str:
    return (
        f"(SELECT execution_time FROM (SELECT execution_time, row_number() OVER (ORDER BY execution_time) - 1 AS i, count(*) OVER () AS n FROM {source} "
        f"WHERE {_PROCESSING}) WHERE i = n // 2)"
    )


def _long(section: str, source: str, where: str, metrics: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, '{m}' AS metric, {r(e)} AS value FROM {source} WHERE {where}" for m, e in metrics.items())


_RATE = "count(*) FILTER (success) / count(*)::DOUBLE"
_ERROR = "count(*) FILTER (NOT success) / count(*)::DOUBLE"
_SUMMARY = {
    "total_events": "count(*)", "successful_events": "count(*) FILTER (success)", "failed_events": "count(*) FILTER (NOT success)", "success_rate": _RATE,
    "unique_users": "count(DISTINCT user_id)", "unique_sessions": "count(DISTINCT session_id)",
}
_COMPLIANCE = {
    "total_privacy_events": "count(*)", "total_epsilon_used": "sum(epsilon)", "total_delta_used": "sum(delta)", "epsilon_budget_limit": "max(10.0::DOUBLE)",
    "epsilon_compliance": "CASE WHEN sum(epsilon) <= 10.0 THEN 1 ELSE 0 END",
}
_SECURE = {
    "total_security_events": f"count(*) FILTER ({_SECURITY})", "failed_security_events": f"count(*) FILTER ({_SECURITY} AND NOT success)", "unique_ip_addresses": "count(DISTINCT ip_address)",
}
_PROCESS = {
    "total_processing_events": "count(*)", "files_processed": "count(*) FILTER (contains(action, 'upload'))", "anonymization_jobs": "count(*) FILTER (contains(action, 'anonymize'))",
    "average_processing_time": "avg(execution_time)", "min_time": "min(execution_time)", "max_time": "max(execution_time)",
}
_PERFORM = {
    "total_system_events": "count(*)", "system_error_rate": _ERROR, "average_response_time": "avg(execution_time)",
    "system_health_score": f"greatest(0.0, 1.0::DOUBLE - {_ERROR} - avg(execution_time) / 100.0::DOUBLE)",
}
_wide = lambda metrics, whole: ", ".join(f"{e} AS {m}" if m in whole else f"{r(e)} AS {m}" for m, e in metrics.items())
_FAILS = f"SELECT ip_address, count(*) AS failures, count(*) > 10 AS suspicious FROM {{t}} WHERE {_SECURITY} AND NOT success GROUP BY 1"
_LAST = "p AS MATERIALIZED (SELECT * FROM logs WHERE timestamp >= TIMESTAMP '2024-01-11' AND timestamp <= TIMESTAMP '2024-01-31')"
_SPENT = "coalesce(sum(detail_epsilon) FILTER (contains(action, 'privacy')), 0.0)"

ORACLES = {
    "query_audit_log": f"WITH {LOG} SELECT {_SHOWN} FROM logs WHERE {_IN} AND action = 'file_upload'",
    "query_audit_log_first": f"WITH {LOG} SELECT {_SHOWN} FROM logs l WHERE {_IN} AND user_id = '8' ORDER BY l.timestamp, id LIMIT 100",
    "newest_events": f"WITH {LOG} SELECT {_SHOWN} FROM logs l ORDER BY l.timestamp DESC, id DESC LIMIT 50",
    "audit_summary": f"WITH {LOG} SELECT {_wide(_SUMMARY, set(_SUMMARY) - {'success_rate'})} FROM logs",
    "event_counts": f"WITH {LOG} SELECT 'action' AS dimension, action AS value, count(*) AS n FROM logs GROUP BY 2 UNION ALL SELECT 'resource', resource, count(*) FROM logs GROUP BY 2",
    "privacy_compliance": f"WITH {LOG} SELECT count(*) AS total_privacy_events, {r('sum(epsilon)')} AS total_epsilon_used, {r('sum(delta)')} AS total_delta_used, 10.0::DOUBLE AS epsilon_budget_limit, "
    f"sum(epsilon) <= 10.0 AS epsilon_compliance, CASE WHEN sum(epsilon) <= 10.0 THEN 'COMPLIANT' ELSE 'NON_COMPLIANT' END AS compliance_status FROM logs WHERE {_BUDGET}",
    "session_budgets": f"WITH {LOG} SELECT coalesce(session_id, 'default') AS session_id, {r('sum(epsilon)')} AS epsilon_used, {r('sum(delta)')} AS delta_used, count(*) AS operations_count FROM logs WHERE epsilon IS NOT NULL GROUP BY 1",
    "mechanisms_used": f"WITH {LOG} SELECT mechanism, count(*) AS n FROM logs WHERE mechanism IS NOT NULL GROUP BY 1",
    "security_summary": f"WITH {LOG} SELECT {_wide(_SECURE, set(_SECURE))} FROM logs",
    "security_events": f"WITH {LOG} {_FAILS.format(t='logs')}",
    "processing_stats": f"WITH {LOG} SELECT {_wide(_PROCESS, {'total_processing_events', 'files_processed', 'anonymization_jobs'})}, {_median('logs')} AS median_time FROM logs WHERE {_PROCESSING}",
    "performance_stats": f"WITH {LOG} SELECT {_wide(_PERFORM, {'total_system_events'})} FROM logs",
    "hourly_histogram": f"WITH {LOG} SELECT hour(timestamp)::INT AS hour, count(*) AS events FROM logs GROUP BY 1",
    "compliance_report": f"WITH {LOG}, p AS MATERIALIZED (SELECT * FROM logs WHERE {_IN}) " + " UNION ALL ".join(
        [
            _long("summary", "p", "true", _SUMMARY), _long("privacy_compliance", "p", _BUDGET, _COMPLIANCE), _long("security_events", "p", "true", _SECURE),
            _long("data_processing", "p", _PROCESSING, _PROCESS), f"SELECT 'data_processing', 'median_time', {_median('p')}", _long("system_performance", "p", "true", _PERFORM),
            "SELECT 'peak_hours', 'hour_' || hour(timestamp), count(*)::DOUBLE FROM p GROUP BY hour(timestamp)",
            f"SELECT 'suspicious_activity', ip_address, failures::DOUBLE FROM ({_FAILS.format(t='p')}) WHERE suspicious",
        ]
    ),
    "retention_cleanup": f"WITH {LOG} SELECT {_SHOWN} FROM logs l WHERE l.timestamp > TIMESTAMP '2024-01-17'",
    "export_audit": f"WITH {LOG} SELECT {_SHOWN} FROM logs l WHERE l.timestamp >= TIMESTAMP '2024-01-05' AND l.timestamp <= TIMESTAMP '2024-01-20'",
    "audit_statistics": f"WITH {LOG}, {_LAST} " + " UNION ALL ".join(
        [
            _long("event_summary", "p", "true", {**{m: _SUMMARY[m] for m in list(_SUMMARY)[:4]}, "unique_actions": "count(DISTINCT action)", "privacy_events": "count(*) FILTER (contains(action, 'privacy'))",
                                                 "total_epsilon_used": _SPENT, "epsilon_budget_remaining": f"greatest(0.0, 10.0 - {_SPENT})"}),
            "SELECT 'action', action, count(*)::DOUBLE FROM p GROUP BY 2", "SELECT 'day', strftime(timestamp, '%Y-%m-%d'), count(*)::DOUBLE FROM p GROUP BY 2",
            "SELECT 'user', coalesce(user_id, 'anonymous'), count(*)::DOUBLE FROM p GROUP BY 2", "SELECT * FROM (SELECT 'top_actions', action, count(*)::DOUBLE FROM p GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)",
        ]
    ),
    "recent_status": f"WITH {LOG} SELECT count(*) AS total_logs_stored, count(*) FILTER (timestamp > TIMESTAMP '2024-01-30') AS logs_last_24h, "
    "count(DISTINCT coalesce(session_id, 'default')) FILTER (epsilon IS NOT NULL) AS privacy_sessions_active, 'normal' AS recent_activity, 'active' AS privacy_tracking, 'healthy' AS overall_health FROM logs",
}
