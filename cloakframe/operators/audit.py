"""Audit-log analytics. Times are always compared with an explicit ``as_of``."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import moment
from .budget import MAX_EPSILON
from .quantiles import values_at

# Action-name parts of security and of processing events.
SECURITY_ACTIONS = ["login", "auth", "upload", "download", "access", "error"]
PROCESSING_ACTIONS = ["upload", "anonymize", "download", "process", "generate"]
SUSPICIOUS_FAILURES = 10


def _action_has(words: list[str]) -> Column:
    return F.lower("action").rlike("|".join(words))


def in_range(logs: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Inclusive time range; a log partitioned by ``date`` is pruned to the days it touches."""
    out = logs
    for bound, op in ((start, ">="), (end, "<=")):
        if bound is None:
            continue
        at = moment(bound, logs.schema["timestamp"].dataType)
        out = out.filter(F.col("timestamp") >= at if op == ">=" else F.col("timestamp") <= at)
        if "date" in logs.columns:
            day = F.lit(bound.date())
            out = out.filter(F.col("date") >= day if op == ">=" else F.col("date") <= day)
    return out


def query_audit_log(
    logs: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    user_id=None,
    action: str | None = None,
    resource: str | None = None,
    session_id=None,
    limit: int | None = 100,
    newest_first: bool = False,
) -> DataFrame:
    """Filtered events, oldest first (or newest first), at most ``limit``: a top-k over sorted partitions."""
    out = in_range(logs, start, end)
    for column, wanted in (("user_id", user_id), ("action", action), ("resource", resource), ("session_id", session_id)):
        if wanted is not None:
            out = out.filter(F.col(column) == F.lit(wanted))
    order = [F.col("timestamp").desc(), F.col("id").desc()] if newest_first else ["timestamp", "id"]
    return out.orderBy(*order) if limit is None else out.orderBy(*order).limit(limit)


def _rate(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), d), F.lit(0.0))


def audit_summary(logs: DataFrame) -> DataFrame:
    ok, total = F.count_if("success"), F.count(F.lit(1))
    return logs.agg(
        total.alias("total_events"), ok.alias("successful_events"), (total - ok).alias("failed_events"),
        _rate(ok, total).alias("success_rate"),
        F.count_distinct("user_id").alias("unique_users"), F.count_distinct("session_id").alias("unique_sessions"),
    )


def event_counts(logs: DataFrame, *columns: str) -> DataFrame:
    """``(dimension, value, n)`` for each named column, one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns])
    return logs.select(F.inline(cells)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def _budget_events(logs: DataFrame) -> DataFrame:
    spent = F.col("epsilon").isNotNull() | F.col("delta").isNotNull()
    return logs.filter(spent | F.lower("action").contains("privacy"))


def privacy_compliance(logs: DataFrame, max_epsilon: float = MAX_EPSILON) -> DataFrame:
    """Events that spend budget or name privacy; compliant while the epsilon total stays within the limit."""
    total = F.coalesce(F.sum("epsilon"), F.lit(0.0))
    out = _budget_events(logs).agg(
        F.count(F.lit(1)).alias("total_privacy_events"), total.alias("total_epsilon_used"),
        F.coalesce(F.sum("delta"), F.lit(0.0)).alias("total_delta_used"), F.lit(float(max_epsilon)).alias("epsilon_budget_limit"),
    )
    fine = F.col("total_epsilon_used") <= F.col("epsilon_budget_limit")
    return out.withColumn("epsilon_compliance", fine).withColumn(
        "compliance_status", F.when(fine, "COMPLIANT").otherwise("NON_COMPLIANT")
    )


def session_budgets(logs: DataFrame) -> DataFrame:
    """Budget used per session (or none: ``default``) over all events that spend."""
    spending = logs.filter(F.col("epsilon").isNotNull() | F.col("delta").isNotNull())
    return spending.groupBy(F.coalesce(F.col("session_id").cast("string"), F.lit("default")).alias("session_id")).agg(
        F.coalesce(F.sum("epsilon"), F.lit(0.0)).alias("epsilon_used"),
        F.coalesce(F.sum("delta"), F.lit(0.0)).alias("delta_used"),
        F.count(F.lit(1)).alias("operations_count"),
    )


def mechanisms_used(logs: DataFrame) -> DataFrame:
    return _budget_events(logs).filter(F.col("mechanism").isNotNull()).groupBy("mechanism").agg(F.count(F.lit(1)).alias("n"))


def security_summary(logs: DataFrame) -> DataFrame:
    """Security events, failed ones, and distinct addresses over all events."""
    security = _action_has(SECURITY_ACTIONS)
    return logs.agg(
        F.count_if(security).alias("total_security_events"),
        F.count_if(security & ~F.col("success")).alias("failed_security_events"),
        F.count_distinct("ip_address").alias("unique_ip_addresses"),
    )


def security_events(logs: DataFrame) -> DataFrame:
    """Failed security events per address; more than ten make it suspicious."""
    failed = logs.filter(_action_has(SECURITY_ACTIONS) & ~F.col("success") & F.col("ip_address").isNotNull())
    return failed.groupBy("ip_address").agg(F.count(F.lit(1)).alias("failures")).withColumn(
        "suspicious", F.col("failures") > SUSPICIOUS_FAILURES
    )


def processing_stats(logs: DataFrame, actions: list[str] | None = None) -> DataFrame:
    """Counts and times of processing events; the median is element n // 2 of the sorted times."""
    rows = logs.filter(_action_has(actions or PROCESSING_ACTIONS)).withColumn("execution_time", F.col("execution_time").cast("double"))
    median = values_at(rows, ["execution_time"], lambda _, n: {"m": n // 2}).get(("execution_time", "m"), 0.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("total_processing_events"),
        F.count_if(F.lower("action").contains("upload")).alias("files_processed"),
        F.count_if(F.lower("action").contains("anonymize")).alias("anonymization_jobs"),
        zero(F.avg("execution_time")).alias("average_processing_time"),
        zero(F.min("execution_time")).alias("min_time"), zero(F.max("execution_time")).alias("max_time"),
        F.lit(float(median)).alias("median_time"),
    )


def performance_stats(logs: DataFrame) -> DataFrame:
    error = _rate(F.count_if(~F.col("success")), F.count(F.lit(1)))
    average = F.coalesce(F.avg("execution_time"), F.lit(0.0))
    return logs.agg(
        F.count(F.lit(1)).alias("total_system_events"), error.alias("system_error_rate"), average.alias("average_response_time"),
        F.greatest(F.lit(0.0), F.lit(1.0) - error - average / F.lit(100.0)).alias("system_health_score"),
    )


def hourly_histogram(logs: DataFrame) -> DataFrame:
    return logs.groupBy(F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("events"))


def _long(section: str, df: DataFrame) -> DataFrame:
    """One-row frame as ``(section, metric, value)``; booleans and text stay out."""
    cells = [
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c, t in df.dtypes
        if t in ("double", "bigint", "int", "boolean")
    ]
    return df.select(F.lit(section).alias("section"), F.inline(F.array(*cells)))


def check_period(start: datetime, end: datetime) -> None:
    if start > end:
        raise ValueError("the period ends before it starts")
    if (end - start).days > 365:
        raise ValueError("a report covers 365 days at most")


def compliance_report(
    logs: DataFrame, start: datetime, end: datetime, max_epsilon: float = MAX_EPSILON, processing: list[str] | None = None
) -> DataFrame:
    """All sections over an inclusive period of at most a year, as ``(section, metric, value)``."""
    check_period(start, end)
    period = in_range(logs, start, end)
    out = _long("summary", audit_summary(period))
    for section, part in (
        ("privacy_compliance", privacy_compliance(period, max_epsilon)),
        ("security_events", security_summary(period)),
        ("data_processing", processing_stats(period, processing)),
        ("system_performance", performance_stats(period)),
    ):
        out = out.unionByName(_long(section, part))
    hours = hourly_histogram(period).select(
        F.lit("peak_hours").alias("section"), F.concat(F.lit("hour_"), F.col("hour")).alias("metric"), F.col("events").cast("double").alias("value")
    )
    suspects = security_events(period).filter("suspicious").select(
        F.lit("suspicious_activity").alias("section"), F.col("ip_address").alias("metric"), F.col("failures").cast("double").alias("value")
    )
    return out.unionByName(hours).unionByName(suspects)


def retention_cutoff(as_of: datetime, retention_days: int) -> datetime:
    if not 7 <= retention_days <= 365:
        raise ValueError("retention must be between 7 and 365 days")
    return as_of - timedelta(days=retention_days)


def retention_cleanup(logs: DataFrame, as_of: datetime, retention_days: int = 90) -> DataFrame:
    """Events strictly newer than the cut-off."""
    cut = retention_cutoff(as_of, retention_days)
    out = logs.filter(F.col("timestamp") > moment(cut, logs.schema["timestamp"].dataType))
    return out.filter(F.col("date") >= F.lit(cut.date())) if "date" in logs.columns else out


def export_audit(logs: DataFrame, start: datetime, end: datetime, path: str) -> int:
    """Write the period as JSON lines; returns the number of records."""
    check_period(start, end)
    in_range(logs, start, end).write.mode("overwrite").json(path)
    return logs.sparkSession.read.schema(logs.schema).json(path).count()


def audit_statistics(logs: DataFrame, as_of: datetime, days: int = 30, top: int = 10) -> DataFrame:
    """Last ``days`` days as ``(section, metric, value)``: totals, actions, days, users, literal privacy spending, top actions."""
    period = in_range(logs, as_of - timedelta(days=days), as_of)
    ok, total = F.count_if("success"), F.count(F.lit(1))
    privacy = F.lower("action").contains("privacy")
    spent = F.coalesce(F.sum(F.when(privacy, F.col("detail_epsilon"))), F.lit(0.0))
    totals = period.agg(
        total.alias("total_events"), ok.alias("successful_events"), (total - ok).alias("failed_events"), _rate(ok, total).alias("success_rate"),
        F.count_distinct("action").alias("unique_actions"), F.count_if(privacy).alias("privacy_events"), spent.alias("total_epsilon_used"),
        F.greatest(F.lit(0.0), F.lit(MAX_EPSILON) - spent).alias("epsilon_budget_remaining"),
    )
    named = period.select("action", F.coalesce(F.col("user_id").cast("string"), F.lit("anonymous")).alias("user"),
                          F.date_format("timestamp", "yyyy-MM-dd").alias("day"))
    groups = event_counts(named, "action", "day", "user").select(
        F.col("dimension").alias("section"), F.col("value").alias("metric"), F.col("n").cast("double").alias("value")
    )
    leaders = period.groupBy("action").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "action").limit(top)
    leaders = leaders.select(F.lit("top_actions").alias("section"), F.col("action").alias("metric"), F.col("n").cast("double").alias("value"))
    return _long("event_summary", totals).unionByName(groups).unionByName(leaders)


def recent_status(logs: DataFrame, as_of: datetime) -> DataFrame:
    """Totals, last 24 hours, sessions with spending, health words."""
    since = moment(as_of - timedelta(hours=24), logs.schema["timestamp"].dataType)
    spending = F.col("epsilon").isNotNull() | F.col("delta").isNotNull()
    out = logs.agg(
        F.count(F.lit(1)).alias("total_logs_stored"), F.count_if(F.col("timestamp") > since).alias("logs_last_24h"),
        F.count_distinct(F.when(spending, F.coalesce(F.col("session_id").cast("string"), F.lit("default")))).alias("privacy_sessions_active"),
    )
    recent = F.when(F.col("logs_last_24h") > 0, "normal").otherwise("low")
    tracking = F.when(F.col("privacy_sessions_active") > 0, "active").otherwise("inactive")
    out = out.withColumn("recent_activity", recent).withColumn("privacy_tracking", tracking)
    return out.withColumn(
        "overall_health",
        F.when((F.col("recent_activity") == "normal") & (F.col("privacy_tracking") == "active"), "healthy").otherwise("degraded"),
    )
