"""Dashboards and assessments over the result registry tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import compliance_flags, messages, risk_level
from ..functions.times import micros_between, moment
from .budget import MAX_EPSILON, with_remaining

COMPLETED = "completed"


def method_label(method: Column, missing: str = "Unknown") -> Column:
    return F.coalesce(F.replace(F.upper(method), F.lit("_"), F.lit(" + ")), F.lit(missing))


def _completed(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == COMPLETED)


def list_files(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first, with the row and column counts of the stored metadata."""
    out = files.select(
        F.col("id").cast("string").alias("file_id"), F.col("original_filename").alias("filename"), F.col("file_size").alias("size"), "status",
        "upload_timestamp", F.coalesce("file_metadata.rows", F.lit(0)).alias("rows"),
        F.coalesce("file_metadata.column_count", F.lit(0)).alias("column_count"),
    ).orderBy(F.desc("upload_timestamp"), F.desc("file_id"))
    return out if limit is None else out.limit(limit)


def list_results(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; a missing score shows as 0."""
    out = results.select(
        "result_id", method_label(F.col("method")).alias("method"),
        F.coalesce("privacy_score", F.lit(0.0)).alias("privacy_score"), F.coalesce("utility_score", F.lit(0.0)).alias("utility_score"),
        "status", "created_timestamp",
    ).orderBy(F.desc("created_timestamp"), F.desc("result_id"))
    return out if limit is None else out.limit(limit)


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def metrics_summary(results: DataFrame) -> DataFrame:
    """Completed results: count, mean scores (missing = 0), spending, share with privacy above 0.7."""
    return _completed(results).agg(
        F.count(F.lit(1)).alias("total_anonymizations"),
        F.coalesce(F.avg(_zero("privacy_score")), F.lit(0.0)).alias("average_privacy_score"),
        F.coalesce(F.avg(_zero("utility_score")), F.lit(0.0)).alias("average_utility_score"),
        F.coalesce(F.sum(_zero("epsilon_used")), F.lit(0.0)).alias("epsilon_used"),
        F.coalesce(F.sum(_zero("delta_used")), F.lit(0.0)).alias("delta_used"),
        F.coalesce(F.avg((_zero("privacy_score") > 0.7).cast("double")), F.lit(0.0)).alias("compliance_rate"),
    )


def risk_distribution(results: DataFrame, attack: str = "overall_risk_score") -> DataFrame:
    level = risk_level(F.col("reidentification_risk"), F.col(attack)).alias("risk_level")
    return _completed(results).groupBy(level).agg(F.count(F.lit(1)).alias("n"))


def summary_recommendations(results: DataFrame, attack: str = "overall_risk_score") -> DataFrame:
    level = risk_level(F.col("reidentification_risk"), F.col(attack))
    facts = _completed(results).agg(
        F.avg(_zero("privacy_score")).alias("p"), F.avg(_zero("utility_score")).alias("u"),
        F.avg(level.isin("CRITICAL", "HIGH").cast("double")).alias("h"),
    )
    # Advice at each threshold.
    found = messages(
        (F.col("p") < 0.5, "Overall privacy protection is below recommended levels"),
        (F.col("u") < 0.5, "Data utility preservation could be improved"),
        (F.col("h") > 0.3, "High proportion of results have elevated privacy risks"),
        ((F.col("p") > 0.8) & (F.col("u") > 0.8), "Excellent balance between privacy and utility achieved"),
    )
    fine = F.array(F.lit("Privacy metrics are within acceptable ranges"))
    return facts.select(F.explode(F.when(F.size(found) > 0, found).otherwise(fine)).alias("recommendation"))


def _windows(results: DataFrame, start: datetime, count: int, width: timedelta) -> DataFrame:
    """Completed results with the number 0..count-1 of their window after ``start``."""
    since = micros_between(moment(start), F.col("created_timestamp").cast("timestamp_ntz"))
    slot = F.floor(since / F.lit(int(width.total_seconds() * 1_000_000)))
    tagged = _completed(results).withColumn("slot", slot)
    return tagged.filter((F.col("slot") >= 0) & (F.col("slot") < count))


def _all_windows(rows: DataFrame, count: int) -> DataFrame:
    return rows.sparkSession.range(count).withColumnRenamed("id", "slot").join(F.broadcast(rows), "slot", "left")


def privacy_utility_trend(results: DataFrame, as_of: datetime) -> DataFrame:
    """Mean scores in percent of the four weeks before ``as_of``; an empty week shows 0."""
    week = timedelta(weeks=1)
    rows = _windows(results, as_of - 4 * week, 4, week).groupBy("slot").agg(
        F.round(F.avg(_zero("privacy_score")) * 100, 1).alias("p"), F.round(F.avg(_zero("utility_score")) * 100, 1).alias("u")
    )
    return _all_windows(rows, 4).select(
        F.concat(F.lit("Week "), F.col("slot") + 1).alias("week"),
        F.coalesce("p", F.lit(0.0)).alias("privacy_score"), F.coalesce("u", F.lit(0.0)).alias("utility_score"),
    )


def methods_distribution(results: DataFrame) -> DataFrame:
    label = method_label(F.col("method"), "UNKNOWN").alias("method")
    return _completed(results).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def risk_protection_chart(assessments: DataFrame, results: DataFrame) -> DataFrame:
    """Protection in percent, 100 * (1 - mean attack score), over assessments of completed results.

    A missing or zero score takes the default of its attack. Assessments are
    summed per result before the join, so a much-assessed result is one row.
    """
    # What stands in for a missing or zero score.
    defaults = {"linkage_attack_score": 0.9, "membership_inference_score": 0.85, "attribute_inference_score": 0.88}
    filled = {c: F.coalesce(F.when(F.col(c) != 0, F.col(c)), F.lit(d)) for c, d in defaults.items()}
    per_result = assessments.groupBy("result_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(c) for c, v in filled.items()])
    done = _completed(results).select(F.col("id").alias("result_id"))
    joined = per_result.join(done, "result_id", "left_semi")
    share = lambda c: F.round((F.lit(1.0) - F.sum(c) / F.sum("n")) * 100, 1)
    # What the chart shows before anything was assessed.
    return joined.agg(
        F.coalesce(share("linkage_attack_score"), F.lit(95.0)).alias("linkage"),
        F.coalesce(share("membership_inference_score"), F.lit(90.0)).alias("membership"),
        F.coalesce(share("attribute_inference_score"), F.lit(88.0)).alias("attribute"),
    )


def performance_trend(results: DataFrame, as_of: datetime) -> DataFrame:
    """Mean execution time in the six 4-hour windows before ``as_of``, labelled by window start."""
    width, start = timedelta(hours=4), as_of - timedelta(hours=24)
    timed = results.filter(F.col("execution_time").isNotNull())
    rows = _windows(timed, start, 6, width).groupBy("slot").agg(F.round(F.avg("execution_time"), 2).alias("t"))
    begins = moment(start) + F.make_dt_interval(F.lit(0), (F.col("slot") * 4).cast("int"))
    return _all_windows(rows, 6).select(
        F.date_format(begins, "yyyy-MM-dd HH:mm").alias("window_start"), F.coalesce("t", F.lit(0.0)).alias("average_time")
    )


def budget_usage(results: DataFrame, total_epsilon: float = MAX_EPSILON, total_delta: float = 1e-3) -> DataFrame:
    """Spending of all completed results against the active budget."""
    e, d = F.sum(_zero("epsilon_used")), F.sum(_zero("delta_used"))
    used = _completed(results).agg(F.coalesce(e, F.lit(0.0)).alias("total_epsilon"), F.coalesce(d, F.lit(0.0)).alias("total_delta"))
    return with_remaining(used.withColumn("session_id", F.lit("default")), total_epsilon, total_delta)


def privacy_recommendations(reid: Column, epsilon: Column, attack: Column) -> Column:
    r, e, a = F.coalesce(reid, F.lit(0.5)), F.coalesce(epsilon, F.lit(0.0)), F.coalesce(attack, F.lit(0.5))
    # Advice at each threshold.
    found = messages(
        (r > 0.7, "High re-identification risk detected - apply stronger anonymization"),
        ((r > 0.4) & (r <= 0.7), "Moderate re-identification risk - consider additional privacy measures"),
        (e > MAX_EPSILON * 0.8, "Privacy budget nearly exhausted - limit further operations"),
        (a > 0.6, "High vulnerability to privacy attacks - strengthen anonymization parameters"),
    )
    fine = F.array(F.lit("Privacy protection appears adequate for current threat model"))
    return F.when(F.size(found) > 0, found).otherwise(fine)


def assess_risk(files: DataFrame, results: DataFrame) -> DataFrame:
    """One assessment per result, and one per raw file without results (risk 1).

    ``results`` carries ``overall_risk_score`` and ``k_value``.
    """
    done = results.select(
        F.concat(F.lit("result_"), F.col("id")).alias("data_id"), "reidentification_risk", "overall_risk_score", "epsilon_used", "k_value"
    )
    one = F.lit(1.0)
    raw = files.join(results.select(F.col("original_file_id").alias("id")).distinct(), "id", "left_anti").select(
        F.concat(F.lit("file_"), F.col("id")).alias("data_id"), one.alias("reidentification_risk"), one.alias("overall_risk_score"),
        F.lit(0.0).alias("epsilon_used"), F.lit(0).cast("bigint").alias("k_value"),
    )
    rows = done.unionByName(raw)
    reid = F.coalesce("reidentification_risk", F.lit(1.0))
    advice = privacy_recommendations(F.col("reidentification_risk"), F.col("epsilon_used"), F.col("overall_risk_score"))
    return rows.select(
        "data_id", (F.lit(1.0) - reid).alias("privacy_score"),
        risk_level(F.col("reidentification_risk"), F.col("overall_risk_score")).alias("risk_level"),
        *[c.alias(n) for n, c in compliance_flags(F.col("epsilon_used"), F.col("k_value")).items()],
        F.array_join(advice, "; ").alias("recommendations"),
    )


def cascade_delete(files: DataFrame, results: DataFrame, assessments: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the ``doomed(id)`` files, their results, and those results' assessments."""
    dead_files = doomed.select("id")
    dead_results = results.join(dead_files.withColumnRenamed("id", "original_file_id"), "original_file_id", "left_semi")
    return (
        files.join(dead_files, "id", "left_anti"),
        results.join(dead_files.withColumnRenamed("id", "original_file_id"), "original_file_id", "left_anti"),
        assessments.join(dead_results.select(F.col("id").alias("result_id")), "result_id", "left_anti"),
    )
