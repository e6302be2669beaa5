"""Dashboards over registry tables derived from customers (files), orders (results) and line items (assessments)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.times import moment
from ..operators import registry as ops
from .base import r, rounded, table

AS_OF = datetime(2001, 7, 25)
# A method per order priority; the last one is left without a method.
_METHODS = {"1-URGENT": "sdg", "2-HIGH": "dp", "3-MEDIUM": "sdg_dp", "4-NOT SPECIFIED": "full"}


def files(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("original_filename"), (F.col("c_nationkey") * 100 + 1).alias("file_size"),
        F.lit("uploaded").alias("status"),
        (moment(datetime(2001, 9, 9, 1, 46, 40)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("c_custkey") * 61 % 5_000_000)).alias("upload_timestamp"),
        F.when(F.col("c_custkey") % 4 != 0, F.struct(F.col("c_nationkey").alias("rows"), F.array(F.col("c_name")).alias("columns"), (F.col("c_custkey") % 9).cast("int").alias("column_count"))).alias("file_metadata"),
    )


FILES = (
    "files AS MATERIALIZED (SELECT c_custkey AS id, c_name AS original_filename, c_nationkey * 100 + 1 AS file_size, 'uploaded' AS status, "
    "make_timestamp((1000000000 + c_custkey * 61 % 5000000) * 1000000) AS upload_timestamp, "
    "CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END AS rows, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 9 END AS column_count FROM customer)"
)


def results(spark, sf):
    key, price = F.col("o_orderkey"), F.col("o_totalprice") / 500_000.0
    hours = F.make_dt_interval(F.lit(0), (key % 24).cast("int"), (key % 60).cast("int"))
    method = F.coalesce(*[F.when(F.col("o_orderpriority") == p, m) for p, m in _METHODS.items()])
    return table(spark, sf, "orders").select(
        key.alias("id"), F.concat(F.lit("anon_"), key).alias("result_id"), F.col("o_custkey").alias("original_file_id"), method.alias("method"),
        F.when(key % 6 != 0, price).alias("privacy_score"), F.when(key % 7 != 0, 1.0 - price).alias("utility_score"),
        (key % 20 / 10.0).alias("epsilon_used"), F.lit(1e-6).alias("delta_used"), F.when(key % 8 != 0, 1.0 - price).alias("reidentification_risk"),
        (F.dayofyear("o_orderdate") / 366.0).alias("overall_risk_score"), (key % 12).alias("k_value"),
        F.when(key % 5 != 0, price * 10).alias("execution_time"), (F.col("o_orderdate") + hours).alias("created_timestamp"),
        F.when(F.col("o_orderstatus") == "P", "processing").otherwise("completed").alias("status"),
    )


RESULTS = (
    "results AS MATERIALIZED (SELECT o_orderkey AS id, 'anon_' || o_orderkey AS result_id, o_custkey AS original_file_id, CASE o_orderpriority "
    + " ".join(f"WHEN '{p}' THEN '{m}'" for p, m in _METHODS.items())
    + " END AS method, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice / 500000.0::DOUBLE END AS privacy_score, CASE WHEN o_orderkey % 7 <> 0 THEN 1.0::DOUBLE - o_totalprice / 500000.0::DOUBLE END AS utility_score, "
    "(o_orderkey % 20) / 10.0::DOUBLE AS epsilon_used, 1e-6::DOUBLE AS delta_used, CASE WHEN o_orderkey % 8 <> 0 THEN 1.0::DOUBLE - o_totalprice / 500000.0::DOUBLE END AS reidentification_risk, "
    "dayofyear(o_orderdate) / 366.0::DOUBLE AS overall_risk_score, o_orderkey % 12 AS k_value, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 500000.0::DOUBLE * 10 END AS execution_time, "
    "o_orderdate + to_hours((o_orderkey % 24)::INT) + to_minutes((o_orderkey % 60)::INT) AS created_timestamp, CASE WHEN o_orderstatus = 'P' THEN 'processing' ELSE 'completed' END AS status FROM orders)"
)


def assessments(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("result_id"), F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("linkage_attack_score"),
        F.col("l_tax").alias("membership_inference_score"), (F.col("l_quantity") / 100.0).alias("attribute_inference_score"),
    )


def _stamp(df, name):
    return df.withColumn(name, F.date_format(name, "yyyy-MM-dd HH:mm:ss"))


def list_files(spark, sf):
    return _stamp(ops.list_files(files(spark, sf)), "upload_timestamp")


def list_results(spark, sf):
    return rounded(_stamp(ops.list_results(results(spark, sf)), "created_timestamp"), 10)


def metrics_summary(spark, sf):
    return rounded(ops.metrics_summary(results(spark, sf)))


def risk_distribution(spark, sf):
    return ops.risk_distribution(results(spark, sf))


def summary_recommendations(spark, sf):
    return ops.summary_recommendations(results(spark, sf))


def budget_usage(spark, sf):
    return rounded(ops.budget_usage(results(spark, sf), 20_000.0, 1.0))


def privacy_utility_trend(spark, sf):
    return ops.privacy_utility_trend(results(spark, sf), AS_OF)


def methods_distribution(spark, sf):
    return ops.methods_distribution(results(spark, sf))


def risk_protection_chart(spark, sf):
    return ops.risk_protection_chart(assessments(spark, sf), results(spark, sf))


def performance_trend(spark, sf):
    return ops.performance_trend(results(spark, sf), AS_OF)


def risk_level(spark, sf):
    from ..functions.scoring import risk_level as level

    return results(spark, sf).select("id", level(F.col("reidentification_risk"), F.col("overall_risk_score")).alias("risk_level"))


def compliance_flags(spark, sf):
    from ..functions.scoring import compliance_flags as flags

    return results(spark, sf).select("id", *[c.alias(n) for n, c in flags(F.col("epsilon_used"), F.col("k_value")).items()])


def assess_risk(spark, sf):
    return rounded(ops.assess_risk(files(spark, sf), results(spark, sf)), 10)


def cascade_delete(spark, sf):
    """Delete the files of one nation; count what is left in the three tables."""
    f, done, checks = files(spark, sf), results(spark, sf), assessments(spark, sf)
    doomed = table(spark, sf, "customer").filter(F.col("c_nationkey") == 3).select(F.col("c_custkey").alias("id"))
    left = ops.cascade_delete(f, done, checks, doomed)
    counts = [t.agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("rows")) for n, t in zip(("files", "results", "assessments"), left)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


QUERIES = {
    f.__name__: f
    for f in (
        list_files, list_results, metrics_summary, risk_distribution, summary_recommendations, budget_usage, privacy_utility_trend,
        methods_distribution, risk_protection_chart, performance_trend, risk_level, compliance_flags, assess_risk, cascade_delete,
    )
}

_DONE = "FROM results WHERE status = 'completed'"
_LABEL = lambda missing: f"coalesce(replace(upper(method), '_', ' + '), '{missing}')"


def _level(mean: str) -> str:
    return f"CASE WHEN {mean} >= 0.8 THEN 'CRITICAL' WHEN {mean} >= 0.6 THEN 'HIGH' WHEN {mean} >= 0.4 THEN 'MEDIUM' WHEN {mean} >= 0.2 THEN 'LOW' ELSE 'MINIMAL' END"


_LEVEL = _level("((coalesce(reidentification_risk, 0.5) + coalesce(overall_risk_score, 0.5)) / 2.0::DOUBLE)")
_FLAGS = (
    "epsilon_used <= 1.0 AS gdpr_compliant, epsilon_used <= 0.5 AS hipaa_suitable, epsilon_used > 0 AS differential_privacy, "
    "k_value >= 5 AS k_anonymity, epsilon_used <= 1.0 AND k_value >= 5 AS overall_compliant"
)
_NOTES = [
    ("coalesce(reidentification_risk, 0.5) > 0.7", "High re-identification risk detected - apply stronger anonymization"),
    ("coalesce(reidentification_risk, 0.5) > 0.4 AND coalesce(reidentification_risk, 0.5) <= 0.7", "Moderate re-identification risk - consider additional privacy measures"),
    ("epsilon_used > 8.0", "Privacy budget nearly exhausted - limit further operations"),
    ("overall_risk_score > 0.6", "High vulnerability to privacy attacks - strengthen anonymization parameters"),
]


def _trend(column: str) -> str:
    return f"coalesce(round(avg(coalesce({column}, 0.0)) * 100, 1), 0.0)"


ORACLES = {
    "list_files": f"WITH {FILES} SELECT id::VARCHAR AS file_id, original_filename AS filename, file_size AS size, status, strftime(upload_timestamp, '%Y-%m-%d %H:%M:%S') AS upload_timestamp, "
    "coalesce(rows, 0)::INT AS rows, coalesce(column_count, 0)::INT AS column_count FROM files",
    "list_results": f"WITH {RESULTS} SELECT result_id, {_LABEL('Unknown')} AS method, {r('coalesce(privacy_score, 0)', 10)} AS privacy_score, {r('coalesce(utility_score, 0)', 10)} AS utility_score, status, "
    "strftime(created_timestamp, '%Y-%m-%d %H:%M:%S') AS created_timestamp FROM results",
    "metrics_summary": f"WITH {RESULTS} SELECT count(*) AS total_anonymizations, {r('avg(coalesce(privacy_score, 0.0))')} AS average_privacy_score, {r('avg(coalesce(utility_score, 0.0))')} AS average_utility_score, "
    f"{r('sum(epsilon_used)')} AS epsilon_used, {r('sum(delta_used)')} AS delta_used, {r('avg(CASE WHEN privacy_score > 0.7 THEN 1.0 ELSE 0.0 END)')} AS compliance_rate {_DONE}",
    "risk_distribution": f"WITH {RESULTS} SELECT {_LEVEL} AS risk_level, count(*) AS n {_DONE} GROUP BY 1",
    "summary_recommendations": f"WITH {RESULTS}, f AS (SELECT avg(coalesce(privacy_score, 0.0)) AS p, avg(coalesce(utility_score, 0.0)) AS u, avg(CASE WHEN {_LEVEL} IN ('CRITICAL', 'HIGH') THEN 1.0 ELSE 0.0 END) AS h {_DONE}), "
    "m AS (SELECT 'Overall privacy protection is below recommended levels' AS recommendation FROM f WHERE p < 0.5 UNION ALL SELECT 'Data utility preservation could be improved' FROM f WHERE u < 0.5 "
    "UNION ALL SELECT 'High proportion of results have elevated privacy risks' FROM f WHERE h > 0.3 UNION ALL SELECT 'Excellent balance between privacy and utility achieved' FROM f WHERE p > 0.8 AND u > 0.8) "
    "SELECT * FROM m UNION ALL SELECT 'Privacy metrics are within acceptable ranges' WHERE NOT EXISTS (SELECT 1 FROM m)",
    "budget_usage": f"WITH {RESULTS}, t AS (SELECT sum(epsilon_used) AS e, sum(delta_used) AS d {_DONE}) SELECT 'default' AS session_id, {r('e')} AS epsilon_used, {r('d')} AS delta_used, "
    f"{r('greatest(0.0, 20000.0::DOUBLE - e)')} AS epsilon_remaining, {r('greatest(0.0, 1.0::DOUBLE - d)')} AS delta_remaining, {r('least(100.0, e / 20000.0::DOUBLE * 100)')} AS epsilon_percent, {r('least(100.0, d * 100)')} AS delta_percent FROM t",
    "privacy_utility_trend": f"WITH {RESULTS} SELECT 'Week ' || (i + 1) AS week, {_trend('privacy_score')} AS privacy_score, {_trend('utility_score')} AS utility_score FROM range(4) w(i) LEFT JOIN "
    "(SELECT * FROM results WHERE status = 'completed') s ON created_timestamp >= TIMESTAMP '2001-06-27' + to_days((i * 7)::INT) AND created_timestamp < TIMESTAMP '2001-06-27' + to_days((i * 7 + 7)::INT) GROUP BY i",
    "methods_distribution": f"WITH {RESULTS} SELECT {_LABEL('UNKNOWN')} AS method, count(*) AS n {_DONE} GROUP BY 1",
    "risk_protection_chart": f"WITH {RESULTS} SELECT "
    + ", ".join(
        f"round((1.0::DOUBLE - avg(coalesce(nullif({e}, 0), {d}))) * 100, 1) AS {n}"
        for n, e, d in (("linkage", "CASE WHEN l_linenumber <> 3 THEN l_discount END", 0.9), ("membership", "l_tax", 0.85), ("attribute", "l_quantity / 100.0::DOUBLE", 0.88))
    )
    + " FROM lineitem JOIN results ON l_orderkey = id WHERE status = 'completed'",
    "performance_trend": f"WITH {RESULTS} SELECT strftime(TIMESTAMP '2001-07-24' + to_hours((i * 4)::INT), '%Y-%m-%d %H:%M') AS window_start, coalesce(round(avg(execution_time), 2), 0.0) AS average_time FROM range(6) w(i) LEFT JOIN "
    "(SELECT * FROM results WHERE status = 'completed') s ON created_timestamp >= TIMESTAMP '2001-07-24' + to_hours((i * 4)::INT) AND created_timestamp < TIMESTAMP '2001-07-24' + to_hours((i * 4 + 4)::INT) GROUP BY i",
    "risk_level": f"WITH {RESULTS} SELECT id, {_LEVEL} AS risk_level FROM results",
    "compliance_flags": f"WITH {RESULTS} SELECT id, {_FLAGS} FROM results",
    "assess_risk": f"WITH {FILES}, {RESULTS}, a AS (SELECT 'result_' || id AS data_id, reidentification_risk, overall_risk_score, epsilon_used, k_value FROM results UNION ALL "
    "SELECT 'file_' || id, 1.0, 1.0, 0.0, 0 FROM files WHERE id NOT IN (SELECT original_file_id FROM results)) "
    f"SELECT data_id, {r('1.0::DOUBLE - coalesce(reidentification_risk, 1.0)', 10)} AS privacy_score, {_LEVEL} AS risk_level, {_FLAGS}, coalesce(nullif(concat_ws('; ', "
    + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in _NOTES) + "), ''), 'Privacy protection appears adequate for current threat model') AS recommendations FROM a",
    "cascade_delete": "WITH x AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey = 3), y AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM x)) "
    "SELECT 'files' AS \"table\", count(*) AS rows FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'results', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT id FROM y) UNION ALL "
    "SELECT 'assessments', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM y)",
}
