"""Validation findings and quality scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as ops
from .base import key_mod_null, r, rounded, sql_mod_null, table

RULES = {
    "required_columns": ["o_orderkey", "o_clerk"],
    "column_types": {"o_orderkey": "integer", "o_totalprice": "text", "o_orderdate": "datetime"},
    "constraints": {
        "o_totalprice": {"min_value": 5_000.0, "max_value": 450_000.0},
        "o_orderpriority": {"allowed_values": ["1-URGENT", "2-HIGH", "3-MEDIUM"]},
        "o_custkey": {"min_value": 0},
    },
}


def check_structure(spark, sf):
    few = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("Unnamed: 0")).agg(F.count(F.lit(1)).alias("n"))
    return ops.check_structure(few)


def infer_text_kind(spark, sf):
    df = table(spark, sf, "orders").select(
        F.concat(F.lit("$"), F.col("o_custkey"), F.lit(",000")).alias("money"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("day"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise(F.col("o_orderpriority")).alias("either"),
        "o_orderstatus",
    )
    return rounded(ops.infer_text_kind(df))


def _gappy(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("c_acctbal"),
        key_mod_null("c_mktsegment", "c_custkey", 4).alias("c_mktsegment"), F.lit("EU").alias("zone"),
    )


GAPPY = (
    "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS c_acctbal, "
    f"{sql_mod_null('c_mktsegment', 'c_custkey', 4)} AS c_mktsegment, 'EU' AS zone FROM customer"
)


def missing_columns(spark, sf):
    return rounded(ops.missing_columns(_gappy(spark, sf)))


def constant_columns(spark, sf):
    return ops.constant_columns(_gappy(spark, sf))


def high_cardinality_columns(spark, sf):
    return rounded(ops.high_cardinality_columns(_gappy(spark, sf)))


def _lines(spark, sf):
    q = key_mod_null("l_quantity", "l_partkey", 3).alias("l_quantity")
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey", q)


LINES = f"SELECT l_returnflag, l_linestatus, l_suppkey, {sql_mod_null('l_quantity', 'l_partkey', 3)} AS l_quantity FROM lineitem"


def duplicate_rows(spark, sf):
    return ops.duplicate_rows(_lines(spark, sf))


def detect_sensitive_columns(spark, sf):
    digits = F.lpad((F.col("c_custkey") % 10_000).cast("string"), 4, "0")
    df = table(spark, sf, "customer").select(
        "c_name", "c_mktsegment", F.concat(F.lit("user"), F.col("c_custkey"), F.lit("@example.com")).alias("contact"),
        F.concat(F.lit("(555) 123-"), digits).alias("line"), F.concat(F.lit("K-"), F.col("c_custkey")).alias("code"), "c_acctbal",
        F.col("c_nationkey").alias("customer_age"),
    )
    return ops.detect_sensitive_columns(df)


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "value", (F.col("value") * F.col("value") * F.col("value")).alias("cubed"))


EVENTS = "SELECT event_id, value, value * value * value AS cubed FROM events"


def zscore_outliers(spark, sf):
    return ops.zscore_outliers(_events(spark, sf), 2.0)


def skewed_columns(spark, sf):
    return rounded(ops.skewness(_events(spark, sf)))


def validate_schema(spark, sf):
    return ops.validate_schema(table(spark, sf, "orders"), RULES)


def violating_rows(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", key_mod_null("o_orderpriority", "o_orderkey", 10).alias("o_orderpriority"))
    return ops.violating_rows(df, "o_orderpriority", RULES["constraints"]["o_orderpriority"])


def validate_dataset(spark, sf):
    return rounded(ops.validate_dataset(_gappy(spark, sf), {"constraints": {"c_acctbal": {"min_value": 0.0}}}))


def validation_recommendations(spark, sf):
    return ops.validation_recommendations(ops.validate_dataset(_gappy(spark, sf)))


def completeness_score(spark, sf):
    return rounded(ops.completeness_score(_gappy(spark, sf)))


def quality_by_column(spark, sf):
    return rounded(ops.quality_by_column(_gappy(spark, sf)))


def uniqueness_score(spark, sf):
    return rounded(ops.uniqueness_score(_lines(spark, sf)))


def _mixed_case(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("priority"),
        "o_orderstatus", "o_totalprice",
    )


def casing_consistency(spark, sf):
    return rounded(ops.casing_consistency(_mixed_case(spark, sf)))


def casing_issues(spark, sf):
    return ops.casing_issues(_mixed_case(spark, sf))


def iqr_outliers(spark, sf):
    return ops.iqr_outliers(_events(spark, sf))


def quality_report(spark, sf):
    return rounded(ops.quality_report(_lines(spark, sf)))


def quality_recommendations(spark, sf):
    return ops.quality_recommendations(ops.quality_report(_lines(spark, sf)))


QUERIES = {
    f.__name__: f
    for f in (
        check_structure, infer_text_kind, missing_columns, constant_columns, high_cardinality_columns, duplicate_rows, detect_sensitive_columns,
        zscore_outliers, skewed_columns, validate_schema, violating_rows, validate_dataset, validation_recommendations, completeness_score,
        quality_by_column, uniqueness_score, casing_consistency, casing_issues, iqr_outliers, quality_report, quality_recommendations,
    )
}

_FINDING = "SELECT '{check}' AS \"check\", {column} AS \"column\", '{severity}' AS severity, ({value})::DOUBLE AS value"


def _find(check: str, column: str | None, severity: str, value: str, rest: str) -> str:
    named = "NULL::VARCHAR" if column is None else f"'{column}'"
    return _FINDING.format(check=check, column=named, severity=severity, value=value) + f" {rest}"


_EMAIL = r"'^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$'"
_CHECKS = ("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "zone")
_DUPES = f"(SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM ({LINES}) GROUP BY l_returnflag, l_linestatus, l_suppkey, l_quantity))"


def _sql_iqr(column: str, source: str) -> str:
    q = lambda p: f"(SELECT quantile_cont({column}::DOUBLE, {p}) FROM {source})"
    reach = f"1.5::DOUBLE * ({q(0.75)} - {q(0.25)})"
    return f"(SELECT count(*) FROM {source} WHERE {column} < {q(0.25)} - {reach} OR {column} > {q(0.75)} + {reach})"


_LINE_SCORES = (
    f"l AS MATERIALIZED ({LINES}), s AS (SELECT 1.0::DOUBLE - (count(*) - count(l_quantity)) / count(*)::DOUBLE / 4.0 AS completeness, "
    f"1.0::DOUBLE - {_DUPES} / count(*)::DOUBLE AS uniqueness, 1.0::DOUBLE AS consistency, "
    "1.0::DOUBLE - (" + " + ".join(f"CASE WHEN {_sql_iqr(c, 'l')} > count(*) * 0.05::DOUBLE THEN 1 ELSE 0 END" for c in ("l_suppkey", "l_quantity")) + ") / 4.0::DOUBLE AS validity FROM l)"
)
_SHARE = "SELECT '{c}' AS \"column\", count(DISTINCT {c}) / count(*)::DOUBLE AS s FROM g"
_VALIDATE = (
    f"g AS MATERIALIZED ({GAPPY}), f AS ("
    + " UNION ALL ".join(
        [
            _find("missing_values", "c_acctbal", "warning", r("(SELECT 1.0::DOUBLE - count(c_acctbal) / count(*)::DOUBLE FROM g)"), ""),
            _find("constant", "zone", "warning", "1", ""),
            *[
                _find("high_cardinality", c, "warning", r(f"(SELECT count(DISTINCT {c}) / count(*)::DOUBLE FROM g)"), f"WHERE (SELECT count(DISTINCT {c}) / count(*)::DOUBLE FROM g) > 0.95")
                for c in _CHECKS
            ],
            _find("sensitive:sensitive_keyword_in_name", "c_name", "warning", "1", ""),
            *[
                _find("outliers", c, "warning", "n", f"FROM (SELECT count(*) FILTER (abs(({c} - (SELECT avg({c}) FROM g)) / (SELECT stddev_samp({c}) FROM g)) > 3) AS n, count({c}) AS m FROM g) WHERE n > m * 0.05")
                for c in ("c_custkey", "c_acctbal")
            ],
        ]
    )
    + ")"
)
_ADVICE = [
    ("missing_values", "Consider handling missing values using imputation or removal"),
    ("outliers", "Investigate and handle outlier values"),
    ("sensitive:sensitive_keyword_in_name", "Review sensitive data columns and apply appropriate anonymization"),
    ("high_cardinality", "Consider grouping or binning high cardinality columns"),
]

ORACLES = {
    "check_structure": "WITH n AS (SELECT count(DISTINCT c_mktsegment) AS n FROM customer) "
    + _find("few_rows", None, "warning", "n", "FROM n WHERE n >= 2 AND n < 10") + " UNION ALL " + _find("unnamed_columns", None, "warning", "1", "FROM n"),
    "infer_text_kind": "SELECT 'money' AS \"column\", 1.0::DOUBLE AS numeric_share, 0.0::DOUBLE AS date_share, 'numeric' AS kind, false AS mixed UNION ALL "
    "SELECT 'day', 0.0, 1.0, 'datetime', false UNION ALL SELECT 'either', s, 0.0, CASE WHEN s > 0.8 THEN 'numeric' ELSE 'text' END, true FROM "
    f"(SELECT {r('count(*) FILTER (o_orderkey % 2 = 0) / count(*)::DOUBLE')} AS s FROM orders) UNION ALL SELECT 'o_orderstatus', 0.0, 0.0, 'text', false",
    "missing_columns": f"WITH g AS ({GAPPY}) SELECT \"column\", {r('s')} AS missing_ratio FROM (SELECT unnest(['c_custkey', 'c_name', 'c_acctbal', 'c_mktsegment']) AS \"column\", "
    "unnest([count(*) - count(c_custkey), count(*) - count(c_name), count(*) - count(c_acctbal), count(*) - count(c_mktsegment)]) / count(*)::DOUBLE AS s FROM g) WHERE s > 0.5",
    "constant_columns": f"WITH g AS ({GAPPY}) SELECT \"column\" FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n FROM g" for c in _CHECKS) + ") WHERE n <= 1",
    "high_cardinality_columns": f"WITH g AS ({GAPPY}) SELECT \"column\", {r('s')} AS distinct_ratio FROM (" + " UNION ALL ".join(_SHARE.format(c=c) for c in _CHECKS) + ") WHERE s > 0.95",
    "duplicate_rows": f"SELECT {_DUPES} AS duplicate_rows, count(*) AS rows FROM lineitem",
    "detect_sensitive_columns": "SELECT 'c_name' AS \"column\", 'sensitive_keyword_in_name' AS reason, 'high' AS confidence UNION ALL SELECT 'customer_age', 'sensitive_keyword_in_name', 'high' UNION ALL "
    f"SELECT 'contact', 'email_pattern', 'high' FROM customer HAVING count(*) FILTER (regexp_matches('user' || c_custkey || '@example.com', {_EMAIL})) > count(*) * 0.5 UNION ALL "
    "SELECT 'line', 'phone_pattern', 'high' UNION ALL SELECT 'code', 'potential_identifier', 'medium' FROM customer HAVING count(DISTINCT c_custkey) / count(*)::DOUBLE > 0.9",
    "zscore_outliers": f"WITH e AS ({EVENTS}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", n AS outliers, m AS rows, n > m * 0.05::DOUBLE AS reported FROM (SELECT count(*) FILTER (abs(({c} - (SELECT avg({c}) FROM e)) / (SELECT stddev_samp({c}) FROM e)) > 2.0) AS n, count({c}) AS m FROM e)"
        for c in ("event_id", "value", "cubed")
    ),
    "skewed_columns": f"WITH e AS ({EVENTS}) " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {r(f'skewness({c})')} AS skewness, abs(skewness({c})) > 2 AS reported FROM e" for c in ("event_id", "value", "cubed")),
    "validate_schema": _find("missing_required", "o_clerk", "error", "1", "") + " UNION ALL " + _find("type_mismatch", "o_totalprice", "warning", "1", "")
    + "".join(
        " UNION ALL " + _find(check, c, "error", "n", f"FROM (SELECT count(*) FILTER ({cond}) AS n FROM orders) WHERE n > 0")
        for check, c, cond in (
            ("below_minimum", "o_totalprice", "o_totalprice < 5000"), ("above_maximum", "o_totalprice", "o_totalprice > 450000"),
            ("not_allowed", "o_orderpriority", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')"), ("below_minimum", "o_custkey", "o_custkey < 0"),
        )
    ),
    "violating_rows": f"SELECT * FROM (SELECT o_orderkey, {sql_mod_null('o_orderpriority', 'o_orderkey', 10)} AS o_orderpriority FROM orders) WHERE coalesce(o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM'), true)",
    "validate_dataset": f"WITH {_VALIDATE} SELECT * FROM f UNION ALL " + _find("below_minimum", "c_acctbal", "error", "n", "FROM (SELECT count(*) AS n FROM g WHERE c_acctbal < 0) WHERE n > 0"),
    "validation_recommendations": f"WITH {_VALIDATE} " + " UNION ALL ".join(f"SELECT '{text}' AS recommendation WHERE EXISTS (SELECT 1 FROM f WHERE \"check\" = '{c}')" for c, text in _ADVICE),
    "completeness_score": f"WITH g AS ({GAPPY}) SELECT {r('1.0::DOUBLE - (' + ' + '.join(f'(count(*) - count({c})) / count(*)::DOUBLE' for c in _CHECKS) + ') / 5.0::DOUBLE')} AS completeness FROM g",
    "quality_by_column": f"WITH g AS ({GAPPY}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {r(f'(count(*) - count({c})) / count(*)::DOUBLE')} AS missing_ratio, {r(f'count(DISTINCT {c}) / count(*)::DOUBLE')} AS uniqueness_ratio FROM g" for c in _CHECKS),
    "uniqueness_score": f"SELECT {_DUPES} AS duplicate_rows, {r(f'1.0::DOUBLE - {_DUPES} / count(*)::DOUBLE')} AS uniqueness FROM lineitem",
    "casing_consistency": f"SELECT {r('1.0::DOUBLE - 1 / 4.0::DOUBLE')} AS consistency",
    "casing_issues": "SELECT 'priority' AS \"column\", count(DISTINCT p) AS \"distinct\", count(DISTINCT lower(p)) AS distinct_lower FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS p FROM orders)",
    "iqr_outliers": f"WITH e AS ({EVENTS}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {_sql_iqr(c, 'e')} AS outliers, (SELECT count(*) FROM e) AS rows, {_sql_iqr(c, 'e')} > (SELECT count(*) FROM e) * 0.05::DOUBLE AS reported" for c in ("event_id", "value", "cubed")
    ),
    "quality_report": f"WITH {_LINE_SCORES} SELECT {r('completeness')} AS completeness, {r('uniqueness')} AS uniqueness, {r('consistency')} AS consistency, {r('validity')} AS validity, "
    f"{r('(completeness + uniqueness + consistency + validity) / 4.0::DOUBLE')} AS overall_score FROM s",
    "quality_recommendations": f"WITH {_LINE_SCORES} SELECT 'Consider handling missing values before anonymization' AS recommendation FROM s WHERE completeness < 0.8 UNION ALL SELECT 'Remove duplicate rows' FROM s WHERE uniqueness < 1.0",
}
