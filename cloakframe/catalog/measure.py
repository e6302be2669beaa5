"""Privacy and utility metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import measures as ops
from ..plans.anonymize import anonymize as run_anonymize
from ..plans.anonymize import result_table
from .base import SALT, key_mod_null, r, rounded, sql_mod_null, table
from .synthetic import NUMBERS, PAIR, TEXTS, part_pair, sql_ks, sql_moments, sql_shares


def _gappy_part(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", key_mod_null("p_brand", "p_partkey", 11).alias("p_brand"), "p_type", "p_size", "p_retailprice"
    )


GAPPY_PART = f"SELECT p_partkey, {sql_mod_null('p_brand', 'p_partkey', 11)} AS p_brand, p_type, p_size, p_retailprice FROM part"


def profile(spark, sf):
    return ops.profile(_gappy_part(spark, sf))


def detect_quasi_identifiers(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("Education_level"), F.col("o_totalprice").alias("price"))
    return ops.detect_quasi_identifiers(df)


def k_anonymity(spark, sf):
    return rounded(ops.k_anonymity(_gappy_part(spark, sf), ["p_brand", "p_type"]))


def k_anonymity_with_nulls(spark, sf):
    return rounded(ops.k_anonymity(_gappy_part(spark, sf), ["p_brand", "p_type"], nulls="group"))


def uniqueness_risk(spark, sf):
    return rounded(ops.uniqueness_risk(_gappy_part(spark, sf), ["p_brand", "p_type", "p_size"]))


def reidentification_risk(spark, sf):
    return rounded(ops.reidentification_risk(*part_pair(spark, sf)))


def privacy_metrics(spark, sf):
    return rounded(ops.privacy_metrics(*part_pair(spark, sf), 1.5, 1e-5))


def statistical_similarity(spark, sf):
    return rounded(ops.statistical_similarity(*part_pair(spark, sf)))


def correlation_preservation(spark, sf):
    return rounded(ops.correlation_preservation(*part_pair(spark, sf)))


def ks_statistic(spark, sf):
    return rounded(ops.ks_statistic(*part_pair(spark, sf), NUMBERS))


def distribution_similarity(spark, sf):
    return rounded(ops.distribution_similarity(*part_pair(spark, sf)))


def data_completeness(spark, sf):
    return rounded(ops.data_completeness(_gappy_part(spark, sf)))


def utility_metrics(spark, sf):
    return rounded(ops.utility_metrics(*part_pair(spark, sf)))


def anonymize(spark, sf):
    """Protect customers by noise and disclosure control, then measure privacy and utility and run every attack."""
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    out = run_anonymize(df, "dp_sdc", "c_custkey", SALT, 0.9, 1e-5, ["c_nationkey", "c_mktsegment"], ["c_acctbal"])
    return rounded(result_table(out))


QUERIES = {
    f.__name__: f
    for f in (
        profile, detect_quasi_identifiers, k_anonymity, k_anonymity_with_nulls, uniqueness_risk, reidentification_risk, privacy_metrics,
        statistical_similarity, correlation_preservation, ks_statistic, distribution_similarity, data_completeness, utility_metrics, anonymize,
    )
}

_COLUMNS = [*NUMBERS, *TEXTS]
_distinct = lambda t: "(SELECT (" + " + ".join(f"count(DISTINCT {c})" for c in _COLUMNS) + f") / 5.0::DOUBLE / count(*) FROM {t})"
_REID = f"least(1.0::DOUBLE, {_distinct('d')} / {_distinct('o')})"
_KINDS = {"p_partkey": "int64", "p_brand": "object", "p_type": "object", "p_size": "int64", "p_retailprice": "float64"}
_STAT = "((" + " + ".join([sql_moments(c, True) for c in NUMBERS] + [f"(SELECT sum(least(p, q)) FROM {sql_shares(c)})" for c in TEXTS]) + ") / 5.0::DOUBLE)"
_PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]
_CELLS = " UNION ALL ".join(
    [f"SELECT 2 AS w, (SELECT corr({a}::DOUBLE, {b}::DOUBLE) FROM o) AS x, (SELECT corr({a}::DOUBLE, {b}::DOUBLE) FROM d) AS y" for a, b in _PAIRS]
    + ["SELECT 1, 1.0, 1.0"] * len(NUMBERS)
)
_CORR = f"(SELECT greatest(0.0::DOUBLE, 1.0::DOUBLE - sqrt(sum(w * (x - y) * (x - y))) / (sqrt(sum(w * x * x)) + 1e-8::DOUBLE)) FROM ({_CELLS}))"
_DIST = "((" + " + ".join(f"(1.0::DOUBLE - {sql_ks(c)})" for c in NUMBERS) + ") / 3.0::DOUBLE)"
_FULL = "(SELECT 1.0::DOUBLE - (" + " + ".join(f"count(*) - count({c})" for c in _COLUMNS) + ") / (count(*) * 5.0::DOUBLE) FROM d)"
_clamp = lambda e: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {e}))"
_K = (
    "SELECT min(n)::BIGINT AS k_value, count(*) AS total_groups, " + r("avg(n)") + " AS avg_group_size, "
    "count(*) FILTER (n < 5) AS groups_below_5 FROM (SELECT count(*) AS n FROM g {where} GROUP BY p_brand, p_type)"
)

ORACLES = {
    "profile": f"WITH g AS ({GAPPY_PART}), c AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS type, count(*) AS rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\" FROM g" for c, k in _KINDS.items()
    )
    + ') SELECT *, "distinct" / rows::DOUBLE > 0.1 AND "distinct" / rows::DOUBLE < 0.9 AS quasi_identifier FROM c',
    "detect_quasi_identifiers": "SELECT c AS \"column\" FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'price']) AS c, "
    "unnest([count(DISTINCT o_orderkey), count(DISTINCT o_custkey), count(DISTINCT o_totalprice)]) / count(*)::DOUBLE AS s FROM orders) WHERE s > 0.1 AND s < 0.9 UNION ALL SELECT 'Education_level'",
    "k_anonymity": f"WITH g AS ({GAPPY_PART}) " + _K.format(where="WHERE p_brand IS NOT NULL AND p_type IS NOT NULL"),
    "k_anonymity_with_nulls": f"WITH g AS ({GAPPY_PART}) " + _K.format(where=""),
    "uniqueness_risk": f"WITH g AS ({GAPPY_PART}) SELECT {r('count(*) FILTER (n = 1) / (SELECT count(*) FROM g)::DOUBLE')} AS uniqueness_risk "
    "FROM (SELECT count(*) AS n FROM g WHERE p_brand IS NOT NULL GROUP BY p_brand, p_type, p_size)",
    "reidentification_risk": f"WITH {PAIR} SELECT {r(_REID)} AS re_identification_risk",
    "privacy_metrics": f"WITH {PAIR} SELECT 1.5::DOUBLE AS epsilon_used, {r('1e-5')} AS delta_used, 8.5::DOUBLE AS privacy_budget_remaining, "
    f"{r('(SELECT count(*) FROM d) / (SELECT count(*) FROM o)::DOUBLE')} AS data_reduction_ratio, 1.0::DOUBLE AS column_preservation_ratio, {r(_REID)} AS re_identification_risk",
    "statistical_similarity": f"WITH {PAIR} SELECT {r(_STAT)} AS statistical_similarity",
    "correlation_preservation": f"WITH {PAIR} SELECT {r(_CORR)} AS correlation_preservation",
    "ks_statistic": f"WITH {PAIR} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {r(sql_ks(c))} AS ks" for c in NUMBERS),
    "distribution_similarity": f"WITH {PAIR} SELECT {r(_DIST)} AS distribution_similarity",
    "data_completeness": f"WITH g AS ({GAPPY_PART}) SELECT {r('1.0::DOUBLE - (count(*) - count(p_brand)) / (count(*) * 5.0::DOUBLE)')} AS data_completeness FROM g",
    "utility_metrics": f"WITH {PAIR} SELECT {r(_STAT)} AS statistical_similarity, {r(_CORR)} AS correlation_preservation, {r(_DIST)} AS distribution_similarity, "
    f"{r(_FULL)} AS data_completeness, " + r("((" + " + ".join(_clamp(e) for e in (_STAT, _CORR, _DIST, _FULL)) + ") / 4.0::DOUBLE)") + " AS overall_utility_score",
}
