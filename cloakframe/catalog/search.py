"""Parameter search: scores per trial and reports per search. Each customer's orders stand for one search's trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import search as ops
from ..plans.optimize import optimize as run_search
from .base import SALT, r, rounded, table


def _measured(spark, sf):
    """Trial measurements derived from orders."""
    price, day = F.col("o_totalprice") / 500_000.0, F.dayofyear("o_orderdate") / 366.0
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("search"), F.col("o_orderkey").alias("iteration"), price.alias("reid"),
        F.when(F.col("o_orderkey") % 4 != 0, price * 0.5).alias("linkage"), (price - 0.5).alias("membership"),
        F.when(F.col("o_orderkey") % 3 != 0, price * 0.3).alias("attribute"), (day * 0.8).alias("overall"),
        day.alias("u1"), (F.lit(1.0) - day).alias("u2"), price.alias("u3"), F.when(F.col("o_orderkey") % 5 != 0, day).alias("u4"),
        (day * day).alias("u5"),
    )


MEASURED = (
    "SELECT o_custkey AS search, o_orderkey AS iteration, p AS reid, CASE WHEN o_orderkey % 4 <> 0 THEN p * 0.5::DOUBLE END AS linkage, p - 0.5::DOUBLE AS membership, "
    "CASE WHEN o_orderkey % 3 <> 0 THEN p * 0.3::DOUBLE END AS attribute, y * 0.8::DOUBLE AS overall, y AS u1, 1.0::DOUBLE - y AS u2, p AS u3, "
    "CASE WHEN o_orderkey % 5 <> 0 THEN y END AS u4, y * y AS u5 FROM (SELECT *, o_totalprice / 500000.0::DOUBLE AS p, dayofyear(o_orderdate) / 366.0::DOUBLE AS y FROM orders)"
)
_PRIVACY = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, (coalesce(reid, 0.5) + coalesce(linkage, 0.5) + coalesce(membership, 0.0) + coalesce(attribute, 0.0) + coalesce(overall, 0.5)) / 5.0::DOUBLE))"
_UTILITY = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, (coalesce(u1, 0.5) + coalesce(u2, 0.5) + coalesce(u3, 0.5) + coalesce(u4, 0.5) + coalesce(u5, 0.5)) / 5.0::DOUBLE))"
HISTORY = (
    f"h AS MATERIALIZED (SELECT search, iteration, p AS privacy_score, u AS utility_score, 0.6::DOUBLE * p + 0.4::DOUBLE * (1.0::DOUBLE - u) AS objective_score, u1 AS epsilon, reid AS delta "
    f"FROM (SELECT *, {_PRIVACY} AS p, {_UTILITY} AS u FROM ({MEASURED})))"
)


def _history(spark, sf):
    rows = _measured(spark, sf)
    privacy = scoring.privacy_score(*[F.col(c) for c in ("reid", "linkage", "membership", "attribute", "overall")])
    utility = scoring.utility_score([F.col(f"u{i}") for i in range(1, 6)])
    scored = rows.select("search", "iteration", privacy.alias("privacy_score"), utility.alias("utility_score"), F.col("u1").alias("epsilon"), F.col("reid").alias("delta"))
    return scored.withColumn("objective_score", scoring.objective(F.col("privacy_score"), F.col("utility_score"), 0.6, 0.4))


def privacy_score(spark, sf):
    return rounded(_history(spark, sf).select("iteration", "privacy_score"))


def utility_score(spark, sf):
    return rounded(_history(spark, sf).select("iteration", "utility_score"))


def objective(spark, sf):
    return rounded(_history(spark, sf).select("iteration", "objective_score"))


def convergence_rate(spark, sf):
    return rounded(ops.convergence_rate(_history(spark, sf), ["search"]))


def parameter_sensitivity(spark, sf):
    return rounded(ops.parameter_sensitivity(_history(spark, sf), ["epsilon", "delta"], ["search"]))


def optimization_report(spark, sf):
    return rounded(ops.optimization_report(_history(spark, sf), ["search"]))


def optimize(spark, sf):
    """Every trial of the grid, each protecting, measuring and attacking the suppliers."""
    df = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    found = run_search(df, "dp_sdc", "s_suppkey", SALT, ["s_nationkey"], ["s_acctbal"], "low")
    return rounded(found.history.drop("parameters"))


QUERIES = {f.__name__: f for f in (privacy_score, utility_score, objective, convergence_rate, parameter_sensitivity, optimization_report, optimize)}

_RULES = [
    ("first - b.objective_score < 0.01", "Consider expanding search space or increasing iterations"),
    ("p > 0.7", "Consider stronger privacy protection methods"),
    ("p < 0.3", "Current privacy protection is strong - consider relaxing for better utility"),
    ("u < 0.5", "Utility preservation is low - consider adjusting anonymization parameters"),
]
_SENSITIVE = lambda p: f"coalesce(CASE WHEN isnan(corr({p}, objective_score)) THEN 0.0 ELSE abs(corr({p}, objective_score)) END, 0.0)"

ORACLES = {
    "privacy_score": f"SELECT iteration, {r(_PRIVACY)} AS privacy_score FROM ({MEASURED})",
    "utility_score": f"SELECT iteration, {r(_UTILITY)} AS utility_score FROM ({MEASURED})",
    "objective": f"WITH {HISTORY} SELECT iteration, {r('objective_score')} AS objective_score FROM h",
    "convergence_rate": f"WITH {HISTORY}, b AS (SELECT search, objective_score AS s, min(objective_score) OVER (PARTITION BY search ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM h) "
    f"SELECT search, {r('coalesce(avg(CASE WHEN s < best THEN (best - s) / best WHEN best IS NOT NULL THEN 0.0 END), 0.0)')} AS convergence_rate FROM b GROUP BY 1",
    "parameter_sensitivity": f"WITH {HISTORY} SELECT search, 'epsilon' AS parameter, {r(_SENSITIVE('epsilon'))} AS sensitivity FROM h GROUP BY 1 HAVING count(*) >= 10 UNION ALL "
    f"SELECT search, 'delta', {r(_SENSITIVE('delta'))} FROM h GROUP BY 1 HAVING count(*) >= 10",
    "optimization_report": f"WITH {HISTORY}, a AS (SELECT search, count(*) AS n, avg(privacy_score) AS p, avg(utility_score) AS u, arg_min(objective_score, iteration) AS first, "
    "min({'objective_score': objective_score, 'iteration': iteration, 'privacy_score': privacy_score, 'utility_score': utility_score}) AS b FROM h GROUP BY 1) "
    f"SELECT search, n AS total_iterations, b.iteration AS best_iteration, {r('b.objective_score')} AS best_objective_score, {r('b.privacy_score')} AS best_privacy_score, "
    f"{r('b.utility_score')} AS best_utility_score, {r('first - b.objective_score')} AS final_improvement, coalesce(nullif(concat_ws('; ', "
    + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in _RULES) + "), ''), 'Optimization results look good') AS recommendations FROM a",
}
