"""Privacy-utility parameter search: grids, scores, and reports over a trial history."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.randomness import uniform
from .ranking import running_min_before
from .stats import correlation

SYNTHETIC_METHODS = ("sdg", "sdg_dp", "sdg_sdc", "full")
CONTROL_METHODS = ("sdc", "sdg_sdc", "dp_sdc", "full")

# Grid of each target level, and the defaults when no trial succeeds.
EPSILONS = {"low": [5.0, 7.0, 10.0], "medium": [1.0, 2.0, 3.0], "high": [0.1, 0.5, 1.0], "maximum": [0.01, 0.05, 0.1]}
DELTAS = [1e-5, 1e-6, 1e-7]
DEFAULTS = {
    "low": {"epsilon": 5.0, "delta": 1e-5},
    "medium": {"epsilon": 1.0, "delta": 1e-5},
    "high": {"epsilon": 0.5, "delta": 1e-6},
    "maximum": {"epsilon": 0.1, "delta": 1e-7},
}
# Ranges of the random search.
RANGES = {"epsilon": (0.01, 10.0), "delta": (1e-8, 1e-3), "k_anonymity": (3, 10), "suppression_threshold": (0.01, 0.1)}


def parameter_grid(method: str, level: str = "medium") -> list[dict[str, float]]:
    """Three epsilons times three deltas, plus the method's fixed parameters."""
    fixed: dict[str, float] = {}
    if method in SYNTHETIC_METHODS:
        fixed.update(synthetic_epochs=300, synthetic_batch_size=500)
    if method in CONTROL_METHODS:
        fixed.update(k_anonymity=5, suppression_threshold=0.05)
    epsilons = EPSILONS.get(level, EPSILONS["maximum"])
    return [{"epsilon": e, "delta": d, **fixed} for e, d in product(epsilons, DELTAS)]


def random_points(spark, method: str, n: int, salt: str) -> list[dict[str, float]]:
    """``n`` keyed random points over the search ranges; delta is log-uniform."""
    row = spark.range(n)
    u = {name: uniform(salt, f"search:{name}", ["id"]) for name in RANGES}
    low, high = RANGES["epsilon"]
    columns = {"epsilon": F.lit(low) + u["epsilon"] * F.lit(high - low)}
    low, high = RANGES["delta"]
    columns["delta"] = F.pow(F.lit(10.0), F.log10(F.lit(low)) + u["delta"] * (F.log10(F.lit(high)) - F.log10(F.lit(low))))
    if method in CONTROL_METHODS:
        low, high = RANGES["k_anonymity"]
        columns["k_anonymity"] = F.floor(F.lit(low) + u["k_anonymity"] * F.lit(high - low + 1)).cast("int")
        low, high = RANGES["suppression_threshold"]
        columns["suppression_threshold"] = F.lit(low) + u["suppression_threshold"] * F.lit(high - low)
    return [r.asDict() for r in row.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def default_parameters(level: str) -> dict[str, float]:
    return dict(DEFAULTS.get(level, DEFAULTS["maximum"]))


def _by(df: DataFrame, by: list[str]):
    return df.groupBy(*by) if by else df.groupBy()


def convergence_rate(history: DataFrame, by: list[str] | None = None, order: str = "iteration", score: str = "objective_score") -> DataFrame:
    """Mean relative improvement over the running best; 0 with fewer than two trials. One search per ``by`` group."""
    by = by or []
    ranked = running_min_before(history.select(*by, order, score), order, score, "_best", by)
    best = F.col("_best")
    gain = F.when(F.col(score) < best, (best - F.col(score)) / best).otherwise(F.when(best.isNotNull(), F.lit(0.0)))
    return _by(ranked.withColumn("_gain", gain), by).agg(F.coalesce(F.avg("_gain"), F.lit(0.0)).alias("convergence_rate"))


def parameter_sensitivity(history: DataFrame, parameters: list[str], by: list[str] | None = None, score: str = "objective_score", minimum: int = 10) -> DataFrame:
    """``(parameter, sensitivity)``: |corr| with the objective; groups with fewer than ten trials give nothing."""
    by = by or []
    wide = _by(history, by).agg(F.count(F.lit(1)).alias("_n"), *[correlation(p, score).alias(f"_r{i}") for i, p in enumerate(parameters)])
    value = lambda i: F.coalesce(F.nanvl(F.abs(F.col(f"_r{i}")), F.lit(0.0)), F.lit(0.0))
    cells = [F.struct(F.lit(p).alias("parameter"), value(i).alias("sensitivity")) for i, p in enumerate(parameters)]
    return wide.filter(F.col("_n") >= minimum).select(*by, F.inline(F.array(*cells)))


def optimization_report(history: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Best trial (first on ties), total gain and advice flags, per search."""
    by = by or []
    best = F.min(F.struct("objective_score", "iteration", "privacy_score", "utility_score"))
    first = F.min(F.struct("iteration", "objective_score"))
    out = _by(history, by).agg(
        F.count(F.lit(1)).alias("total_iterations"), best.alias("_b"), first.alias("_f"),
        F.avg("privacy_score").alias("_p"), F.avg("utility_score").alias("_u"),
    )
    gain = F.col("_f.objective_score") - F.col("_b.objective_score")
    # Advice at each threshold.
    rules = [
        (gain < 0.01, "Consider expanding search space or increasing iterations"),
        (F.col("_p") > 0.7, "Consider stronger privacy protection methods"),
        (F.col("_p") < 0.3, "Current privacy protection is strong - consider relaxing for better utility"),
        (F.col("_u") < 0.5, "Utility preservation is low - consider adjusting anonymization parameters"),
    ]
    fired = F.filter(F.array(*[F.when(cond, F.lit(text)) for cond, text in rules]), lambda m: m.isNotNull())
    advice = F.when(F.size(fired) > 0, fired).otherwise(F.array(F.lit("Optimization results look good")))
    return out.select(
        *by, "total_iterations",
        F.col("_b.iteration").alias("best_iteration"),
        F.col("_b.objective_score").alias("best_objective_score"),
        F.col("_b.privacy_score").alias("best_privacy_score"),
        F.col("_b.utility_score").alias("best_utility_score"),
        gain.alias("final_improvement"),
        F.array_join(advice, "; ").alias("recommendations"),
    )
