"""Search over protection parameters: a few trials at a time, each one distributed."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from ..operators.search import default_parameters, parameter_grid, random_points
from ..session import scratch_root
from .anonymize import anonymize, check_parameters

# A trial is hundreds of short jobs, most of their time start-up: trials do not depend on each other, so their jobs interleave.
TRIALS_AT_ONCE = 4


@dataclass(frozen=True)
class Search:
    best: dict[str, float]
    history: DataFrame
    failures: list[str]


def _mean(values: Sequence[float]) -> float:
    return min(1.0, max(0.0, sum(values) / len(values)))


def optimize(
    df: DataFrame,
    method: str,
    key: str,
    salt: str,
    quasi_identifiers: Sequence[str] = (),
    sensitive: Sequence[str] = (),
    level: str = "medium",
    privacy_weight: float = 0.5,
    utility_weight: float = 0.5,
    max_iterations: int = 50,
    strategy: str = "grid",
    attacks: Sequence[str] = ("linkage", "membership", "attribute"),
    trees: int = 100,
) -> Search:
    """Evaluate at most ``max_iterations`` parameter sets and keep the smallest objective.

    Privacy is a risk (0 = best): mean of re-identification, attack scores and
    overall risk. Impossible parameters are skipped and listed; other errors are
    raised. ``TRIALS_AT_ONCE`` trials run side by side. Without any trial the level's defaults are returned.
    """
    spark = df.sparkSession
    points = parameter_grid(method, level) if strategy == "grid" else random_points(spark, method, max_iterations, salt)
    allowed, failures = [], []
    for i, p in enumerate(points[:max_iterations]):
        try:
            check_parameters(p["epsilon"], p["delta"], method)
        except ValueError as e:
            failures.append(f"{p}: {e}")
            continue
        allowed.append((i, p))

    def trial(i: int, p: dict[str, float]) -> tuple:
        out = anonymize(
            df, method, key, f"{salt}:{i}", p["epsilon"], p["delta"], quasi_identifiers, sensitive, attacks, trees,
            k=int(p.get("k_anonymity", 3)), suppression_threshold=p.get("suppression_threshold", 0.05),
        )
        risk = [out.privacy.first()["re_identification_risk"]]
        risk += [r["score"] for r in out.attacks.collect()]
        risk.append(out.overall.first()["overall_risk_score"])
        utility = [float(v) for v in out.utility.first()]
        privacy, useful = _mean(risk), _mean(utility)
        score = privacy_weight * privacy + utility_weight * (1.0 - useful)
        return (i, {k: float(v) for k, v in p.items()}, privacy, useful, score)

    scratch_root(spark)  # named once, before the threads ask for it
    with ThreadPoolExecutor(TRIALS_AT_ONCE) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(trial), i, p) for i, p in allowed]
        try:
            trials = [t.result() for t in started]
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise
    schema = "iteration int, parameters map<string,double>, privacy_score double, utility_score double, objective_score double"
    history = spark.createDataFrame(trials, schema)
    best = min(trials, key=lambda t: t[4])[1] if trials else default_parameters(level)
    return Search(best, history, failures)
