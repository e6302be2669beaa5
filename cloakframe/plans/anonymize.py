"""Protect a table by a named method and measure the result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.attacks import assess_attacks, overall_risk
from ..operators.disclosure import sdc
from ..operators.measures import k_anonymity, privacy_metrics, profile, uniqueness_risk, utility_metrics
from ..operators.noise import apply_dp
from ..operators.synthesis import ROW, fit_marginals, prepare, sample_marginals
from ..session import materialize

METHODS = ("sdg", "dp", "sdc", "sdg_dp", "sdg_sdc", "dp_sdc", "full")


def check_parameters(epsilon: float, delta: float, method: str) -> list[str]:
    """Raise on impossible parameters; returns warnings about weak ones."""
    if epsilon <= 0:
        raise ValueError("epsilon has to be above 0")
    if not 0 < delta < 1:
        raise ValueError("delta has to lie between 0 and 1")
    if method not in METHODS:
        raise ValueError(f"no such protection method: {method}")
    rules = [
        (epsilon > 10, "epsilon above 10 hides little"),
        (epsilon < 0.1, "epsilon below 0.1 drowns the data in noise"),
        (delta > 1e-3, "delta above 0.001 lets too many rows through"),
    ]
    return [text for hit, text in rules if hit]


def protect(
    df: DataFrame,
    method: str,
    key: str,
    salt: str,
    epsilon: float = 1.0,
    delta: float = 1e-5,
    quasi_identifiers: Sequence[str] = (),
    sensitive: Sequence[str] = (),
    k: int = 3,
    suppression_threshold: float = 0.05,
    mechanism: str = "gaussian",
) -> DataFrame:
    """The protected table. Steps of the name apply in order: sdg, then dp, then sdc; ``full`` is all three.

    A step that is followed by another is written once, because the next one reads it several times.
    """
    check_parameters(epsilon, delta, method)
    steps = ["sdg", "dp", "sdc"] if method == "full" else method.split("_")
    columns = [c for c in df.columns if c != key]
    out = df
    if "sdg" in steps:
        drawn = sample_marginals(fit_marginals(prepare(df.select(*columns))), salt, df.sparkSession, row_id=True)
        out = drawn.select(F.col(ROW).cast(df.schema[key].dataType).alias(key), *columns)
        out = materialize(out, "synthetic") if len(steps) > 1 else out
    if "dp" in steps:
        out = apply_dp(out, epsilon, delta, [key], salt, mechanism, columns=columns)
        out = materialize(out, "noisy") if "sdc" in steps else out
    if "sdc" in steps:
        out = sdc(out, quasi_identifiers, sensitive, [key], k, suppression_threshold)
    return out


@dataclass(frozen=True)
class Outcome:
    data: DataFrame
    profile: DataFrame
    k_anonymity: DataFrame | None
    uniqueness: DataFrame | None
    privacy: DataFrame
    utility: DataFrame
    attacks: DataFrame
    overall: DataFrame


def anonymize(
    df: DataFrame,
    method: str,
    key: str,
    salt: str,
    epsilon: float = 1.0,
    delta: float = 1e-5,
    quasi_identifiers: Sequence[str] = (),
    sensitive: Sequence[str] = (),
    attacks: Sequence[str] = ("linkage", "membership", "attribute"),
    trees: int = 100,
    **options,
) -> Outcome:
    """Profile, protect (written once), measure privacy and utility, run the attacks.

    ``key`` names the row and is left out of every measurement.
    """
    protected = protect(df, method, key, salt, epsilon, delta, quasi_identifiers, sensitive, **options)
    data = materialize(protected, "protected")
    plain, hidden = df.drop(key), data.drop(key)
    qi = [c for c in quasi_identifiers if c in df.columns]
    found = assess_attacks(df, data, plain.columns, key, salt, attacks, trees=trees)
    return Outcome(
        data, profile(plain),
        k_anonymity(plain, qi) if qi else None,
        uniqueness_risk(plain, qi) if qi else None,
        privacy_metrics(plain, hidden, epsilon, delta), utility_metrics(plain, hidden), found, overall_risk(found),
    )


def result_table(outcome: Outcome) -> DataFrame:
    """All measurements as ``(section, metric, value)``."""
    def long(section: str, frame: DataFrame) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in frame.columns]
        return frame.select(F.lit(section).alias("section"), F.inline(F.array(*cells)))

    out = long("privacy", outcome.privacy).unionByName(long("utility", outcome.utility)).unionByName(long("attacks", outcome.overall))
    scores = outcome.attacks.select(F.lit("attacks").alias("section"), F.col("attack_type").alias("metric"), F.col("score").alias("value"))
    out = out.unionByName(scores)
    for section, frame in (("profile", outcome.k_anonymity), ("profile", outcome.uniqueness)):
        if frame is not None:
            out = out.unionByName(long(section, frame))
    return out
