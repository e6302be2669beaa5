"""Row-level scores as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_of(parts: Sequence[Column]) -> Column:
    """Left-to-right mean of non-null columns."""
    return reduce(lambda a, b: a + b, parts) / F.lit(float(len(parts)))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def numeric_distance(a: Column, b: Column) -> Column:
    """|a-b| / max(|a|, |b|, 1e-8); a missing side counts as fully different."""
    x, y = a.cast("double"), b.cast("double")
    ratio = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1e-8))
    return F.coalesce(ratio, F.lit(1.0))


def category_distance(a: Column, b: Column) -> Column:
    """0 when equal, otherwise 1; null equals nothing."""
    return F.when(a == b, F.lit(0.0)).otherwise(F.lit(1.0))


def record_distance(numeric: Sequence[tuple[Column, Column]], categorical: Sequence[tuple[Column, Column]]) -> Column:
    parts = [numeric_distance(a, b) for a, b in numeric] + [category_distance(a, b) for a, b in categorical]
    return mean_of(parts) if parts else F.lit(1.0)


def record_similarity(numeric: Sequence[tuple[Column, Column]], categorical: Sequence[tuple[Column, Column]]) -> Column:
    parts = [F.lit(1.0) - numeric_distance(a, b) for a, b in numeric]
    parts += [F.lit(1.0) - category_distance(a, b) for a, b in categorical]
    return mean_of(parts) if parts else F.lit(0.0)


def advantage_level(value: Column, high: float, medium: float) -> Column:
    return F.when(value > high, "high").when(value > medium, "medium").otherwise("low")


def level_tenths(level: Column) -> Column:
    """What one attack's risk level counts for in the overall risk, in tenths (whole, so sums are exact)."""
    return F.when(level == "high", F.lit(8)).when(level == "low", F.lit(2)).otherwise(F.lit(5))


def risk_level(reidentification: Column, attack: Column) -> Column:
    """Named level of the mean of the two risks; a missing risk counts as 0.5."""
    mean = (F.coalesce(reidentification, F.lit(0.5)) + F.coalesce(attack, F.lit(0.5))) / F.lit(2.0)
    return (
        F.when(mean >= 0.8, "CRITICAL")
        .when(mean >= 0.6, "HIGH")
        .when(mean >= 0.4, "MEDIUM")
        .when(mean >= 0.2, "LOW")
        .otherwise("MINIMAL")
    )


def compliance_flags(epsilon: Column, k_value: Column) -> dict[str, Column]:
    eps, k = F.coalesce(epsilon, F.lit(0.0)), F.coalesce(k_value, F.lit(0))
    return {
        "gdpr_compliant": eps <= 1.0,
        "hipaa_suitable": eps <= 0.5,
        "differential_privacy": eps > 0,
        "k_anonymity": k >= 5,
        "overall_compliant": (eps <= 1.0) & (k >= 5),
    }


def privacy_score(reid: Column, linkage: Column, membership: Column, attribute: Column, overall: Column) -> Column:
    """Mean risk over the five parts, 0 = best."""
    defaults = [(reid, 0.5), (linkage, 0.5), (membership, 0.0), (attribute, 0.0), (overall, 0.5)]
    return clamp01(mean_of([F.coalesce(c, F.lit(d)) for c, d in defaults]))


def utility_score(parts: Sequence[Column]) -> Column:
    return clamp01(mean_of([F.coalesce(c, F.lit(0.5)) for c in parts]))


def objective(privacy: Column, utility: Column, privacy_weight: float, utility_weight: float) -> Column:
    return F.lit(float(privacy_weight)) * privacy + F.lit(float(utility_weight)) * (F.lit(1.0) - utility)


def messages(*rules: tuple[Column, str]) -> Column:
    """Array of the messages whose condition holds, in rule order."""
    fired = F.array(*[F.when(cond, F.lit(text)) for cond, text in rules])
    return F.filter(fired, lambda m: m.isNotNull())
