"""Stateless protection of a stream: everything learned from data is supplied."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.columns import pseudonymize
from ..operators.noise import laplace_mechanism


def protect_stream(
    events: DataFrame,
    key: Sequence[str],
    salt: str,
    epsilon: float,
    identifiers: Sequence[str],
    bounds: dict[str, tuple[float, float]],
    domains: dict[str, list],
    buckets: int | None = 10_000,
) -> DataFrame:
    """Pseudonymize ``identifiers``; Laplace noise on bounded numbers; randomized response on given domains."""
    out = pseudonymize(events, identifiers, salt, buckets)
    return laplace_mechanism(
        out, epsilon, key, salt, sensitivity=1.0, columns=[*bounds, *domains], bounds=bounds, domains_for=domains
    )
