"""Differentially private logistic regression by gradient descent."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.randomness import normal, uniform


@dataclass(frozen=True)
class LogisticModel:
    features: list[str]
    weights: list[float]
    intercept: float

    def predict(self, df: DataFrame, name: str = "probability") -> DataFrame:
        score = F.lit(self.intercept)
        for c, w in zip(self.features, self.weights):
            score = score + F.col(c).cast("double") * F.lit(w)
        return df.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-score)))


ORDERS = [*range(2, 65), 80, 96, 128, 192, 256, 512]


def sampled_renyi(rate: float, sigma: float, order: int) -> float:
    """Renyi divergence of ``order`` (a whole number from 2) of one Gaussian release on a Poisson sample.

    log sum_k C(order, k) (1 - rate)^(order - k) rate^k exp(k (k - 1) / (2 sigma^2)), over order - 1.
    """
    if rate >= 1.0:
        return order / (2 * sigma**2)
    terms = [
        math.lgamma(order + 1) - math.lgamma(k + 1) - math.lgamma(order - k + 1) + (order - k) * math.log1p(-rate) + k * math.log(rate) + k * (k - 1) / (2 * sigma**2)
        for k in range(order + 1)
    ]
    top = max(terms)
    return max(0.0, top + math.log(sum(math.exp(t - top) for t in terms))) / (order - 1)


def spent_epsilon(sigma: float, rate: float, steps: int, delta: float) -> float:
    """Epsilon of ``steps`` releases at ``delta``: the best order of ``ORDERS``."""
    return min(steps * sampled_renyi(rate, sigma, a) + math.log(1 / delta) / (a - 1) for a in ORDERS)


def noise_multiplier(epsilon: float, delta: float, steps: int, rate: float = 1.0) -> float:
    """Least noise over clip so that ``steps`` Gaussian releases on samples of ``rate`` are together (epsilon, delta)-DP."""
    low, high = 0.0, 1.0
    while spent_epsilon(high, rate, steps, delta) > epsilon:
        low, high = high, high * 2
        if high > 1e9:
            raise ValueError(f"epsilon {epsilon} is out of reach at delta {delta}")
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if spent_epsilon(middle, rate, steps, delta) > epsilon else (low, middle)
    return high


def dp_logistic_fit(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    epsilon: float,
    delta: float,
    key: Sequence[str],
    salt: str,
    clip: float = 1.0,
    batch_size: int = 32,
    epochs: int = 10,
    learning_rate: float = 0.01,
    steps_per_epoch: int = 4,
) -> LogisticModel:
    """Per-row clipped gradients, summed by the cluster; noise is added once per step.

    A step takes a keyed sample holding at least ``batch_size`` rows in
    expectation (the larger of that and ``1 / steps_per_epoch`` of the table), so
    steps do not multiply with the table. Only c+1 sums reach the driver. Noise is
    keyed by (salt, step, weight), so a run is repeatable; the accountant is that of
    sampled Gaussian releases. Rows with a null feature or label add nothing; a
    table without rows gives noise alone. ``key`` must be unique for the sampling
    to be independent.
    """
    features = list(features)
    rows = df.count()
    rate = min(1.0, max(batch_size / max(rows, 1), 1.0 / steps_per_epoch))
    steps = epochs * steps_per_epoch
    sigma = noise_multiplier(epsilon, delta, steps, rate)
    weights = [0.0] * (len(features) + 1)
    inputs = [F.col(c).cast("double") for c in features] + [F.lit(1.0)]
    for step in range(steps):
        batch = df if rate >= 1.0 else df.filter(uniform(salt, f"step:{step}", key) < rate)
        score = F.lit(0.0)
        for x, w in zip(inputs, weights):
            score = score + x * F.lit(float(w))
        error = F.lit(1.0) / (F.lit(1.0) + F.exp(-score)) - F.col(label).cast("double")
        norm = F.sqrt(sum((x * x for x in inputs), F.lit(0.0))) * F.abs(error)
        shrink = F.least(F.lit(1.0), F.lit(clip) / F.greatest(norm, F.lit(1e-12)))
        noisy = [F.coalesce(F.sum(x * error * shrink), F.lit(0.0)) + normal(salt, f"noise:{step}", [F.lit(i)]) * F.lit(sigma * clip) for i, x in enumerate(inputs)]
        gradient = batch.agg(*[g.alias(f"g{i}") for i, g in enumerate(noisy)]).first()
        weights = [w - learning_rate * g / max(1.0, rate * rows) for w, g in zip(weights, gradient)]
    return LogisticModel(features, weights[:-1], weights[-1])
