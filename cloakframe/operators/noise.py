"""Per-cell differential-privacy mechanisms.

Every row is perturbed by itself, as a column expression with keyed randomness.
The default sensitivity is the widest column range read from the data, which is
not a formal guarantee; ``bounds`` clips each column to a stated range and uses
that range, and ``split='columns'`` divides epsilon over the columns.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schema as roles
from ..functions.binning import equal_width_index
from ..functions.randomness import laplace, normal, uniform
from . import domains
from .stats import numeric_summary

MECHANISMS = ("gaussian", "laplace", "exponential")


def global_sensitivity(df: DataFrame, columns: Sequence[str] | None = None) -> float:
    """Largest numeric range; a categorical column counts 1; no columns gives 1."""
    columns = list(columns if columns is not None else df.columns)
    numbers = [c for c in roles.numeric_columns(df) if c in columns]
    found = [s["max"] - s["min"] for s in numeric_summary(df, numbers).values() if s["min"] is not None]
    found += [1.0] * (len(columns) - len(numbers))
    return float(max(found)) if found else 1.0


def gaussian_sigma(epsilon: float, delta: float, sensitivity: float) -> float:
    """sqrt(2 ln(1.25/delta)) * sensitivity / epsilon; proven for epsilon below 1."""
    if epsilon >= 1:
        warnings.warn("the Gaussian noise formula is proven only for epsilon < 1", stacklevel=2)
    return math.sqrt(2 * math.log(1.25 / delta)) * sensitivity / epsilon


def _clipped(name: str, bounds: dict[str, tuple[float, float]] | None) -> Column:
    value = F.col(name).cast("double")
    if bounds and name in bounds:
        low, high = bounds[name]
        return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))))
    return value


def _budget_per_column(epsilon: float, columns: Sequence[str], split: str | None) -> float:
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    if split not in (None, "columns"):
        raise ValueError("split must be None or 'columns'")
    return epsilon / max(1, len(columns)) if split == "columns" else epsilon


def randomized_response(
    df: DataFrame,
    column: str,
    epsilon: float,
    key: Sequence[str],
    salt: str,
    domain: list | None = None,
    max_array: int = domains.MAX_ARRAY,
) -> DataFrame:
    """Keep a value with probability e^eps / (e^eps + k - 1), else draw one of the other k - 1 evenly.

    ``domain`` supplies the values (needed for streams); otherwise the distinct
    values are read from the column, a null counting as one of them.
    """
    fitted = None if domain is not None else domains.fit_domain(df, column, max_array)
    values = list(domain) if domain is not None else fitted.values
    k = len(values) if domain is not None else fitted.k
    if k <= 1:
        return df
    # one projection of its own, so that the digest behind both draws is computed once per cell
    stay = uniform(salt, f"rr:{column}", key, 0) < F.lit(math.exp(epsilon) / (math.exp(epsilon) + k - 1))
    pick = F.floor(uniform(salt, f"rr:{column}", key, 1) * F.lit(k - 1)).cast("bigint")
    drawn = df.withColumn("_rr", F.struct(stay.alias("keep"), pick.alias("drawn")))
    keep, number = F.col("_rr.keep"), F.col("_rr.drawn")
    if values is None:
        target = number + (number >= F.col("_own")).cast("bigint")
        return domains.flip_large(drawn, column, fitted, target, keep, "_own").select(*df.columns)
    own = F.coalesce(domains.position(values, F.col(column)), F.lit(len(values)))
    new = domains.pick(values, number + (number >= own).cast("int"))
    return drawn.withColumn(column, F.when(keep, F.col(column)).otherwise(new)).select(*df.columns)


def _noisy(df, columns, epsilon, key, salt, bounds, split, noise_for, domains_for):
    columns = list(columns if columns is not None else [c for c in df.columns if c not in key])
    each = _budget_per_column(epsilon, columns, split)
    numbers = [c for c in roles.numeric_columns(df) if c in columns]
    out = df.withColumns({c: noise_for(c, each) for c in numbers}) if numbers else df
    for c in columns:
        if c not in numbers:
            out = randomized_response(out, c, each, key, salt, (domains_for or {}).get(c))
    return out


def _column_sensitivity(name: str, bounds: dict | None, shared: float) -> float:
    return float(bounds[name][1] - bounds[name][0]) if bounds and name in bounds else shared


def gaussian_mechanism(
    df: DataFrame,
    epsilon: float,
    delta: float,
    key: Sequence[str],
    salt: str,
    sensitivity: float | None = None,
    columns: Sequence[str] | None = None,
    bounds: dict[str, tuple[float, float]] | None = None,
    split: str | None = None,
    domains_for: dict[str, list] | None = None,
) -> DataFrame:
    """Numbers get N(0, sigma) noise, categories randomized response."""
    chosen = list(columns if columns is not None else [c for c in df.columns if c not in key])
    shared = sensitivity if sensitivity is not None else global_sensitivity(df, chosen)

    def noise_for(c: str, eps: float) -> Column:
        sigma = gaussian_sigma(eps, delta, _column_sensitivity(c, bounds, shared))
        return _clipped(c, bounds) + normal(salt, f"gauss:{c}", key) * F.lit(sigma)

    return _noisy(df, chosen, epsilon, key, salt, bounds, split, noise_for, domains_for)


def laplace_mechanism(
    df: DataFrame,
    epsilon: float,
    key: Sequence[str],
    salt: str,
    sensitivity: float | None = None,
    columns: Sequence[str] | None = None,
    bounds: dict[str, tuple[float, float]] | None = None,
    split: str | None = None,
    domains_for: dict[str, list] | None = None,
) -> DataFrame:
    """Numbers get Laplace(0, sensitivity / epsilon) noise, categories randomized response."""
    chosen = list(columns if columns is not None else [c for c in df.columns if c not in key])
    shared = sensitivity if sensitivity is not None else global_sensitivity(df, chosen)

    def noise_for(c: str, eps: float) -> Column:
        return _clipped(c, bounds) + laplace(salt, f"lap:{c}", key, _column_sensitivity(c, bounds, shared) / eps)

    return _noisy(df, chosen, epsilon, key, salt, bounds, split, noise_for, domains_for)


_UNIT = float(1 << 60)  # whole-number weight of the most frequent value


def _exponential_weights(counts: list[int], epsilon: float, sensitivity: float) -> list[int]:
    """exp(eps * count / (2 * sensitivity)) in parts of the largest one, so that it cannot overflow."""
    top = max(counts)
    return [math.floor(math.exp(epsilon / (2 * sensitivity) * (n - top)) * _UNIT) for n in counts]


def exponential_mechanism(
    df: DataFrame,
    column: str,
    epsilon: float,
    key: Sequence[str],
    salt: str,
    sensitivity: float = 1.0,
    max_array: int = domains.MAX_ARRAY,
) -> DataFrame:
    """Replace each cell by a draw with P(v) proportional to exp(eps * count(v) / (2 * sensitivity))."""
    fitted = domains.fit_domain(df, column, max_array)
    if fitted.k == 0:
        return df
    u = uniform(salt, f"exp:{column}", key)
    if fitted.values is not None:
        # the null, if any, is one more value; its frequency counts as 0
        counts = fitted.counts + ([0] if fitted.nulls else [])
        weights = _exponential_weights(counts, epsilon, sensitivity)
        return df.withColumn(column, domains.draw_small(fitted.values + ([None] if fitted.nulls else []), weights, u))
    top = fitted.table.agg(F.max("n").alias("m")).first()["m"]
    counted = fitted.table.select("value", "n")
    if fitted.nulls:
        counted = counted.unionByName(df.sparkSession.range(1).select(F.lit(None).cast(counted.schema["value"].dataType).alias("value"), F.lit(0).cast("bigint").alias("n")))
    weight = F.floor(F.exp(F.lit(epsilon / (2 * sensitivity)) * (F.col("n") - F.lit(top))) * F.lit(_UNIT))
    table, k = domains.alias_table(counted.select("value", weight.alias("w")))
    return domains.draw_alias(df, column, table, k, u).select(*df.columns)


def exponential_numeric(
    df: DataFrame, column: str, epsilon: float, key: Sequence[str], salt: str, sensitivity: float = 1.0, bins: int = 10
) -> DataFrame:
    """Cut into ten equal-width bins, then draw a bin index 0..9 by its frequency."""
    s = numeric_summary(df, [column])[column]
    binned = df.withColumn(column, equal_width_index(F.col(column), s["min"], s["max"], bins))
    return exponential_mechanism(binned, column, epsilon, key, salt, sensitivity)


def apply_dp(
    df: DataFrame,
    epsilon: float,
    delta: float,
    key: Sequence[str],
    salt: str,
    mechanism: str = "gaussian",
    sensitivity: float | None = None,
    columns: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """Perturb every column except the row key with the named mechanism."""
    name = mechanism.lower()
    if name not in MECHANISMS:
        raise ValueError(f"no such noise mechanism: {mechanism}")
    if name == "gaussian":
        return gaussian_mechanism(df, epsilon, delta, key, salt, sensitivity, columns, **options)
    if name == "laplace":
        return laplace_mechanism(df, epsilon, key, salt, sensitivity, columns, **options)
    chosen = list(columns if columns is not None else [c for c in df.columns if c not in key])
    shared = sensitivity if sensitivity is not None else global_sensitivity(df, chosen)
    out = df
    for c in chosen:
        draw = exponential_numeric if c in roles.numeric_columns(df) else exponential_mechanism
        out = draw(out, c, epsilon, key, salt, shared)
    return out
