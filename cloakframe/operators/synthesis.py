"""Synthetic tables from fitted marginals, or from a Gaussian copula."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import schema as roles
from ..functions.randomness import normal, uniform
from . import domains
from .columns import datetime_to_epoch, impute
from .joins import lookup
from .ranking import prefix_sums
from .stats import correlation, numeric_summary, value_counts

ROW = "row_id"


def prepare(df: DataFrame) -> DataFrame:
    """Fill nulls, turn timestamps into epoch seconds, everything non-numeric into text."""
    filled = impute(datetime_to_epoch(df) if roles.temporal_columns(df) else df)
    return filled.withColumns({c: F.col(c).cast("string") for c in roles.categorical_columns(filled)})


@dataclass(frozen=True)
class Marginals:
    columns: list[str]
    schema: T.StructType
    numeric: dict[str, dict]
    categorical: dict[str, domains.Domain]
    rows: int


def fit_marginals(df: DataFrame, columns: Sequence[str] | None = None) -> Marginals:
    """Mean, deviation and range of numbers; value frequencies (non-null) of the rest."""
    columns = list(columns or df.columns)
    chosen = df.select(*columns)
    numeric = numeric_summary(chosen, roles.numeric_columns(chosen), ("mean", "std", "min", "max"))
    categorical = {c: domains.fit_domain(chosen, c) for c in roles.categorical_columns(chosen)}
    return Marginals(columns, chosen.schema, numeric, categorical, df.count())


def marginal_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The fit as a table ``(column, value, mean, std, min, max, share)``: one row per number, one per category value."""
    columns = list(columns or df.columns)
    chosen = df.select(*columns)
    numbers, texts = roles.numeric_columns(chosen), roles.categorical_columns(chosen)
    aggregates, rows = [], []
    for i, c in enumerate(numbers):
        v = F.col(c).cast("double")
        aggregates += [F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
        rows.append(
            F.struct(
                F.lit(c).alias("column"), F.lit(None).cast("string").alias("value"), F.col(f"a{i}").alias("mean"),
                F.col(f"s{i}").alias("std"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max"),
                F.lit(None).cast("double").alias("share"),
            )
        )
    parts = [chosen.agg(*aggregates).select(F.inline(F.array(*rows)))] if numbers else []
    if texts:
        counted = value_counts(chosen, texts)
        totals = counted.groupBy("column").agg(F.sum("n").alias("t"))
        none = F.lit(None).cast("double")
        parts.append(
            counted.join(F.broadcast(totals), "column").select(
                "column", "value", none.alias("mean"), none.alias("std"), none.alias("min"), none.alias("max"),
                (F.col("n").cast("double") / F.col("t")).alias("share"),
            )
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def sample_marginals(fit: Marginals, salt: str, spark, n: int | None = None, row_id: bool = False) -> DataFrame:
    """``n`` independent rows (default: as many as were fitted).

    Numbers are normal draws clipped to the observed range; categories follow
    their frequencies.
    """
    out = spark.range(n if n is not None else fit.rows).withColumnRenamed("id", ROW)
    for c, s in fit.numeric.items():
        if s["mean"] is None:
            out = out.withColumn(c, F.lit(None).cast("double"))
            continue
        drawn = F.lit(s["mean"]) + normal(salt, f"syn:{c}", [ROW]) * F.lit(s["std"] or 0.0)
        out = out.withColumn(c, F.greatest(F.lit(s["min"]), F.least(F.lit(s["max"]), drawn)))
    for c, d in fit.categorical.items():
        u = uniform(salt, f"syn:{c}", [ROW])
        if d.size == 0:
            out = out.withColumn(c, F.lit(None).cast(fit.schema[c].dataType))
        elif d.values is not None:
            out = out.withColumn(c, domains.draw_small(d.values, d.counts, u))
        else:
            table, k = domains.alias_table(d.table.select("value", F.col("n").alias("w")))
            out = domains.draw_alias(out, c, table, k, u)
    return out.select(*([ROW] if row_id else []), *fit.columns)


@dataclass(frozen=True)
class Copula:
    marginals: Marginals
    columns: list[str]
    factor: list[list[float]]
    inverse: DataFrame


def fit_gaussian_copula(df: DataFrame) -> Copula:
    """Normal scores of mid-ranks, their correlation matrix and its Cholesky factor (c x c, on the driver)."""
    numbers = roles.numeric_columns(df)
    counted = value_counts(df, numbers, "double")
    running = prefix_sums(counted, "value", {"cum": "n"}, ["column"])
    totals = running.groupBy("column").agg(F.max("cum").alias("t"), F.count(F.lit(1)).alias("k"))
    ranks = running.join(F.broadcast(totals), "column").withColumn(
        "mid", (F.col("cum") - F.col("n") / 2.0) / F.col("t").cast("double")
    )
    facts = {r["column"]: r for r in totals.collect()}
    scored = df.select(*[F.col(c).cast("double").alias(c) for c in numbers])
    for i, c in enumerate(numbers):
        one = ranks.filter(F.col("column") == c)
        table = one.select(F.col("value").alias(c), probit(F.col("mid")).alias(f"_z{i}"), "n")
        scored = lookup(scored, c, table, f"_z{i}", "n", facts[c]["t"], domains.MAX_BROADCAST, facts[c]["k"])
    pairs = [(i, j) for i in range(len(numbers)) for j in range(i)]
    row = scored.agg(*[correlation(f"_z{i}", f"_z{j}").alias(f"r{i}_{j}") for i, j in pairs], F.count(F.lit(1)).alias("n")).first()
    matrix = np.eye(len(numbers))
    for i, j in pairs:
        r = row[f"r{i}_{j}"]
        matrix[i, j] = matrix[j, i] = 0.0 if r is None or np.isnan(r) else r
    # lift the smallest eigenvalue, so that rounding cannot make the matrix indefinite
    values, vectors = np.linalg.eigh(matrix)
    factor = np.linalg.cholesky(vectors @ np.diag(np.maximum(values, 1e-10)) @ vectors.T + 1e-12 * np.eye(len(numbers)))
    inverse = running.select("column", "value", F.col("n").cast("double").alias("w"), F.col("cum").cast("double").alias("hi"))
    return Copula(fit_marginals(df), numbers, factor.tolist(), inverse)


def probit(p: Column) -> Column:
    """Standard normal quantile (rational approximation by Acklam, error below 1.2e-9)."""
    # The published coefficients of the approximation.
    a = [-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239]
    b = [-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1]
    c = [-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
    d = [7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416]

    def poly(coefficients: list[float], x: Column) -> Column:
        total = F.lit(coefficients[0])
        for k in coefficients[1:]:
            total = total * x + F.lit(k)
        return total

    low = 0.02425
    r = p - F.lit(0.5)
    middle = poly(a, r * r) * r / (poly(b, r * r) * r * r + F.lit(1.0))
    q_low, q_high = F.sqrt(F.lit(-2.0) * F.ln(p)), F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - p))
    tail = lambda q: poly(c, q) / (poly(d, q) * q + F.lit(1.0))
    return F.when(p < low, tail(q_low)).when(p > 1 - low, -tail(q_high)).otherwise(middle)


def normal_cdf(z: Column) -> Column:
    """Standard normal CDF (Abramowitz-Stegun 26.2.17, error below 7.5e-8)."""
    # The published coefficients of the approximation.
    k = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * F.abs(z))
    series = F.lit(0.0)
    for coefficient in reversed(k):
        series = (series + F.lit(coefficient)) * t
    upper = F.lit(0.3989422804014327) * F.exp(-z * z / F.lit(2.0)) * series
    return F.when(z >= 0, F.lit(1.0) - upper).otherwise(upper)


def sample_gaussian_copula(fit: Copula, salt: str, spark, n: int | None = None) -> DataFrame:
    """Rows with the fitted rank correlations; each number comes from its own empirical distribution."""
    base = sample_marginals(fit.marginals, salt, spark, n, row_id=True)
    out = base.select(ROW, *[c for c in fit.marginals.columns if c not in fit.columns])
    z = [normal(salt, f"cop:{c}", [ROW]) for c in fit.columns]
    for i, c in enumerate(fit.columns):
        mixed = sum((z[j] * F.lit(fit.factor[i][j]) for j in range(i + 1)), F.lit(0.0))
        out = out.withColumn(f"_u{i}", F.least(normal_cdf(mixed), F.lit(1.0 - 1e-16)))
    for i, c in enumerate(fit.columns):
        running = fit.inverse.filter(F.col("column") == c).select("value", "w", "hi")
        out = domains.draw_large(out, c, running, F.col(f"_u{i}"), max(1, fit.marginals.rows // 64))
    return out.select(*fit.marginals.columns)


def check_output(original: DataFrame, synthetic: DataFrame) -> list[str]:
    """Raise on different columns or order; list the columns whose kind changed."""
    if len(original.columns) != len(synthetic.columns):
        raise ValueError("the drawn table has more or fewer columns")
    if original.columns != synthetic.columns:
        raise ValueError("the drawn table names its columns otherwise")
    kinds = zip(original.schema, synthetic.schema)
    return [a.name for a, b in kinds if roles.is_numeric(a.dataType) != roles.is_numeric(b.dataType)]


def synthesize(df: DataFrame, salt: str, method: str = "marginals", num_samples: int | None = None) -> DataFrame:
    """Prepare, fit, sample, check. ``method`` is ``marginals`` or ``gaussian_copula``."""
    prepared = prepare(df)
    if method == "gaussian_copula" and len(roles.numeric_columns(prepared)) > 1:
        out = sample_gaussian_copula(fit_gaussian_copula(prepared), salt, df.sparkSession, num_samples)
    elif method in ("marginals", "gaussian_copula"):
        out = sample_marginals(fit_marginals(prepared), salt, df.sparkSession, num_samples)
    else:
        raise ValueError(f"Unknown method: {method}")
    check_output(prepared, out)
    return out
