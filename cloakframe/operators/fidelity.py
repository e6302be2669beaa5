"""Quality of a synthetic table against its original."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schema as roles
from .columns import fit_scale
from .measures import (
    _constant,
    _mean_similarity,
    _side,
    correlations,
    distribution_similarity_by_column,
    moment_similarity,
    pair_rows,
    paired_counts,
    with_shares,
)
from .neighbors import nearest
from .quantiles import mode_table
from .stats import correlation

NUDGE = 1e-10


def _common(original: DataFrame, synthetic: DataFrame) -> tuple[list[str], list[str]]:
    common = [c for c in original.columns if c in synthetic.columns]
    numeric = [c for c in roles.numeric_columns(original) if c in common]
    return numeric, [c for c in common if c not in numeric]


def correlation_of_correlations(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Pearson r between the upper triangles; no pairs gives 1, an undefined r gives 0."""
    name = "correlation_of_correlations"
    columns = [c for c in roles.numeric_columns(original) if c in roles.numeric_columns(synthetic)]
    if len(columns) < 2:
        return _constant(original, name, 1.0)
    sides = pair_rows(correlations(original, columns), correlations(synthetic, columns))
    cells = sides.groupBy("col_a", "col_b").agg(*[_side(s, F.col("corr")).alias(s) for s in "od"])
    undefined = F.max((F.col("o").isNull() | F.col("d").isNull()).cast("int")) == 1
    r = F.nanvl(correlation("o", "d"), F.lit(0.0))
    return cells.agg(F.when(undefined, F.lit(0.0)).otherwise(F.coalesce(r, F.lit(0.0))).alias(name))


def js_divergence(original: DataFrame, synthetic: DataFrame, columns: Sequence[str], base: float | None = None) -> DataFrame:
    """``(column, divergence)`` over the union of values, each share nudged by 1e-10; natural log unless ``base``."""
    p, q = F.col("p") + F.lit(NUDGE), F.col("q") + F.lit(NUDGE)
    m = (p + q) * F.lit(0.5)
    terms = F.lit(0.5) * (p * F.ln(p / m) + q * F.ln(q / m))
    scale = 1.0 if base is None else 1.0 / math.log(base)
    shares = with_shares(paired_counts(original, synthetic, columns))
    return shares.groupBy("column").agg((F.sum(terms) * F.lit(scale)).alias("divergence"))


def distribution_fidelity(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Mean of 1 - KS over numbers and 1 - JSD over categories."""
    numeric, categorical = _common(original, synthetic)
    parts = [distribution_similarity_by_column(original, synthetic, numeric)] if numeric else []
    if categorical:
        jsd = js_divergence(original, synthetic, categorical)
        parts.append(jsd.select("column", (F.lit(1.0) - F.col("divergence")).alias("similarity")))
    return _mean_similarity(parts, "distribution_fidelity", 0.0) or _constant(original, "distribution_fidelity", 0.0)


def statistic_fidelity(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Numbers: unclamped mean and deviation closeness; categories: same mode or not."""
    numeric, categorical = _common(original, synthetic)
    parts = [moment_similarity(original, synthetic, numeric, clamp=False)] if numeric else []
    if categorical:
        sides = pair_rows(mode_table(original, categorical), mode_table(synthetic, categorical))
        both = sides.groupBy("column").agg(*[_side(s, F.col("mode")).alias(s) for s in "od"])
        parts.append(both.select("column", F.when(F.col("o") == F.col("d"), 1.0).otherwise(0.0).alias("similarity")))
    return _mean_similarity(parts, "statistic_fidelity", 0.0) or _constant(original, "statistic_fidelity", 0.0)


def _vector(df: DataFrame, scale, columns: Sequence[str]) -> Column:
    return F.array(*[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(scale.mean[c])) / F.lit(scale.std[c]) for c in columns])


def _scaled_pair(original: DataFrame, synthetic: DataFrame, o_key: str, s_key: str):
    """Both tables as (id, z-scored vector), scaled on the original with nulls as 0."""
    columns = [c for c in roles.numeric_columns(original, {o_key}) if c in roles.numeric_columns(synthetic, {s_key})]
    scale = fit_scale(original.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]), columns)
    refs = original.select(F.col(o_key).alias("rid"), _vector(original, scale, columns).alias("vec"))
    points = synthetic.select(F.col(s_key).alias("qid"), _vector(synthetic, scale, columns).alias("vec"))
    return columns, refs, points


def dcr(original: DataFrame, synthetic: DataFrame, o_key: str, s_key: str) -> DataFrame:
    """Mean distance of a synthetic row to its closest original, over sqrt(number of columns)."""
    columns, refs, points = _scaled_pair(original, synthetic, o_key, s_key)
    if not columns:
        return _constant(original, "dcr", 1.0)
    return nearest(points, refs).agg((F.avg("distance") / F.lit(math.sqrt(len(columns)))).alias("dcr"))


def nndr(original: DataFrame, synthetic: DataFrame, o_key: str, s_key: str, sample: int | None = None) -> DataFrame:
    """Mean ratio of the distance to the nearest original and to the nearest other synthetic row.

    Every row counts; ``sample`` restricts the measure to that many smallest keys.
    """
    columns, refs, points = _scaled_pair(original, synthetic, o_key, s_key)
    if not columns:
        return _constant(original, "nndr", 1.0)
    asked = points if sample is None else points.orderBy("qid").limit(sample)
    to_original = nearest(asked, refs).select("qid", F.col("distance").alias("d_o"))
    others = points.select(F.col("qid").alias("rid"), "vec")
    to_other = nearest(asked, others, others_only=True).select("qid", F.col("distance").alias("d_s"))
    ratio = F.col("d_o") / (F.col("d_s") + F.lit(1e-8))
    return to_original.join(to_other, "qid").agg(F.avg(ratio).alias("nndr"))


def synthetic_quality(original: DataFrame, synthetic: DataFrame, o_key: str, s_key: str, nndr_sample: int | None = None) -> DataFrame:
    """All synthetic-data measures in one row; ``privacy_score`` is the mean of DCR and NNDR."""
    o, s = original.drop(o_key), synthetic.drop(s_key)
    parts = [
        correlation_of_correlations(o, s),
        distribution_fidelity(o, s),
        statistic_fidelity(o, s),
        dcr(original, synthetic, o_key, s_key),
        nndr(original, synthetic, o_key, s_key, nndr_sample),
    ]
    names = [p.columns[0] for p in parts]
    rows = None
    for n, p in zip(names, parts):
        one = p.select(F.lit(n).alias("metric"), F.col(n).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    wide = rows.agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])
    return wide.withColumn("privacy_score", (F.col("dcr") + F.col("nndr")) / F.lit(2.0))
