"""Privacy and utility measurements of a table, or of an (original, derived) pair."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schema as roles
from ..functions.scoring import clamp01, mean_of
from .budget import MAX_EPSILON
from .disclosure import generalize_numeric
from .gram import wide_correlations
from .ranking import prefix_sums
from .stats import correlation, distinct_table, no_null, null_count, stacked

# Column-name parts that mark a likely quasi-identifier.
QI_NAMES = ["age", "zip", "postal", "income", "education", "occupation"]

NON_ZERO = 1e-8
PAIRS_AT_ONCE = 15


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: type, rows, nulls, distinct non-null values, likely quasi-identifier."""
    facts = distinct_table(df, {c: F.col(c) for c in df.columns}, approx)
    kinds = {f.name: roles.role_name(f.dataType) for f in df.schema}
    typed = facts.select(
        F.col("name").alias("column"), F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("name")).alias("type"),
        "rows", "missing", "distinct",
    )
    share = F.try_divide(F.col("distinct").cast("double"), F.col("rows"))
    named = F.lower("column").rlike("|".join(QI_NAMES))
    return typed.withColumn("quasi_identifier", F.coalesce((share > 0.1) & (share < 0.9), F.lit(False)) | named)


def detect_quasi_identifiers(df: DataFrame, approx: bool = False) -> DataFrame:
    return profile(df, approx).filter("quasi_identifier").select("column")


def group_sizes(df: DataFrame, quasi_identifiers: Sequence[str], nulls: str = "drop") -> DataFrame:
    rows = df if nulls == "group" else df.filter(no_null(quasi_identifiers))
    return rows.groupBy(*quasi_identifiers).agg(F.count(F.lit(1)).alias("n"))


def k_anonymity(df: DataFrame, quasi_identifiers: Sequence[str], nulls: str = "drop") -> DataFrame:
    """Smallest group, number of groups, mean size, groups below 5."""
    if not quasi_identifiers:
        return df.agg(
            F.lit(float("inf")).alias("k_value"), F.lit(0).cast("bigint").alias("total_groups"),
            F.lit(None).cast("double").alias("avg_group_size"), F.lit(0).cast("bigint").alias("groups_below_5"),
        )
    return group_sizes(df, quasi_identifiers, nulls).agg(
        F.min("n").alias("k_value"),
        F.count(F.lit(1)).alias("total_groups"),
        F.avg("n").alias("avg_group_size"),
        F.count_if(F.col("n") < 5).alias("groups_below_5"),
    )


def uniqueness_risk(df: DataFrame, quasi_identifiers: Sequence[str]) -> DataFrame:
    """Share of all rows that are alone in their group; a row with a null never is."""
    full = no_null(quasi_identifiers)
    sizes = df.groupBy(*quasi_identifiers).agg(F.count(F.lit(1)).alias("n"))
    alone = F.sum(F.when(full & (F.col("n") == 1), 1).otherwise(0))
    return sizes.agg(F.coalesce(F.try_divide(alone.cast("double"), F.sum("n")), F.lit(0.0)).alias("uniqueness_risk"))


def pair_rows(original: DataFrame, derived: DataFrame) -> DataFrame:
    """Union of two one-row frames of the same columns as ``(side, ...)``."""
    return original.withColumn("side", F.lit("o")).unionByName(derived.withColumn("side", F.lit("d")))


def _side(side: str, c: Column) -> Column:
    return F.max(F.when(F.col("side") == side, c))


def _distinct_share(df: DataFrame, approx: bool) -> DataFrame:
    facts = distinct_table(df, {c: F.col(c) for c in df.columns}, approx).agg(F.sum("distinct").alias("_d"), F.max("rows").alias("_rows"))
    mean = F.col("_d").cast("double") / F.lit(float(len(df.columns)))
    return facts.select(
        F.try_divide(mean, F.col("_rows")).alias("share"), F.col("_rows").alias("rows"), F.lit(len(df.columns)).alias("columns")
    )


def privacy_metrics(
    original: DataFrame, derived: DataFrame, epsilon: float = 0.0, delta: float = 0.0, approx: bool = False
) -> DataFrame:
    """Re-identification risk, budget and retention ratios in one row."""
    both = pair_rows(_distinct_share(original, approx), _distinct_share(derived, approx))
    o, d = _side("o", F.col("share")), _side("d", F.col("share"))
    return both.agg(
        F.lit(float(epsilon)).alias("epsilon_used"),
        F.lit(float(delta)).alias("delta_used"),
        F.lit(max(0.0, MAX_EPSILON - epsilon)).alias("privacy_budget_remaining"),
        F.try_divide(_side("d", F.col("rows")).cast("double"), _side("o", F.col("rows"))).alias("data_reduction_ratio"),
        (_side("d", F.col("columns")).cast("double") / _side("o", F.col("columns"))).alias("column_preservation_ratio"),
        F.when(o > 0, F.least(F.lit(1.0), d / o)).otherwise(F.lit(0.0)).alias("re_identification_risk"),
    )


def reidentification_risk(original: DataFrame, derived: DataFrame, approx: bool = False) -> DataFrame:
    return privacy_metrics(original, derived, approx=approx).select("re_identification_risk")


# ---- distributions -----------------------------------------------------------------


def comparable(original: DataFrame, derived: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """Original with type-changed numbers binned like the derived table; numeric and categorical common columns."""
    common = [c for c in original.columns if c in derived.columns]
    numeric = [c for c in roles.numeric_columns(original) if c in common]
    changed = [c for c in numeric if c not in roles.numeric_columns(derived)]
    if changed:
        original = generalize_numeric(original, changed)
        numeric = [c for c in numeric if c not in changed]
    return original, numeric, [c for c in common if c not in numeric]


def paired_counts(original: DataFrame, derived: DataFrame, columns: Sequence[str], cast: str = "string") -> DataFrame:
    """``(column, value, n_o, n_d)``: the value union of both sides, each counted before the shuffle."""
    left = stacked(original, columns, cast).withColumn("is_o", F.lit(1))
    right = stacked(derived, columns, cast).withColumn("is_o", F.lit(0))
    both = left.unionByName(right).filter(F.col("value").isNotNull())
    return both.groupBy("column", "value").agg(
        F.sum(F.col("is_o").cast("bigint")).alias("n_o"), F.sum((1 - F.col("is_o")).cast("bigint")).alias("n_d")
    )


def with_shares(counts: DataFrame) -> DataFrame:
    """Add ``p`` and ``q``; the joined totals hold one row per column."""
    totals = counts.groupBy("column").agg(F.sum("n_o").alias("t_o"), F.sum("n_d").alias("t_d"))
    joined = counts.join(F.broadcast(totals), "column")
    share = lambda n, t: F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(t)), F.lit(0.0))
    return joined.withColumn("p", share("n_o", "t_o")).withColumn("q", share("n_d", "t_d"))


def category_overlap(original: DataFrame, derived: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, similarity)``: sum of min(p, q)."""
    shares = with_shares(paired_counts(original, derived, columns))
    return shares.groupBy("column").agg(F.sum(F.least("p", "q")).alias("similarity"))


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"_a{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(F.col(c).cast("double")).alias(f"_s{i}") for i, c in enumerate(columns)],
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"_a{i}").alias("mean"), F.col(f"_s{i}").alias("std")) for i, c in enumerate(columns)]
    return wide.select(F.inline(F.array(*rows)))


def moment_similarity(original: DataFrame, derived: DataFrame, columns: Sequence[str], clamp: bool) -> DataFrame:
    """``(column, similarity)``: mean of 1 - relative difference of mean and of sample deviation."""
    sides = pair_rows(_moments(original, columns), _moments(derived, columns)).groupBy("column").agg(
        *[_side(s, F.col(m)).alias(f"{m}_{s}") for s in "od" for m in ("mean", "std")]
    )

    def close(m: str) -> Column:
        a, b = F.col(f"{m}_o"), F.col(f"{m}_d")
        v = F.lit(1.0) - F.abs(a - b) / (F.abs(a) + F.lit(NON_ZERO))
        return clamp01(v) if clamp else v

    return sides.select("column", ((close("mean") + close("std")) / F.lit(2.0)).alias("similarity"))


def _mean_similarity(parts: list[DataFrame], name: str, empty: float) -> DataFrame | None:
    if not parts:
        return None
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.agg(F.coalesce(F.avg("similarity"), F.lit(empty)).alias(name))


def _constant(df: DataFrame, name: str, value: float) -> DataFrame:
    return df.agg(F.lit(value).alias(name))


def statistical_similarity_by_column(original: DataFrame, derived: DataFrame) -> list[DataFrame]:
    base, numeric, categorical = comparable(original, derived)
    parts = [moment_similarity(base, derived, numeric, clamp=True)] if numeric else []
    return parts + ([category_overlap(base, derived, categorical)] if categorical else [])


def statistical_similarity(original: DataFrame, derived: DataFrame) -> DataFrame:
    parts = statistical_similarity_by_column(original, derived)
    return _mean_similarity(parts, "statistical_similarity", 0.0) or _constant(original, "statistical_similarity", 0.0)


# ---- correlation -------------------------------------------------------------------


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col_a, col_b, corr)`` for all pairs a < b, pairwise complete, in one scan.

    Up to ``PAIRS_AT_ONCE`` pairs are one generated aggregate; more are blocked products.
    """
    pairs = list(combinations(columns, 2))
    if len(pairs) > PAIRS_AT_ONCE:
        return wide_correlations(df, columns)
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns}

    wide = df.agg(*[correlation(value[a], value[b]).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"_r{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return wide.select(F.inline(F.array(*rows)))


def _varies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = df.agg(*[(F.min(c) < F.max(c)).alias(f"_v{i}") for i, c in enumerate(columns)])
    rows = [
        F.struct(
            F.lit(c).alias("col_a"), F.lit(c).alias("col_b"),
            F.when(F.col(f"_v{i}"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("corr"),
        )
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def correlation_preservation(original: DataFrame, derived: DataFrame) -> DataFrame:
    """1 - |C_o - C_d| / (|C_o| + 1e-8) in the Frobenius norm, not below 0."""
    name = "correlation_preservation"
    columns = [c for c in roles.numeric_columns(original) if c in roles.numeric_columns(derived)]
    if len(columns) < 2:
        return _constant(original, name, 1.0)
    sides = pair_rows(
        correlations(original, columns).unionByName(_varies(original, columns)),
        correlations(derived, columns).unionByName(_varies(derived, columns)),
    )
    cells = sides.groupBy("col_a", "col_b").agg(
        *[F.coalesce(_side(s, F.col("corr")), F.lit(0.0)).alias(s) for s in "od"]
    )
    # an off-diagonal cell stands for two matrix entries
    weight = F.when(F.col("col_a") == F.col("col_b"), F.lit(1.0)).otherwise(F.lit(2.0))
    diff = F.sqrt(F.sum(weight * (F.col("o") - F.col("d")) * (F.col("o") - F.col("d"))))
    norm = F.sqrt(F.sum(weight * F.col("o") * F.col("o")))
    return cells.agg(F.greatest(F.lit(0.0), F.lit(1.0) - diff / (norm + F.lit(NON_ZERO))).alias(name))


# ---- Kolmogorov-Smirnov ------------------------------------------------------------


def ks_statistic(original: DataFrame, derived: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, ks)``: two-sample sup|F1 - F2|, all columns in one pass over counted values."""
    counted = paired_counts(original, derived, columns, "double").filter(~F.isnan("value"))
    running = prefix_sums(counted, "value", {"c_o": "n_o", "c_d": "n_d"}, ["column"])
    totals = running.groupBy("column").agg(F.max("c_o").alias("t_o"), F.max("c_d").alias("t_d"))
    gap = F.abs(F.try_divide(F.col("c_o").cast("double"), F.col("t_o")) - F.try_divide(F.col("c_d").cast("double"), F.col("t_d")))
    return running.join(F.broadcast(totals), "column").groupBy("column").agg(F.max(gap).alias("ks"))


def distribution_similarity_by_column(original: DataFrame, derived: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, similarity)`` = 1 - KS; a column with an empty side counts 0.5."""
    ks = ks_statistic(original, derived, columns)
    listed = original.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return listed.join(ks, "column", "left").select(
        "column", F.coalesce(F.lit(1.0) - F.col("ks"), F.lit(0.5)).alias("similarity")
    )


def distribution_similarity(original: DataFrame, derived: DataFrame) -> DataFrame:
    name = "distribution_similarity"
    columns = [c for c in roles.numeric_columns(original) if c in roles.numeric_columns(derived)]
    if not columns:
        return _constant(original, name, 1.0)
    return _mean_similarity([distribution_similarity_by_column(original, derived, columns)], name, 1.0)


def data_completeness(df: DataFrame) -> DataFrame:
    """1 - null cells / all cells."""
    nulls = sum((null_count(c) for c in df.columns), F.lit(0))
    cells = F.count(F.lit(1)) * len(df.columns)
    return df.agg((F.lit(1.0) - F.try_divide(nulls.cast("double"), cells)).alias("data_completeness"))


def utility_metrics(original: DataFrame, derived: DataFrame) -> DataFrame:
    """The four utility measures and the mean of their clamped values, in one row."""
    parts = [
        statistical_similarity(original, derived),
        correlation_preservation(original, derived),
        distribution_similarity(original, derived),
        data_completeness(derived),
    ]
    rows = None
    for p in parts:
        one = p.select(F.lit(p.columns[0]).alias("metric"), F.col(p.columns[0]).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    names = [p.columns[0] for p in parts]
    wide = rows.agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])
    return wide.withColumn("overall_utility_score", clamp01(mean_of([clamp01(F.col(n)) for n in names])))

