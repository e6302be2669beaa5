"""Statistical disclosure control: generalize, suppress, microaggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import schema as roles
from ..functions.binning import FIVE_LEVELS, equal_width_index, level_label
from .joins import anti_join_rare
from .ranking import global_rank
from .stats import no_null, numeric_summary, value_counts

OTHER = "Other"


def generalize_numeric(df: DataFrame, columns: Sequence[str], labels: Sequence[str] = tuple(FIVE_LEVELS)) -> DataFrame:
    """Replace numbers by one of five equal-width level labels."""
    summary = numeric_summary(df, columns)
    return df.withColumns(
        {
            c: level_label(equal_width_index(F.col(c), summary[c]["min"], summary[c]["max"], len(labels)), list(labels))
            for c in columns
        }
    )


def frequent_values(df: DataFrame, columns: Sequence[str], threshold: float) -> dict[str, list[str]]:
    """Values held by at least ``threshold`` of all rows: never more than ``1/threshold`` per column."""
    total = df.count()
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    kept = value_counts(df, columns).filter(F.col("n") >= F.lit(total * threshold)).collect()
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in kept:
        found[row["column"]].append(row["value"])
    return found


def generalize_categorical(df: DataFrame, columns: Sequence[str], threshold: float = 0.05) -> DataFrame:
    """Fold values rarer than ``threshold`` of all rows (nulls included) into ``Other``; null stays null."""
    kept = frequent_values(df, columns, threshold)
    return df.withColumns(
        {
            c: F.when(F.col(c).isNull(), None)
            .when(F.col(c).cast("string").isin(kept[c]) if kept[c] else F.lit(False), F.col(c).cast("string"))
            .otherwise(OTHER)
            for c in columns
        }
    )


def suppress_rare_combinations(
    df: DataFrame, quasi_identifiers: Sequence[str], k: int = 3, nulls: str = "keep"
) -> DataFrame:
    """Drop rows whose quasi-identifier combination occurs fewer than ``k`` times.

    A combination with a null is never equal to another, so its rows stay;
    ``nulls='group'`` treats null as a value of its own.
    """
    qi = list(quasi_identifiers)
    if not qi:
        return df
    base = df if nulls == "group" else df.filter(no_null(qi))
    counts = base.groupBy(*qi).agg(F.count(F.lit(1)).alias("_n"))
    total = df.count()
    return anti_join_rare(df, qi, counts, "_n", total, k, nulls == "group")


def microaggregate(
    df: DataFrame, column: str, key: Sequence[str], k: int = 3, merge_tail: bool = False
) -> DataFrame:
    """Sort by ``(column, key)``, cut into chunks of ``k``, replace each value by its chunk mean.

    The last chunk may be short; ``merge_tail`` joins it to the chunk before.
    Only the key and the value travel through the global sort.
    """
    key = list(key)
    slim = df.filter(F.col(column).isNotNull()).select(*key, F.col(column).cast("double").alias("_v"))
    ranked = global_rank(slim, ["_v", *key], "_rank")
    chunk = F.floor((F.col("_rank") - 1) / k)
    if merge_tail:
        n = slim.count()
        chunk = F.least(chunk, F.lit(max(0, n // k - 1)))
    # k (or fewer than 2k) rows per chunk: the window groups are tiny and even
    means = ranked.withColumn("_m", F.avg("_v").over(Window.partitionBy(chunk))).select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], "_m"
    )
    cond = F.lit(True)
    for i, c in enumerate(key):
        cond = cond & (df[c] == means[f"_k{i}"])
    joined = df.join(means, cond, "left").withColumn(column, F.col("_m"))
    return joined.select(*df.columns)


def sdc(
    df: DataFrame,
    quasi_identifiers: Sequence[str] = (),
    sensitive: Sequence[str] = (),
    key: Sequence[str] = (),
    k: int = 3,
    suppression_threshold: float = 0.05,
) -> DataFrame:
    """Generalize each quasi-identifier, suppress rare generalized combinations, microaggregate sensitive numbers."""
    qi = [c for c in quasi_identifiers if c in df.columns]
    numbers = [c for c in qi if c in roles.numeric_columns(df)]
    others = [c for c in qi if c not in numbers]
    out = generalize_numeric(df, numbers) if numbers else df
    out = generalize_categorical(out, others, suppression_threshold) if others else out
    out = suppress_rare_combinations(out, qi, k)
    for c in sensitive:
        if c in out.columns and c in roles.numeric_columns(out):
            out = microaggregate(out, c, key, k)
    return out
