"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_width

SPREAD = 1 << 20


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str, total: int) -> DataFrame:
    """Keys with more rows than a quarter of a fair shuffle partition.

    There can be at most ``4 * shuffle partitions`` of them, whatever the data.
    """
    limit = total / (4 * shuffle_width(counts.sparkSession))
    return counts.filter(F.col(n) > F.lit(limit)).select(*keys)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], names: Sequence[str]):
    cond = F.lit(True)
    for k, r in zip(keys, names):
        cond = cond & left[k].eqNullSafe(right[r])
    return cond


def _any_null(keys: Sequence[str]):
    out = F.lit(False)
    for k in keys:
        out = out | F.col(k).isNull()
    return out


def _zero(keys: Sequence[str]):
    """Zero that the optimizer cannot see: a literal would drop the salt from the join's keys, and with it the spread."""
    return F.pmod(F.xxhash64(*keys), F.lit(1).cast("bigint"))


def anti_join_rare(df: DataFrame, keys: Sequence[str], counts: DataFrame, n: str, total: int, k: int, null_keys: bool = False) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``counts`` with fewer than ``k`` rows.

    Rows of a hot key cannot be rare, and ``counts`` has no key with a null unless
    ``null_keys``; both carry a random salt that matches nothing, so the anti join
    spreads them instead of sending them to one task.
    """
    unmatched = F.lit(False) if null_keys else _any_null(keys)
    hot = hot_keys(counts.filter(F.col(n) >= k), keys, n, total)
    hot = hot.select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(keys)], F.lit(True).alias("_hot"))
    flagged = df.join(F.broadcast(hot), _same(df, hot, keys, [f"_h{i}" for i in range(len(keys))]), "left")
    flagged = flagged.withColumn(
        "_salt",
        F.when(F.col("_hot") | unmatched, F.pmod(F.xxhash64(*df.columns, F.monotonically_increasing_id()), F.lit(SPREAD)) + 1).otherwise(
            F.lit(0).cast("bigint")
        ),
    ).drop("_hot", *[f"_h{i}" for i in range(len(keys))])
    rare = counts.filter(F.col(n) < k).select(
        *[F.col(c).alias(f"_r{i}") for i, c in enumerate(keys)], _zero(keys).alias("_rsalt")
    )
    cond = _same(flagged, rare, keys, [f"_r{i}" for i in range(len(keys))]) & (flagged["_salt"] == rare["_rsalt"])
    return flagged.join(rare, cond, "left_anti").drop("_salt")


def lookup(
    df: DataFrame, key: str, table: DataFrame, value: str, weight: str, total: int, max_rows: int, table_rows: int
) -> DataFrame:
    """Left join ``df.key`` to ``table(key, value, weight)``, one row per key.

    ``table_rows`` is the measured size of ``table``: up to ``max_rows`` it is
    broadcast. Beyond that the keys that are hot in ``df`` itself (at most four per
    shuffle partition, known to the table or not) are broadcast, and the rest joins
    by shuffle; rows of hot keys and nulls are spread by a salt that matches nothing.
    """
    if table_rows <= max_rows:
        small = table.select(F.col(key).alias("_k"), value)
        return df.join(F.broadcast(small), df[key] == small["_k"], "left").drop("_k")
    own = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rows = own.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = hot_keys(own, [key], "_n", rows).select(F.col(key).alias("_hk")).join(table.select(F.col(key).alias("_tk"), F.col(value).alias("_hv")), F.col("_hk") == F.col("_tk"), "left").drop("_tk")
    first = df.join(F.broadcast(hot), df[key] == hot["_hk"], "left")
    spread = F.pmod(F.xxhash64(*df.columns, F.monotonically_increasing_id()), F.lit(SPREAD)) + 1
    no_lookup = F.col("_hk").isNotNull() | F.col(key).isNull()
    first = first.withColumn("_salt", F.when(no_lookup, spread).otherwise(F.lit(0).cast("bigint")))
    rest = table.select(F.col(key).alias("_ck"), F.col(value).alias("_cv"), _zero([key]).alias("_csalt"))
    joined = first.join(rest, (first[key] == rest["_ck"]) & (first["_salt"] == rest["_csalt"]), "left")
    return joined.withColumn(value, F.coalesce("_hv", "_cv")).drop("_hk", "_hv", "_ck", "_cv", "_salt", "_csalt")
