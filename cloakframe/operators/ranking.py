"""Global order without a single partition.

``Window.orderBy`` with no partition moves every row into one task. Here the
rows are range-partitioned on the sort key, sorted locally and written once;
``monotonically_increasing_id`` then carries (partition, position), and only one
offset per partition has to be combined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_LOW_BITS = 33


def _ordered(df: DataFrame, order: Sequence[str], partitions: int | None) -> DataFrame:
    # without a number, adaptive execution merges small neighbouring ranges
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = (
        ranged
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    return (
        materialize(placed, "ordered")
        .withColumn("_part", F.shiftright("_mid", _LOW_BITS).cast("int"))
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1)))
        .drop("_mid")
    )


def global_rank(df: DataFrame, order: Sequence[str], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Add the 1-based rank of each row under ``order`` (must be unique).

    A heavily repeated leading value is spread by the later sort keys, so no
    range partition is larger than its share.
    """
    rows = _ordered(df, order, partitions)
    # one row per range partition: bounded by the shuffle width
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (
        rows.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_offset")
    )


def prefix_sums(
    df: DataFrame,
    order: str,
    sums: dict[str, str],
    group: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Running sums of ``sums`` (new name -> column) by ``order``, restarted per ``group``.

    ``(group, order)`` must be unique: aggregate repeated values first.
    """
    group = list(group)
    rows = _ordered(df, [*group, order], partitions)
    local = Window.partitionBy("_part", *group).orderBy("_pos")
    for new, source in sums.items():
        rows = rows.withColumn(new, F.sum(source).over(local))
    totals = rows.groupBy("_part", *group).agg(*[F.sum(s).alias(f"_t_{n}") for n, s in sums.items()])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # at most (range partitions + groups) rows
    offsets = totals.select(
        "_part", *group, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    joined = rows.join(F.broadcast(offsets), ["_part", *group])
    for new in sums:
        joined = joined.withColumn(new, F.col(new) + F.col(f"_o_{new}"))
    return joined.drop("_part", "_pos", *[f"_o_{n}" for n in sums])


def running_mins_before(
    df: DataFrame, order: str, mins: dict[str, str], group: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    """Smallest value so far of each of ``mins`` (new name -> column) among the earlier rows of the group; null on the first row."""
    group = list(group)
    rows = _ordered(df, [*group, order], partitions)
    local = Window.partitionBy("_part", *group).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    for new, source in mins.items():
        rows = rows.withColumn(new, F.min(source).over(local))
    totals = rows.groupBy("_part", *group).agg(*[F.min(source).alias(f"_t_{new}") for new, source in mins.items()])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *group, *[F.min(f"_t_{new}").over(before).alias(f"_o_{new}") for new in mins])
    joined = rows.join(F.broadcast(offsets) if not group else offsets, ["_part", *group])
    for new in mins:
        joined = joined.withColumn(new, F.least(new, f"_o_{new}"))
    return joined.drop("_part", "_pos", *[f"_o_{new}" for new in mins])


def running_min_before(
    df: DataFrame, order: str, source: str, name: str, group: Sequence[str] = (), partitions: int | None = None
) -> DataFrame:
    """Smallest ``source`` among the earlier rows of the group; null on the first row."""
    return running_mins_before(df, order, {name: source}, group, partitions)
