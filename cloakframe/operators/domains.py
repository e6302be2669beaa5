"""Category domains: a bounded array in the plan while small, a joined table beyond that."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import schema as roles
from ..session import materialize
from .joins import lookup
from .ranking import global_rank, prefix_sums, running_mins_before

# A domain up to this size is a literal array, scanned per cell.
MAX_ARRAY = 256
# A domain table up to this size is broadcast; larger ones join by shuffle.
MAX_BROADCAST = 10_000
# Weights of alias tables: whole numbers whose sums are exact.
_WHOLE = "decimal(38,0)"


@dataclass(frozen=True)
class Domain:
    """Distinct values of a column in sorted order (a null, if any, comes last).

    ``table`` is ``(value, n)`` over non-null values; ``values`` is filled only
    when there are at most ``max_array`` of them.
    """

    table: DataFrame
    size: int
    rows: int
    nulls: int
    values: list | None
    counts: list[int] | None

    @property
    def k(self) -> int:
        return self.size + (1 if self.nulls else 0)


def fit_domain(df: DataFrame, column: str | Column, max_array: int = MAX_ARRAY) -> Domain:
    value = F.col(column) if isinstance(column, str) else column
    grouped = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    table = grouped.filter(F.col("value").isNotNull())
    if roles.is_temporal(grouped.schema["value"].dataType):
        # times stay in a table: literals would pass through the driver's time zone
        max_array = -1
    # a top-k over the distinct values: at most max_array + 2 rows reach the driver
    head = grouped.orderBy(F.col("value").asc_nulls_first()).limit(max_array + 2).collect()
    nulls = head[0]["n"] if head and head[0]["value"] is None else 0
    found = [r for r in head if r["value"] is not None]
    if len(found) <= max_array:
        values, counts = [r["value"] for r in found], [r["n"] for r in found]
        return Domain(table, len(values), sum(counts), nulls, values, counts)
    facts = table.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows")).first()
    return Domain(table, facts["k"], facts["rows"] or 0, nulls, None, None)


def _literal_array(items: list) -> Column:
    return F.array(*[F.lit(v) for v in items])


def pick(values: list, index: Column) -> Column:
    """``values[index]`` (0-based); an index past the end gives null."""
    return F.get(_literal_array(values), index.cast("int"))


def position(values: list, value: Column) -> Column:
    """0-based position of ``value`` in ``values``; null when it is not there."""
    at = F.array_position(_literal_array(values), value).cast("int")
    return F.when(at > 0, at - 1)


def indexed(domain: Domain) -> DataFrame:
    """``(value, n, idx)`` with the sorted position, for domains too large for an array."""
    return global_rank(domain.table, ["value"], "idx").withColumn("idx", F.col("idx") - 1)


def flip_large(df: DataFrame, column: str, domain: Domain, target: Column, keep: Column, own: str) -> DataFrame:
    """Replace the flipped cells of ``column`` by the value at position ``target``.

    ``target`` is uniform over the domain, so the second join has no hot key.
    """
    table = indexed(domain)
    by_value = table.select(F.col("value").alias(column), F.col("idx").alias(own), "n")
    with_own = lookup(df, column, by_value, own, "n", domain.rows, MAX_BROADCAST, domain.size)
    with_own = with_own.withColumn(own, F.coalesce(F.col(own), F.lit(domain.size)))
    wanted = with_own.withColumn("_want", F.when(~keep, target))
    spread = F.xxhash64(*df.columns, F.spark_partition_id())
    # kept cells look nothing up: a negative key of their own spreads them
    wanted = wanted.withColumn("_want", F.coalesce(F.col("_want").cast("bigint"), -1 - F.pmod(spread, F.lit(1 << 40))))
    by_index = table.select(F.col("idx").alias("_idx"), F.col("value").alias("_new"))
    if domain.size <= MAX_BROADCAST:
        by_index = F.broadcast(by_index)
    joined = wanted.join(by_index, wanted["_want"] == by_index["_idx"], "left")
    return joined.withColumn(column, F.when(F.col("_want") < 0, F.col(column)).otherwise(F.col("_new"))).select(*df.columns)


def alias_columns(weights: list[int]) -> tuple[list[float], list[int]]:
    """Walker's alias table of a bounded domain: for each value how much of its column it keeps, and who gets the rest.

    Every value owns one of ``k`` columns of equal size. A light value leaves part of its column over; heavy values,
    in order, fill those parts, and what is then left of a heavy one's own column goes to the next heavy one. All sums
    are of integers, so the table is the same however it is added up.
    """
    k, total = len(weights), sum(weights)
    scaled = [w * k for w in weights]
    keep, other = [1.0] * k, list(range(k))
    light = [i for i, s in enumerate(scaled) if s < total]
    heavy = [i for i, s in enumerate(scaled) if s > total]
    at, excess, deficit = 0, scaled[heavy[0]] - total if heavy else 0, 0
    for i in light:
        keep[i], other[i] = scaled[i] / total, heavy[at]
        deficit += total - scaled[i]
        while deficit >= excess and at + 1 < len(heavy):
            if deficit > excess:
                keep[heavy[at]], other[heavy[at]] = (total + excess - deficit) / total, heavy[at + 1]
            at += 1
            excess += scaled[heavy[at]] - total
    return keep, other


def draw_small(values: list, weights: list[int], u: Column) -> Column:
    """One of a bounded domain's values, by weight: ``u`` picks a column of the alias table and a place in it."""
    chosen = [(v, w) for v, w in zip(values, weights, strict=True) if w > 0]
    keep, other = alias_columns([w for _, w in chosen])
    at = u * F.lit(float(len(chosen)))
    own = F.least(F.floor(at), F.lit(len(chosen) - 1)).cast("int")
    index = F.when(at - own < F.get(_literal_array(keep), own), own).otherwise(F.get(_literal_array(other), own))
    return pick([v for v, _ in chosen], index)


def alias_table(weighted: DataFrame) -> tuple[DataFrame, int]:
    """``(idx, value, keep, other, shares)`` of ``weighted(value, w)``, whole-number weights, and how many there are.

    The table of ``alias_columns`` for a domain of any size. Running sums in order of value say where on a common
    line each light value's deficit begins and ends and where each heavy one's excess is used up; who fills whom is
    then the nearest heavy end beyond a light begin, found by one pass over the line in descending order.
    """
    rows = weighted.filter(F.col("w") > 0).select("value", F.col("w").cast(_WHOLE).alias("w"))
    facts = rows.agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("t")).first()
    whole = lambda x: F.lit(str(x)).cast(_WHOLE)
    k, total, none = facts["k"], whole(facts["t"] or 0), whole(0)
    scaled = rows.select("value", (F.col("w") * whole(k)).cast(_WHOLE).alias("s"), F.struct(F.col("value").isNull().alias("last"), F.col("value").alias("v")).alias("_by"))
    sides = scaled.select(
        "value", "s", "_by", F.lit(1).cast("bigint").alias("_one"),
        F.greatest(none, total - F.col("s")).cast(_WHOLE).alias("_less"), F.greatest(none, F.col("s") - total).cast(_WHOLE).alias("_more"),
    )
    sums = prefix_sums(sides, "_by", {"_d": "_less", "_e": "_more", "_n": "_one"})
    sums = materialize(sums.select("value", "s", F.col("_d").cast(_WHOLE).alias("_d"), F.col("_e").cast(_WHOLE).alias("_e"), (F.col("_n") - 1).alias("idx"), "_less", "_more"), "alias")
    light, heavy = sums.filter("_less > 0"), sums.filter("_more > 0")
    place = lambda at, kind: F.struct((-at).cast(_WHOLE).alias("at"), F.lit(kind).alias("kind")).alias("_line")
    giver = F.struct(F.col("_e").alias("e"), F.col("value").alias("value"))
    nobody = F.lit(None).cast(f"struct<e:{_WHOLE},value:{sums.schema['value'].dataType.simpleString()}>").alias("_giver")
    # at one place: light begins, which look for a heavy end beyond it, then light ends, which heavy ends look for
    line = (
        light.select(place(F.col("_d") - F.col("_less"), 0), "idx", "value", "s", "_e", nobody, F.lit(None).cast(_WHOLE).alias("_end"))
        .unionByName(heavy.select(place(F.col("_e"), 2), "idx", "value", "s", "_e", giver.alias("_giver"), F.lit(None).cast(_WHOLE).alias("_end")))
        .unionByName(light.select(place(F.col("_d"), 1), "idx", "value", "s", "_e", nobody, F.col("_d").alias("_end")))
    )
    met = running_mins_before(line, "_line", {"_next": "_giver", "_stop": "_end"})
    part = F.when(F.col("_line.kind") == 0, F.col("s")).otherwise(total + F.col("_e") - F.col("_stop"))
    shares = F.col("_next").isNotNull() & ((F.col("_line.kind") == 0) | F.col("_stop").isNotNull())
    mixed = met.filter(F.col("_line.kind") != 1).select(
        "idx", "value", F.when(shares, part.cast("double") / total.cast("double")).otherwise(F.lit(1.0)).alias("keep"), F.col("_next.value").alias("other"), shares.alias("shares")
    )
    even = sums.filter("_less = 0 AND _more = 0")
    pure = even.select("idx", "value", F.lit(1.0).alias("keep"), F.lit(None).cast(sums.schema["value"].dataType).alias("other"), F.lit(False).alias("shares"))
    return mixed.unionByName(pure), k


def draw_alias(df: DataFrame, column: str, table: DataFrame, k: int, u: Column) -> DataFrame:
    """``draw_small`` for an alias table of any size: rows join on a uniform column number, so no key is hot whatever the weights."""
    rows = df.withColumn("_at", u * F.lit(float(k))).withColumn("_own", F.least(F.floor("_at"), F.lit(k - 1)).cast("bigint"))
    cells = table.select(F.col("idx").alias("_idx"), F.col("value").alias("_value"), "keep", F.col("other").alias("_other"), "shares")
    cells = cells.withColumnsRenamed({"keep": "_keep", "shares": "_shares"})
    drawn = F.when((F.col("_at") - F.col("_own") < F.col("_keep")) | ~F.col("_shares"), F.col("_value")).otherwise(F.col("_other"))
    joined = rows.join(cells, rows["_own"] == cells["_idx"], "left").withColumn("_drawn", drawn)
    return joined.drop("_at", "_own", "_idx", "_value", "_keep", "_other", "_shares").withColumn(column, F.col("_drawn")).drop("_drawn")


def draw_large(df: DataFrame, column: str, running: DataFrame, u: Column, buckets: int) -> DataFrame:
    """Inverse CDF over a domain of any size, for uniforms that have to keep their order.

    ``running`` is ``(value, w, hi)``, each ``w`` at least the 64th part of a bucket. The unit interval is cut into ``buckets``;
    each value's interval is listed once per bucket it touches (at most
    ``buckets + domain`` entries) and rows join on the bucket of their uniform.
    Uniforms fill the buckets evenly, so the join has no hot key even when one
    value holds most of the weight.
    """
    total = running.agg(F.max("hi").alias("t")).first()["t"]
    span = running.select(
        "value", ((F.col("hi") - F.col("w")) / F.lit(total)).alias("lo"), (F.col("hi") / F.lit(total)).alias("hi")
    )
    # neighbours share one edge value, so every uniform falls in exactly one interval
    ordered = Window.partitionBy("_b").orderBy("hi")
    listed = span.withColumn(
        "_b",
        F.explode(F.sequence(F.floor(F.col("lo") * buckets), F.least(F.floor(F.col("hi") * buckets), F.lit(buckets - 1)))),
    )
    listed = listed.withColumn("_lo", F.coalesce(F.lag("hi").over(ordered), F.col("_b") / F.lit(float(buckets)) - 1.0))
    last = F.row_number().over(Window.partitionBy("_b").orderBy(F.desc("hi"))) == 1
    listed = listed.withColumn("_hi", F.when(last, F.lit(2.0)).otherwise(F.col("hi")))
    cells = listed.select(F.col("_b").alias("_cb"), "_lo", "_hi", F.col("value").alias("_drawn"))
    rows = df.withColumn("_u", u).withColumn("_b", F.floor(F.col("_u") * buckets))
    hit = (rows["_b"] == cells["_cb"]) & (rows["_u"] > cells["_lo"]) & (rows["_u"] <= cells["_hi"])
    return rows.join(cells, hit, "left").withColumn(column, F.col("_drawn")).drop("_u", "_b", "_cb", "_lo", "_hi", "_drawn")
