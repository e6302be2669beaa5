"""Shared column statistics: one aggregate for all numeric columns, one long
frequency table for all categories."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Aggregates per job. A wider table is measured in several jobs of this width, so that generated code stays small.
COLUMNS_PER_JOB = 100


def null_count(c: str) -> Column:
    return F.sum(F.col(c).isNull().cast("bigint"))


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson r of the rows that have both values; null where one of them does not vary.

    ``corr()`` divides by the deviations, an error where a column is constant, and sums of a constant may deviate by rounding.
    """
    x, y = (F.col(c).cast("double") if isinstance(c, str) else c for c in (a, b))
    one, two = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    varies = (F.min(one) < F.max(one)) & (F.min(two) < F.max(two))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(one) * F.stddev_pop(two)))


def single_row(df: DataFrame, exprs: dict[str, Column]) -> dict[str, object]:
    """Evaluate named aggregates, ``COLUMNS_PER_JOB`` at a time; the result is one row."""
    names = list(exprs)
    out: dict[str, object] = {}
    for i in range(0, len(names), COLUMNS_PER_JOB):
        chunk = names[i : i + COLUMNS_PER_JOB]
        out.update(df.agg(*[exprs[n].alias(n) for n in chunk]).first().asDict())
    return out


def numeric_summary(df: DataFrame, columns: Sequence[str], measures: Sequence[str] = ("min", "max")) -> dict[str, dict]:
    """``{column: {measure: value}}`` of min, max, mean, std, pstd, n as doubles."""
    make = {
        "min": lambda c: F.min(c.cast("double")),
        "max": lambda c: F.max(c.cast("double")),
        "mean": lambda c: F.avg(c.cast("double")),
        "std": lambda c: F.stddev_samp(c.cast("double")),
        "pstd": lambda c: F.stddev_pop(c.cast("double")),
        "n": lambda c: F.count(c),
    }
    exprs = {f"{m}:{i}": make[m](F.col(c)) for i, c in enumerate(columns) for m in measures}
    row = single_row(df, exprs) if exprs else {}
    return {c: {m: row[f"{m}:{i}"] for m in measures} for i, c in enumerate(columns)}


def stacked(df: DataFrame, columns: Sequence[str], cast: str) -> DataFrame:
    """Long form ``(column, value)`` with every value cast to one type."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value")) for c in columns])
    return df.select(F.inline(pairs))


def value_counts(df: DataFrame, columns: Sequence[str], cast: str = "string", keep_null: bool = False) -> DataFrame:
    """``(column, value, n)``; counted before the shuffle, so a hot value costs one row per task."""
    long = stacked(df, columns, cast)
    if not keep_null:
        long = long.filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


SKETCH_BITS = 12  # log2 of the registers of a sketch: a standard error of about 1.6 %


def digest_cell(number: int, value: Column) -> Column:
    """``(i, h, g)``: a value as 128 bits (two hashes from different starts), null as nulls."""
    hashed = lambda *parts: F.when(value.isNotNull(), F.xxhash64(*parts))
    return F.struct(F.lit(number).alias("i"), hashed(value).alias("h"), hashed(F.lit(1), value).alias("g"))


def distinct_table(df: DataFrame, values: dict[str, Column], approx: bool = False) -> DataFrame:
    """``(name, rows, missing, distinct)`` of many columns in one scan and one grouping.

    Each cell becomes (column number, digest), equal ones are counted before the shuffle, and no value
    itself is shuffled, however long. Two values of a column fall together with a chance of 2 ** -128 per pair.
    ``approx`` answers from the sketches of ``distinct_sketches``, without a shuffle of cells.
    """
    names = list(values)
    listed = df.sparkSession.createDataFrame(list(enumerate(names)), "i int, name string")
    if approx:
        found = distinct_sketches(df, values).select(F.col("name").alias("_name"), "rows", "missing", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("distinct"))
        return listed.join(found, F.col("name") == F.col("_name"), "left").select("name", "rows", "missing", "distinct")
    cells = df.select(F.inline(F.array(*[digest_cell(i, v) for i, v in enumerate(values.values())])))
    counted = cells.groupBy("i", "h", "g").agg(F.count(F.lit(1)).alias("n"))
    found = counted.groupBy("i").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("h").isNull(), F.col("n")).otherwise(0)).alias("missing"), F.count("h").alias("distinct"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return listed.join(found, "i", "left").select("name", zero("rows"), zero("missing"), zero("distinct"))  # one row per column


def distinct_sketches(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``(name, rows, missing, sketch)``: a mergeable sketch of the distinct values of each column, in one scan."""
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, v in enumerate(values.values()):
        digest = F.when(v.isNotNull(), F.xxhash64(v))
        aggregates += [F.count(v).alias(f"_n{i}"), F.hll_sketch_agg(digest, F.lit(SKETCH_BITS)).alias(f"_s{i}")]
    rows = [
        F.struct(F.lit(c).alias("name"), F.col("_rows").alias("rows"), (F.col("_rows") - F.col(f"_n{i}")).alias("missing"), F.col(f"_s{i}").alias("sketch"))
        for i, c in enumerate(values)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def merged_sketches(tables: Sequence[DataFrame]) -> DataFrame:
    """The sketches of several tables, or of the days of one, as those of all their rows."""
    every = reduce(DataFrame.unionByName, tables)
    return every.groupBy("name").agg(F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.hll_union_agg("sketch").alias("sketch"))


def any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns], F.lit(False))


def no_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns], F.lit(True))


def one_row(df: DataFrame, *columns: Column) -> DataFrame:
    """Aggregate ``df`` to one row of named columns."""
    return df.agg(*columns)
