"""Alias tables: exact shares, one row per bucket whatever the weights, equal on the array and the joined path."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import domains, synthesis


def shares(keep: list[float], other: list[int], weights: list[int]) -> list[float]:
    """What each value gets of all columns."""
    got = [0.0] * len(weights)
    for i, (k, o) in enumerate(zip(keep, other, strict=True)):
        got[i] += k
        got[o] += 1 - k
    return [g / len(weights) for g in got]


WEIGHTS = {
    "even": [3] * 8, "one": [5], "hot": [1] * 300 + [99 * 300], "two levels": [1, 3] * 40, "first hot": [1000, 1, 1, 1, 2],
    "random": [random.Random(2).randint(1, 1 << 60) for _ in range(200)], "tiny and huge": [1, 1 << 60, 1, 1 << 59],
}


@pytest.mark.parametrize("name", WEIGHTS)
def test_columns_give_each_value_its_weight(name):
    weights = WEIGHTS[name]
    keep, other = domains.alias_columns(weights)
    assert all(0 < k <= 1 for k in keep)
    assert shares(keep, other, weights) == pytest.approx([float(Fraction(w, sum(weights))) for w in weights], abs=1e-12)


@pytest.mark.parametrize("name", WEIGHTS)
def test_the_joined_table_is_the_array(spark, name):
    weights = WEIGHTS[name]
    rows = [(f"v{i:05d}", str(w)) for i, w in enumerate(weights)]
    weighted = spark.createDataFrame([*rows, ("never", "0")], "value string, w string").withColumn("w", F.col("w").cast("decimal(38,0)"))
    table, k = domains.alias_table(weighted.repartition(5))
    keep, other = domains.alias_columns(weights)
    got = {r.idx: r for r in table.collect()}
    assert k == len(weights) and sorted(got) == list(range(k))
    for i in range(k):
        assert got[i].value == rows[i][0]
        assert (got[i].keep if got[i].shares else 1.0) == keep[i]
        assert not got[i].shares or keep[i] == 1.0 or got[i].other == rows[other[i]][0]


def test_a_null_among_the_values(spark):
    weighted = spark.createDataFrame([("a", 1), (None, 6), ("b", 2)], "value string, w long")
    table, k = domains.alias_table(weighted)
    got = [(r.value, r.keep if r.shares else 1.0, r.other if r.shares else r.value) for r in table.orderBy("idx").collect()]
    assert got == [("a", 1 / 3, None), ("b", 2 / 3, None), (None, 1.0, None)] and k == 3


def test_one_value_with_nearly_all_weight_crowds_no_bucket(spark):
    """99 % on one value: each bucket of the join still has one row, and the draws follow the weights."""
    n = 2_000
    df = spark.range(200 * n).select(F.when(F.col("id") % 100 == 0, F.concat(F.lit("v"), F.pmod(F.floor(F.col("id") / 100), F.lit(n)))).otherwise(F.lit("hot")).alias("c"))
    fit = synthesis.fit_marginals(df)
    table, k = domains.alias_table(fit.categorical["c"].table.select("value", F.col("n").alias("w")))
    assert k == n + 1 and table.groupBy("idx").count().agg(F.max("count")).first()[0] == 1
    drawn = synthesis.sample_marginals(fit, "s", spark, 20_000)
    hot = drawn.filter("c = 'hot'").count()
    assert abs(hot / 20_000 - 0.99) < 0.004 and drawn.filter("c is null").count() == 0


def test_no_values(spark):
    table, k = domains.alias_table(spark.createDataFrame([], "value string, w long"))
    assert k == 0 and table.count() == 0
