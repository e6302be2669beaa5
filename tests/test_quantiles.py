"""Ranks by radix selection against a sort, and what their plans do not hold."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakframe import session
from cloakframe.operators import quantiles


@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=30))
def test_bits_keep_the_order(values):
    found = sorted(values, key=lambda v: int(quantiles.ordered_bits(np.array([v]))[0]))
    assert found == sorted(values)
    assert all(quantiles.from_bits(int(quantiles.ordered_bits(np.array([v]))[0])) == v for v in values)


COLUMNS = {
    "normal": lambda rng, n: rng.normal(size=n), "wide": lambda rng, n: rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n),
    "hot": lambda rng, n: np.where(rng.uniform(size=n) < 0.9, 7.0, rng.uniform(size=n)), "signed zeros": lambda rng, n: np.where(np.arange(n) % 2, 0.0, -0.0),
    "close": lambda rng, n: 1.0 + rng.integers(0, 1 << 20, n) * 2.0**-52, "ends": lambda rng, n: np.where(np.arange(n) % 3 == 0, np.inf, np.where(np.arange(n) % 3 == 1, -np.inf, 3.5)),
}


def test_values_at_every_kind_of_rank(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 4_001
    data = {name: make(rng, n) for name, make in COLUMNS.items()}
    gaps = rng.uniform(size=n) < 0.2
    rows = [(*[None if gaps[i] else float(v[i]) for v in data.values()], math.nan if i % 5 else 2.5, None) for i in range(n)]
    names = [f"c{i}" for i in range(len(data))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*names, "odd", "nothing"])).repartition(7)
    places = {"first": 0.0, "low": 0.13, "mid": 0.5, "high": 0.77, "last": 1.0}
    for digit in (12, 3):  # few bits take many passes
        monkeypatch.setattr(quantiles, "DIGIT", digit)
        got = quantiles.values_at(df, [*names, "odd", "nothing"], lambda _, k: {p: round(x * (k - 1)) for p, x in places.items()})
        for c, values in zip(names, data.values(), strict=True):
            ordered = np.sort(values[~gaps])
            assert {p: got[c, p] for p in places} == {p: ordered[round(x * (len(ordered) - 1))] for p, x in places.items()}
        assert {got["odd", p] for p in places} == {2.5} and not any(c == "nothing" for c, _ in got)


@pytest.mark.parametrize("n", [0, 1, 2, 9])
def test_quantiles_interpolate_as_numpy_does(spark, n):
    values = np.random.default_rng(n).normal(size=n)
    df = spark.createDataFrame([(float(v), int(i)) for i, v in enumerate(values)], "a double, b int")
    got = quantiles.quantiles(df, ["a", "b"], [0.0, 0.25, 0.5, 0.9])
    want = [np.quantile(values, p) for p in (0.0, 0.25, 0.5, 0.9)] if n else [None] * 4
    assert got["a"] == (pytest.approx(want) if n else want)
    assert got["b"][2] == ((n - 1) / 2 if n else None)


def test_no_sort_no_range_exchange_no_written_table(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a table was written")

    monkeypatch.setattr(session, "materialize", refuse)
    monkeypatch.setattr(session, "scratch_path", refuse)
    df = spark.range(50_000).select((F.col("id") * 37 % 50_000).cast("double").alias("v"))
    plans = []
    counts = quantiles._counts

    def seen(values, slots):
        out = counts(values, slots)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(quantiles, "_counts", seen)
    assert quantiles.quantiles(df, ["v"], [0.5])["v"] == [24_999.5]
    assert 1 < len(plans) <= 6
    assert all("rangepartitioning" not in p and "hashpartitioning(slot" in p for p in plans)
    rows = df.mapInArrow(quantiles._counter([quantiles.Slot(0, 0, 0, 12)]), quantiles._SCHEMA).count()
    assert rows <= 16 * df.rdd.getNumPartitions()  # counts leave a task, not values
