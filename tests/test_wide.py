"""Distinct counts and correlations of many columns: one scan, no values in a shuffle, exact."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.operators import gram, measures, quality, stats


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_distinct_table_counts_every_type(spark):
    rows = [(1, "a", 0.0, b"x", None), (1, "A", -0.0, b"x", None), (2, None, float("nan"), b"y", None), (None, "a", float("nan"), b"", None)]
    df = spark.createDataFrame(rows, "i int, s string, d double, b binary, nothing string").withColumn("deep", F.array("s", F.col("i").cast("string")))
    got = {r.name: (r.rows, r.missing, r.distinct) for r in stats.distinct_table(df, {c: F.col(c) for c in df.columns}).collect()}
    assert got == {"i": (4, 1, 2), "s": (4, 1, 2), "d": (4, 0, 2), "b": (4, 0, 3), "nothing": (4, 4, 0), "deep": (4, 0, 4)}
    none = {r.name: (r.rows, r.missing, r.distinct) for r in stats.distinct_table(df.limit(0), {"i": F.col("i")}).collect()}
    assert none == {"i": (0, 0, 0)}


def test_three_hundred_columns_take_one_scan_and_no_expand(spark, tmp_path):
    spark.range(200).select(*[F.concat(F.lit("long text " * 5), (F.col("id") % (i + 1)).cast("string")).alias(f"c{i}") for i in range(300)]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = stats.distinct_table(df, {c: F.col(c) for c in df.columns})
    text = plan(found)
    assert text.count("FileScan") == 1 and "Expand" not in text and text.count("Generate") == 1
    exchanged = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanged and all("c0#" not in line for line in exchanged)
    assert {r.name: r.distinct for r in found.collect()} == {f"c{i}": min(200, i + 1) for i in range(300)}


def test_sketches_merge_to_those_of_all_rows(spark):
    days = [spark.range(k * 4_000, k * 4_000 + 8_000).select((F.col("id") % 15_000).alias("v"), F.when(F.col("id") % 2 == 0, F.lit("x")).alias("w")) for k in range(4)]
    columns = {"v": F.col("v"), "w": F.col("w")}
    merged = stats.merged_sketches([stats.distinct_sketches(d, columns) for d in days])
    got = {r.name: (r.rows, r.missing, r.n) for r in merged.withColumn("n", F.hll_sketch_estimate("sketch")).collect()}
    assert got["w"] == (32_000, 16_000, 1) and got["v"][:2] == (32_000, 0) and got["v"][2] == pytest.approx(15_000, rel=0.08)
    rough = {r.name: r.distinct for r in stats.distinct_table(days[0], columns, approx=True).collect()}
    assert rough["w"] == 1 and rough["v"] == pytest.approx(8_000, rel=0.08)


def test_casing_and_identifiers_from_digests(spark):
    df = spark.createDataFrame([("A", "x", f"id{i}") if i % 2 else ("a", "x", f"id{i}") for i in range(50)], "mixed string, same string, code string")
    assert [tuple(r) for r in quality.casing_issues(df).collect()] == [("mixed", 2, 1)]
    assert "Expand" not in plan(quality.casing_issues(df))
    assert quality.casing_issues(spark.range(3)).count() == 0
    assert ("code", "potential_identifier") in {(r["column"], r["reason"]) for r in quality.detect_sensitive_columns(df).collect()}


def wide_frame(spark, seed: int = 1, n: int = 700, width: int = 20):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * 10.0 ** rng.integers(-3, 4, width) + 10.0 ** rng.integers(0, 7, width)
    x[:, 1] = 2 * x[:, 0] + 0.1 * x[:, 1]
    x[:, 2] = 0.1  # constant
    x[rng.uniform(size=x.shape) < 0.2] = np.nan
    x[:, 3] = np.where(np.isnan(x[:, 4]), 5.0, 0.1)  # constant where column 4 has a value
    x[:, 5] = np.nan
    x[1:, 6] = np.nan
    columns = [f"c{i}" for i in range(width)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(9), columns


def test_blocked_products_are_the_aggregate(spark, monkeypatch):
    df, columns = wide_frame(spark)
    monkeypatch.setattr(gram, "BLOCK_CELLS", 400)
    monkeypatch.setattr(gram, "MERGED_ROWS", 2)
    got = {(r.col_a, r.col_b): r["corr"] for r in measures.correlations(df, columns).collect()}
    assert len(got) == 190
    monkeypatch.setattr(measures, "PAIRS_AT_ONCE", 1_000)
    want = {(r.col_a, r.col_b): r["corr"] for r in measures.correlations(df, columns).collect()}
    assert got.keys() == want.keys()
    for pair, r in want.items():
        assert (got[pair] is None) == (r is None), (pair, r, got[pair])
        assert r is None or got[pair] == pytest.approx(r, abs=1e-9)


def test_many_columns_take_one_scan(spark, tmp_path):
    width = 60
    spark.range(300).select(*[F.rand(i).alias(f"c{i}") for i in range(width)]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = measures.correlations(df, df.columns)
    assert plan(found).count("FileScan") == 1 and found.count() == width * (width - 1) // 2
    assert measures.correlation_preservation(df, df).first()[0] == pytest.approx(1.0)


def test_no_rows(spark):
    df, columns = wide_frame(spark, n=4)
    assert gram.wide_correlations(df.limit(0), columns).count() == 0
