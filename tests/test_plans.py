"""Plans and skew: what must (not) appear in a physical plan, and joins with a hot key."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from cloakframe.operators import columns, disclosure, domains, joins, noise, stats

SF = "/root/testdata/sf0.001"

JVM_ONLY = [
    "pseudonymize", "suppress_rare_combinations", "microaggregate", "sdc", "gaussian_mechanism", "exponential_large", "randomized_response_large",
    "sample_large_domain", "utility_metrics", "ks_statistic", "quality_report", "validate_dataset", "compliance_report", "audit_statistics",
    "risk_protection_chart", "cascade_delete", "auxiliary_sample", "assess_risk", "budget_remaining", "optimization_report",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JVM_ONLY)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas"):
        assert bad not in text


@pytest.mark.parametrize("name", ["dcr", "linkage_scores"])
def test_neighbour_search_has_no_cross_join(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_the_needed_columns(spark):
    text = plan(queries()["document_manifest"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    text = plan(queries()["owner_filter"](spark, SF))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)]" in text and "props" not in text


def skewed(spark, n=4000):
    """A third of the rows share one key, some have none."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 700))
    return spark.range(n).select("id", key.alias("key"))


@pytest.mark.parametrize("limit", [0, 10_000])
def test_lookup_with_a_hot_key(spark, limit):
    df = skewed(spark)
    counts = df.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    table = counts.select("key", F.concat(F.lit("v"), F.col("key")).alias("value"), "n").filter("key <> 'k5'")
    out = joins.lookup(df, "key", table, "value", "n", df.count(), limit, table.count())
    assert out.columns == ["id", "key", "value"] and out.count() == df.count()
    wrong = F.when(F.col("key").isNull() | (F.col("key") == "k5"), F.col("value").isNotNull()).otherwise(F.col("value") != F.concat(F.lit("v"), F.col("key")))
    assert out.filter(F.coalesce(wrong, F.lit(True))).count() == 0


def test_hot_keys_are_bounded(spark):
    df = skewed(spark)
    counts = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = [r["key"] for r in joins.hot_keys(counts, ["key"], "n", df.count()).collect()]
    assert hot == ["hot"]


def test_large_domains_match_small_ones(spark, monkeypatch):
    """The joined forms give the same cells as the array forms."""
    df = skewed(spark)
    small = noise.randomized_response(df, "key", 3.0, ["id"], "s", max_array=5_000)
    drawn = noise.exponential_mechanism(df, "key", 0.01, ["id"], "s", max_array=5_000)
    codes = columns.label_encode(df, df, "key", "code")
    monkeypatch.setattr(domains, "MAX_BROADCAST", 10)
    monkeypatch.setattr(columns, "MAX_BROADCAST", 10)
    large = noise.randomized_response(df, "key", 3.0, ["id"], "s", max_array=10)
    pick = noise.exponential_mechanism(df, "key", 0.01, ["id"], "s", max_array=10)
    code = columns.label_encode(df, df, "key", "code")
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert same(small, large) and same(codes, code)
    assert same(drawn, pick)  # the null has one place in both forms


def rows_per_task(df):
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(sizes), sum(sizes) / len(sizes)


@pytest.mark.parametrize("key", ["CASE WHEN id % 2 = 0 THEN concat('k', id % 900) END", "CASE WHEN id % 2 = 0 THEN 'unseen' ELSE concat('k', id % 900) END", "CASE WHEN id % 2 = 0 THEN 'k1' ELSE concat('k', id % 900) END"])
def test_half_of_the_rows_on_one_key_or_none_are_spread(spark, monkeypatch, key):
    """Nulls, a key that the table does not know, and a known key: no task gets twice its share."""
    monkeypatch.setattr(joins, "shuffle_width", lambda _: 8)
    for name, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(name, value)
    try:
        df = spark.range(40_000).select("id", F.expr(key).alias("key"))
        table = spark.range(900).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("value"), F.lit(40).alias("n"))
        most, mean = rows_per_task(joins.lookup(df, "key", table, "value", "n", 36_000, 0, 900))
        assert most < 2 * mean
        counts = df.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        most, mean = rows_per_task(joins.anti_join_rare(df, ["key"], counts, "n", df.count(), 3))
        assert most < 2 * mean
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_suppression_spreads_hot_rows(spark):
    df = skewed(spark).filter("key is not null")
    kept = disclosure.suppress_rare_combinations(df, ["key"], 6)
    sizes = {r["key"]: r["n"] for r in df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kept.count() == sum(n for n in sizes.values() if n >= 6)
    assert "_salt" in plan(kept)


def test_wide_tables_are_measured_in_several_jobs(spark, monkeypatch):
    monkeypatch.setattr(stats, "COLUMNS_PER_JOB", 3)
    df = spark.range(10).select(*[(F.col("id") * i).cast("double").alias(f"c{i}") for i in range(1, 8)])
    found = stats.numeric_summary(df, df.columns)
    assert [found[f"c{i}"]["max"] for i in range(1, 8)] == [9.0 * i for i in range(1, 8)]
