"""Micro-frames and properties: nulls, ties, constants, tails, empties."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakframe.functions.binning import equal_width_index
from cloakframe.functions.randomness import normal, uniform
from cloakframe.operators import attacks, budget, columns, disclosure, domains, dp_train, fidelity, measures, noise, quality, ranking, search
from cloakframe.operators.neighbors import nearest
from cloakframe.operators.quantiles import modes, quantiles
from cloakframe.operators.synthesis import fit_gaussian_copula, sample_gaussian_copula, synthesize


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, column="v", order="k"):
    return [r[column] for r in df.orderBy(order).collect()]


# ---- binning, ranks, quantiles -----------------------------------------------------


def test_bin_edges_are_right_closed(spark):
    df = frame(spark, [(i, float(v)) for i, v in enumerate([0, 2, 4, 6, 8, 10, 3.3])], "k int, v double")
    assert values(df.withColumn("v", equal_width_index(F.col("v"), 0.0, 10.0, 5))) == [0, 0, 1, 2, 3, 4, 1]


@pytest.mark.parametrize("bins,middle", [(5, 2), (10, 4)])
def test_constant_column_falls_in_the_middle_bin(spark, bins, middle):
    df = frame(spark, [(i, 7.0) for i in range(3)], "k int, v double")
    assert values(columns.equal_width_bin(df, "v", bins, "v")) == [middle] * 3


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_rank_does_not_depend_on_partitioning(spark, partitions):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(1).alias("v")).repartition(partitions)
    ranked = ranking.global_rank(df, ["v", "k"], partitions=partitions)
    assert ranked.filter(F.col("rank") != F.col("k") + 1).count() == 0


def test_prefix_sums_restart_per_group(spark):
    df = frame(spark, [("a", float(i), 1) for i in range(50)] + [("b", float(i), 2) for i in range(30)], "g string, x double, n int")
    rows = ranking.prefix_sums(df, "x", {"c": "n"}, ["g"], partitions=5).collect()
    assert all(r["c"] == (r["x"] + 1) * r["n"] for r in rows) and len(rows) == 80


def test_rank_has_no_single_partition_over_rows(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    plan = ranking.global_rank(df, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "unspecifiedframe" not in plan.lower()


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40))
def test_quantiles_match_numpy(spark, xs):
    df = frame(spark, [(float(x),) for x in xs], "v double")
    got = quantiles(df, ["v"], [0.25, 0.5, 0.75])["v"]
    assert got == pytest.approx(list(np.percentile(np.array(xs) + 0.0, [25, 50, 75])), rel=1e-9, abs=1e-9)


def test_mode_breaks_ties_by_smallest(spark):
    assert modes(frame(spark, [("b",), ("a",)], "v string"), ["v"]) == {"v": "a"}


# ---- columns -----------------------------------------------------------------------


def test_impute_with_all_null_text_uses_unknown(spark):
    df = frame(spark, [(1, None), (2, None)], "k int, v string")
    assert values(columns.impute(df)) == ["Unknown", "Unknown"]


def test_pseudonyms_are_stable_and_keep_null(spark):
    df = frame(spark, [(1, "x"), (2, "x"), (3, None)], "k int, v string")
    a, b, c = values(columns.pseudonymize(df, ["v", "absent"], "salt"))
    assert a == b and a.startswith("anon_") and c is None


def test_wrong_key_length_is_refused(spark):
    with pytest.raises(ValueError):
        columns.encrypt_column(frame(spark, [("x",)], "v string"), "v", b"short")


def test_codes_beyond_the_array_limit(spark):
    df = spark.range(700).select((F.col("id") % 650).cast("string").alias("v"), F.col("id").alias("k"))
    codes = columns.fit_codes(df, "v")
    assert codes.values is None
    expected = {v: i for i, v in enumerate(sorted({str(i % 650) for i in range(700)}))}
    assert all(r["c"] == expected[r["v"]] for r in columns.apply_codes(df, "v", codes, "c").collect())


# ---- disclosure control ------------------------------------------------------------


def test_microaggregate_short_tail(spark):
    df = frame(spark, [(i, float(i)) for i in range(1, 9)], "k int, v double")
    assert values(disclosure.microaggregate(df, "v", ["k"], 3)) == [2.0] * 3 + [5.0] * 3 + [7.5] * 2
    assert values(disclosure.microaggregate(df, "v", ["k"], 3, merge_tail=True)) == [2.0] * 3 + [6.0] * 5


def test_microaggregate_breaks_ties_by_key_and_keeps_mean(spark):
    df = frame(spark, [(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0), (5, 2.0), (6, None)], "k int, v double")
    out = values(disclosure.microaggregate(df, "v", ["k"], 3))
    assert out == [1.0, 1.0, 1.0, 1.5, 1.5, None]


def test_suppression_keeps_null_combinations(spark):
    df = frame(spark, [("x", 1), ("x", 1), (None, 1), ("y", 1), ("y", 1), ("y", 1)], "a string, b int")
    kept = disclosure.suppress_rare_combinations(df, ["a", "b"], 3).collect()
    assert sorted((r["a"] or "") for r in kept) == ["", "y", "y", "y"]
    assert disclosure.suppress_rare_combinations(df, [], 3).count() == 6
    assert disclosure.suppress_rare_combinations(df, ["a", "b"], 3, nulls="group").count() == 3


def test_suppression_with_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1200, 0).otherwise(F.col("id") % 900).alias("g"), "id")
    kept = disclosure.suppress_rare_combinations(df, ["g"], 3)
    sizes = {r["g"]: r["n"] for r in df.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kept.count() == sum(n for n in sizes.values() if n >= 3)
    assert kept.groupBy("g").count().filter("count < 3").count() == 0


def test_generalize_folds_rare_and_keeps_null(spark):
    df = frame(spark, [(i, "a") for i in range(30)] + [(30, "b"), (31, None)], "k int, v string")
    out = values(disclosure.generalize_categorical(df, ["v"]))
    assert set(out[:30]) == {"a"} and out[30] == "Other" and out[31] is None


# ---- noise -------------------------------------------------------------------------


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_noise_does_not_depend_on_partitioning(spark, partitions):
    df = spark.range(500).select("id", F.col("id").cast("double").alias("v"), (F.col("id") % 3).cast("string").alias("c"))
    base = noise.apply_dp(df, 0.9, 1e-5, ["id"], "s").collect()
    moved = noise.apply_dp(df.repartition(partitions), 0.9, 1e-5, ["id"], "s").collect()
    assert sorted(map(tuple, base)) == sorted(map(tuple, moved))


def test_noise_moments(spark):
    df = spark.range(20_000).select("id", F.lit(0.0).alias("v"))
    row = df.select(normal("s", "x", ["id"]).alias("n"), uniform("s", "y", ["id"]).alias("u")).agg(
        F.avg("n"), F.stddev("n"), F.avg("u"), F.min("u"), F.max("u")
    ).first()
    assert abs(row[0]) < 0.04 and abs(row[1] - 1) < 0.03 and abs(row[2] - 0.5) < 0.01 and 0 < row[3] < row[4] < 1
    lap = noise.laplace_mechanism(df, 2.0, ["id"], "s", sensitivity=1.0).agg(F.avg("v"), F.avg(F.abs("v"))).first()
    assert abs(lap[0]) < 0.02 and abs(lap[1] - 0.5) < 0.02


@pytest.mark.parametrize("k", [4, 400])
def test_randomized_response_keep_rate(spark, k):
    n = 12_000
    df = spark.range(n).select("id", (F.col("id") % k).cast("string").alias("v"))
    epsilon = math.log(k - 1)
    out = noise.randomized_response(df, "v", epsilon, ["id"], "s").withColumnRenamed("v", "w")
    joined = df.join(out, "id")
    kept = joined.filter("v = w").count() / n
    assert joined.count() == n and abs(kept - 0.5) < 5 * math.sqrt(0.25 / n)
    assert out.filter("w is null").count() == 0


def test_randomized_response_on_times_and_booleans(spark):
    at = F.timestamp_seconds(F.col("id") % 3 * 86_400).cast("timestamp_ntz")
    df = spark.range(600).select("id", at.alias("t"), (F.col("id") % 2 == 0).alias("b"))
    out = noise.gaussian_mechanism(df, 0.5, 1e-5, ["id"], "s")
    assert out.dtypes == df.dtypes and out.select("t").distinct().count() == 3 and out.select("b").distinct().count() == 2
    assert 0 < df.join(out.withColumnRenamed("t", "w"), "id").filter("t <> w").count() < 600


def test_randomized_response_with_one_value_changes_nothing(spark):
    df = frame(spark, [(1, "a"), (2, "a")], "k int, v string")
    assert values(noise.randomized_response(df, "v", 1.0, ["k"], "s")) == ["a", "a"]


def test_exponential_mechanism_with_a_big_count_does_not_overflow(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4990, "big").otherwise("small").alias("v"))
    assert noise.exponential_mechanism(df, "v", 1.0, ["id"], "s").filter("v <> 'big'").count() == 0


def test_exponential_mechanism_beyond_the_array_limit_is_even_for_even_counts(spark):
    df = spark.range(9000).select("id", (F.col("id") % 300).cast("string").alias("v"))
    counts = [r["n"] for r in noise.exponential_mechanism(df, "v", 1.0, ["id"], "s").groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(counts) == 9000 and len(counts) == 300 and max(counts) < 80


def test_unknown_mechanism_and_bad_epsilon(spark):
    df = frame(spark, [(1, 1.0)], "k int, v double")
    with pytest.raises(ValueError):
        noise.apply_dp(df, 1.0, 1e-5, ["k"], "s", "none")
    with pytest.raises(ValueError):
        noise.apply_dp(df, 0.0, 1e-5, ["k"], "s", "laplace")


def test_no_python_udf_in_noise_plans(spark):
    df = spark.range(10).select("id", F.col("id").cast("double").alias("v"), F.col("id").cast("string").alias("c"))
    plan = noise.apply_dp(df, 0.9, 1e-5, ["id"], "s")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_budget_limits(spark):
    ops = frame(spark, [("a", 6.0, 1e-4, None), ("a", 5.0, 1e-4, "laplace"), (None, 1.0, 0.0, "x")], "session_id string, epsilon double, delta double, mechanism string")
    rows = {r["session_id"]: r for r in budget.budget_remaining(ops).collect()}
    assert rows["a"]["epsilon_remaining"] == 0.0 and rows["a"]["epsilon_percent"] == 100.0 and rows["default"]["epsilon_used"] == 1.0
    with pytest.raises(ValueError):
        budget.enforce_budget(ops, "a", 0.1, 0.0)
    budget.enforce_budget(ops, "b", 0.1, 0.0)


def test_dp_logistic_learns_a_separable_label(spark):
    df = spark.range(4000).select("id", (F.col("id") / 4000.0 - 0.5).alias("x")).withColumn("y", (F.col("x") > 0).cast("int"))
    model = dp_train.dp_logistic_fit(df, ["x"], "y", 20.0, 1e-5, ["id"], "s", epochs=5, learning_rate=5.0)
    right = model.predict(df).filter((F.col("probability") > 0.5) == (F.col("y") == 1)).count()
    assert right / 4000 > 0.9
    assert dp_train.noise_multiplier(1.0, 1e-5, 10) > dp_train.noise_multiplier(5.0, 1e-5, 10)


def test_sampled_renyi_equals_the_integral():
    """Against the definition: the mean of ((1 - q) + q N(1, s) / N(0, s)) ** order under N(0, s)."""
    import numpy as np

    for rate, sigma, order in ((0.01, 1.1, 2), (0.25, 2.0, 8), (0.1, 1.5, 16), (0.5, 4.0, 33)):
        z = np.linspace(-40 * sigma, order + 40 * sigma, 2_000_001)
        log_p = -(z**2) / (2 * sigma**2) - np.log(sigma * np.sqrt(2 * np.pi))
        ratio = np.logaddexp(np.log1p(-rate), np.log(rate) + (2 * z - 1) / (2 * sigma**2))
        value = np.log(np.trapezoid(np.exp(log_p + order * ratio), z)) / (order - 1)
        assert dp_train.sampled_renyi(rate, sigma, order) == pytest.approx(value, rel=1e-6)
    assert dp_train.sampled_renyi(1.0, 2.0, 5) == 5 / 8
    assert dp_train.sampled_renyi(1 - 1e-12, 2.0, 5) == pytest.approx(5 / 8)
    # sampling earns credit, and the multiplier is the least that stays within epsilon
    few, all_rows = dp_train.noise_multiplier(5.0, 1e-5, 40, 0.25), dp_train.noise_multiplier(5.0, 1e-5, 40)
    assert few < all_rows / 2
    assert dp_train.spent_epsilon(few, 0.25, 40, 1e-5) <= 5.0 < dp_train.spent_epsilon(few * 0.999, 0.25, 40, 1e-5)


def test_dp_logistic_repeats_and_skips_nulls(spark):
    df = spark.range(200).select("id", (F.col("id") / 200.0).alias("x")).withColumn("y", (F.col("x") > 0.5).cast("int"))
    nulls = spark.createDataFrame([(900, None, 1), (901, 0.5, None)], "id long, x double, y int")
    fit = lambda d: dp_train.dp_logistic_fit(d, ["x"], "y", 5.0, 1e-5, ["id"], "s", epochs=2, steps_per_epoch=1)
    one = fit(df.repartition(3))
    assert fit(df.repartition(7)).weights == pytest.approx(one.weights, abs=1e-12)
    wide = fit(df.unionByName(nulls))
    assert wide.weights == pytest.approx([w * 200 / 202 for w in one.weights], rel=0.2)
    empty = fit(df.limit(0))
    assert len(empty.weights) == 1 and abs(empty.intercept) < 100


# ---- synthesis and fidelity --------------------------------------------------------


def test_copula_keeps_rank_correlation(spark):
    df = spark.range(3000).select(normal("a", "x", ["id"]).alias("x"), normal("a", "y", ["id"]).alias("e")).select(
        "x", (F.col("x") * 0.8 + F.col("e") * 0.6).alias("y"), F.lit("t").alias("c")
    )
    out = sample_gaussian_copula(fit_gaussian_copula(df), "s", spark)
    row = out.agg(F.corr("x", "y"), F.count(F.lit(1)), F.count("x"), F.count("y")).first()
    assert abs(row[0] - 0.8) < 0.05 and row[1] == row[2] == row[3] == 3000
    assert out.select("x").join(df.select("x"), "x", "left_anti").count() == 0


def test_synthesize_refuses_unknown_method(spark):
    with pytest.raises(ValueError):
        synthesize(frame(spark, [(1.0,)], "v double"), "s", "gan")


def test_table_against_itself(spark):
    df = spark.range(200).select((F.col("id") % 17).cast("double").alias("a"), F.col("id").cast("double").alias("b"), (F.col("id") % 3).cast("string").alias("c"))
    assert measures.ks_statistic(df, df, ["a", "b"]).agg(F.max("ks")).first()[0] == 0.0
    assert abs(fidelity.js_divergence(df, df, ["c"]).first()["divergence"]) < 1e-9
    row = measures.utility_metrics(df, df).first()
    assert all(abs(v - 1.0) < 1e-6 for v in row)


def test_type_changed_column_is_compared_as_categories(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), F.lit("z").alias("c"))
    binned = disclosure.generalize_numeric(df, ["a"])
    assert measures.statistical_similarity(df, binned).first()[0] == pytest.approx(1.0)


# ---- nearest neighbours ------------------------------------------------------------


@pytest.mark.parametrize("n,m", [(50, 30), (6000, 9000)])
def test_nearest_matches_brute_force(spark, n, m):
    rng = np.random.default_rng(3)
    q, r = rng.normal(size=(n, 3)), rng.normal(size=(m, 3)) ** 3
    r[: m // 3] = r[0]
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "qid long, vec array<double>")
    refs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(r)], "rid long, vec array<double>")
    got = {x["qid"]: (x["distance"], x["rid"]) for x in nearest(queries, refs).collect()}
    assert len(got) == n
    for i in range(0, n, 37):
        d = np.sqrt(((r - q[i]) ** 2).sum(axis=1))
        assert got[i][0] == pytest.approx(d.min(), rel=1e-9) and got[i][1] == int(np.flatnonzero(d <= d.min() * (1 + 1e-12))[0])


def test_nearest_other_sees_copies_but_not_itself(spark):
    refs = frame(spark, [(1, [0.0]), (2, [0.0]), (3, [5.0])], "rid int, vec array<double>")
    queries = refs.withColumnRenamed("rid", "qid")
    got = {x["qid"]: x["distance"] for x in nearest(queries, refs, others_only=True).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 5.0}


# ---- attacks -----------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 37, 400])
def test_exact_sample_size(spark, n):
    df = spark.range(400)
    rows = [r["id"] for r in attacks.exact_sample(df, n, ["id"], "s").collect()]
    assert len(rows) == n == len(set(rows))


def test_membership_features_match_brute_force(spark):
    rng = np.random.default_rng(5)
    # 12,000 rows, a third of them equal: deep enough for several narrowing passes
    ref = [(float(a), str(int(b))) for a, b in zip(rng.exponential(size=8000), rng.integers(0, 4, 8000))] + [(1.0, None)] * 4000
    asked = [(i, 1.0 if i == 3 else float(a), "1" if i else None) for i, a in enumerate(rng.exponential(size=20))]
    out = attacks.membership_features(frame(spark, asked, "id int, a double, c string"), frame(spark, ref, "a double, c string"), ["a", "c"], "id")
    a = np.array([x[0] for x in ref])
    for row in out.collect():
        _, v, c = asked[row["id"]]
        d = (np.abs(a - v) / np.maximum(np.maximum(np.abs(a), abs(v)), 1e-8) + np.array([0.0 if c is not None and x[1] == c else 1.0 for x in ref])) / 2
        assert row["d_min"] == pytest.approx(d.min()) and row["d_mean"] == pytest.approx(d.mean()) and row["d_std"] == pytest.approx(d.std())
        assert row["d_p25"] == pytest.approx(np.percentile(d, 25)) and row["d_p75"] == pytest.approx(np.percentile(d, 75))


def test_overall_risk_defaults_to_medium(spark):
    none = frame(spark, [], "attack_type string, risk_level string")
    assert attacks.overall_risk(none).first()[0] == 0.5


def test_identity_release_is_linkable(spark):
    df = spark.range(300).select("id", normal("s", "a", ["id"]).alias("a"), normal("s", "b", ["id"]).alias("b"), (F.col("id") % 5).cast("string").alias("c"))
    row = attacks.linkage_risk(df, df, ["a", "b", "c"], "id", "s").first()
    assert row["success_rate"] == 1.0 and row["risk_level"] == "high" and row["attempted_links"] == 30


# ---- quality and search ------------------------------------------------------------


def test_structure_of_an_empty_table(spark):
    rows = quality.check_structure(frame(spark, [], "a int, b int")).collect()
    assert [r["check"] for r in rows] == ["empty"] and rows[0]["severity"] == "error"


def test_skewness_is_bias_corrected(spark):
    df = frame(spark, [(float(v),) for v in (1, 2, 3, 10)], "v double")
    assert quality.skewness(df, minimum=1).first()["skewness"] == pytest.approx(1.7636, abs=1e-4)


def test_all_null_rows_are_duplicates(spark):
    assert quality.duplicate_rows(frame(spark, [(None, None), (None, None)], "a int, b string")).first()["duplicate_rows"] == 1


def test_sensitive_rules_in_order(spark):
    rows = [(f"u{i}@x.org", f"555-123-{1000 + i}", f"K-{i}", f"word {i}", "a") for i in range(40)] + [(None, None, None, None, "a")]
    df = frame(spark, rows, "mail string, tel string, code string, remark string, customer_age string")
    found = {r["column"]: (r["reason"], r["confidence"]) for r in quality.detect_sensitive_columns(df).collect()}
    assert found == {
        "mail": ("email_pattern", "high"), "tel": ("phone_pattern", "high"), "code": ("potential_identifier", "medium"),
        "customer_age": ("sensitive_keyword_in_name", "high"),
    }


def test_many_columns_are_split_over_several_aggregates(spark, monkeypatch):
    monkeypatch.setattr(measures, "PAIRS_AT_ONCE", 4)
    monkeypatch.setattr(quality, "COLUMNS_PER_JOB", 4)
    df = spark.range(30).select(*[(F.col("id") * i % 7).cast("double").alias(f"c{i}") for i in range(1, 7)])
    assert measures.correlations(df, df.columns).count() == 15 and measures.correlation_preservation(df, df).first()[0] == pytest.approx(1.0)
    assert {r["n"] for r in quality.distinct_per_column(df).collect()} == {7}


def test_text_kinds(spark):
    df = frame(spark, [("$1,200", "2024-01-02"), ("5%", "01/02/2024"), ("abc", "x")], "n string, d string")
    rows = {r["column"]: r for r in quality.infer_text_kind(df).collect()}
    assert rows["n"]["kind"] == "text" and rows["n"]["mixed"] and rows["n"]["numeric_share"] == pytest.approx(2 / 3)
    assert rows["d"]["date_share"] == pytest.approx(2 / 3)


def test_parameter_grid():
    grid = search.parameter_grid("full", "high")
    assert len(grid) == 9 and grid[0] == {"epsilon": 0.1, "delta": 1e-5, "synthetic_epochs": 300, "synthetic_batch_size": 500, "k_anonymity": 5, "suppression_threshold": 0.05}
    assert "k_anonymity" not in search.parameter_grid("dp")[0] and search.default_parameters("other")["epsilon"] == 0.1


def test_random_points_stay_in_range(spark):
    points = search.random_points(spark, "sdc", 30, "s")
    assert len(points) == 30 and all(0.01 <= p["epsilon"] <= 10 and 1e-8 <= p["delta"] <= 1e-3 and 3 <= p["k_anonymity"] <= 10 for p in points)


def test_convergence_and_sensitivity(spark):
    rows = [(i, float(i), s) for i, s in enumerate([1.0, 0.5, 0.8, 0.25])]
    history = frame(spark, rows, "iteration int, epsilon double, objective_score double")
    assert search.convergence_rate(history).first()[0] == pytest.approx((0.5 + 0 + 0.5) / 3)
    assert search.convergence_rate(history.limit(1)).first()[0] == 0.0
    assert search.parameter_sensitivity(history, ["epsilon"]).count() == 0


def test_sensitivity_of_parameters_that_do_not_vary(spark):
    rows = [("a", 1.0, float(i % 3), float(i % 3)) for i in range(12)] + [("b", float(i), 0.1, 0.3) for i in range(12)] + [("c", 0.1, 0.1, 0.1)] * 2
    history = frame(spark, rows, "search string, epsilon double, delta double, objective_score double")
    found = {(r["search"], r["parameter"]): r["sensitivity"] for r in search.parameter_sensitivity(history, ["epsilon", "delta"], ["search"]).collect()}
    assert found == {("a", "epsilon"): 0.0, ("a", "delta"): pytest.approx(1.0), ("b", "epsilon"): 0.0, ("b", "delta"): 0.0}


def test_domain_counts_null_as_a_value(spark):
    df = frame(spark, [("b",), (None,), ("a",), ("b",)], "v string")
    d = domains.fit_domain(df, "v")
    assert d.values == ["a", "b"] and d.counts == [1, 2] and d.nulls == 1 and d.k == 3


def test_a_target_of_many_classes_gets_a_score(spark):
    df = spark.range(1500).select("id", (F.col("id") % 150).cast("string").alias("target"), (F.col("id") % 150).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    row = attacks.attribute_risk(df, "id", "s", ["target"], trees=5).first()
    assert row["accuracy"] > 0.05 and abs(row["baseline_accuracy"] - 1 / 150) < 1e-9
    found = attacks.assess_attacks(df, df, ["target", "a", "b"], "id", "s", ["attribute"], targets=["target"], trees=5).first()
    assert found["risk_level"] in {"low", "medium", "high"} and found["score"] > 0.04


def test_membership_features_in_blocks(spark, monkeypatch):
    from cloakframe.operators import distances

    df = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 1.5).alias("a"), F.concat(F.lit("c"), F.col("id") % 3).alias("c"))
    whole = attacks.membership_features(df, df, ["a", "c"], "k").orderBy("k").collect()
    monkeypatch.setattr(distances, "QUERY_BLOCK", 25)
    assert attacks.membership_features(df, df, ["a", "c"], "k").orderBy("k").collect() == whole
    monkeypatch.setattr(distances, "REFERENCE_PART", 20)
    split = attacks.membership_features(df, df, ["a", "c"], "k").orderBy("k").collect()
    assert [tuple(r) for r in split] == [pytest.approx(tuple(r)) for r in whole]


def test_membership_features_without_reference_and_with_equal_queries(spark):
    asked = frame(spark, [(1, 2.0, "x"), (1, 2.0, "x"), (2, None, None)], "id int, a double, c string")
    none = attacks.membership_features(asked, asked.where("id > 9"), ["a", "c"], "id").orderBy("id").collect()
    assert [tuple(r) for r in none] == [(1, *[None] * 5), (1, *[None] * 5), (2, *[None] * 5)]
    some = attacks.membership_features(asked, asked, ["a", "c"], "id").orderBy("id").collect()
    assert [(r["id"], r["d_min"]) for r in some] == [(1, 0.0), (1, 0.0), (2, 1.0)]
    assert attacks.membership_features(asked.where("id > 9"), asked, ["a", "c"], "id").count() == 0


def test_membership_counts_are_one_row_for_a_block_and_a_part(spark, monkeypatch):
    from cloakframe.operators import distances

    rng = np.random.default_rng(3)
    q = pd.DataFrame({"row": range(50), "n0": rng.normal(size=50), "prefix": [[0, 0]] * 50})
    out = distances._counter(["n0"], [], 0)((4, 2), q, pd.DataFrame({"row": range(900), "n0": rng.normal(size=900)}))
    assert len(out) == 1 and (out["block"][0], out["part"][0]) == (4, 2)
    # equal queries, several parts and as many narrowing passes as there can be
    monkeypatch.setattr(distances, "REFERENCE_PART", 300)
    monkeypatch.setattr(distances, "_LISTED", 0)
    ref = [float(v) for v in rng.exponential(size=700)] + [2.0] * 300
    asked = [(i, None if i % 3 == 0 else 2.0 if i % 3 == 1 else float(i)) for i in range(30)]
    found = attacks.membership_features(frame(spark, asked, "id int, a double"), frame(spark, [(v,) for v in ref], "a double"), ["a"], "id").collect()
    assert sorted(r["id"] for r in found) == list(range(30))
    for row in found:
        v = asked[row["id"]][1]
        d = np.ones(1000) if v is None else np.abs(np.array(ref) - v) / np.maximum(np.array(ref), v)
        assert tuple(row)[1:] == pytest.approx((d.min(), d.mean(), d.std(), np.percentile(d, 25), np.percentile(d, 75)), abs=1e-7)


def test_crowds_of_blocks_meet_a_part_in_one_task(spark, monkeypatch):
    from cloakframe.operators import distances

    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 1.5).alias("a"), F.concat(F.lit("c"), F.col("id") % 3).alias("c"))
    asked = df.where("k % 4 = 0")
    whole = attacks.membership_features(asked, df, ["a", "c"], "k").orderBy("k").collect()
    monkeypatch.setattr(distances, "QUERY_BLOCK", 10)
    monkeypatch.setattr(distances, "REFERENCE_PART", 40)
    monkeypatch.setattr(distances, "TASKS_PER_CORE", 1)  # 10 blocks and 10 runs for 8 tasks: 3 and 3 together
    monkeypatch.setattr(distances, "_LISTED", 0)
    narrower = distances._narrower

    def few(ranks, level, state):
        narrow = narrower(ranks, level, state)

        def checked(q, found):
            assert len(found) == 4, f"{len(found)} rows of counts of a block"
            return narrow(q, found)

        return checked

    monkeypatch.setattr(distances, "_narrower", few)
    split = attacks.membership_features(asked, df, ["a", "c"], "k").orderBy("k").collect()
    assert [tuple(r) for r in split] == [pytest.approx(tuple(r)) for r in whole]


def test_a_forest_is_fitted_in_even_tasks(spark, monkeypatch):
    monkeypatch.setattr(attacks, "FOREST_ALONE", 200)
    monkeypatch.setattr(attacks, "FOREST_ROWS", 100)
    sizes, fit = [], attacks.RandomForestClassifier.fit

    def recorded(self, rows):
        sizes.append([r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()])
        return fit(self, rows)

    monkeypatch.setattr(attacks.RandomForestClassifier, "fit", recorded)
    df = spark.range(1500).coalesce(1).select("id", (F.col("id") % 3).cast("string").alias("target"), (F.col("id") % 3).cast("double").alias("a"))
    found = [attacks.attribute_risk(df, "id", "s", ["target"], trees=5).first() for _ in range(2)]
    assert found[0] == found[1] and found[0]["accuracy"] == 1.0
    assert sum(sizes[0]) > 900 and len(sizes[0]) == -(-sum(sizes[0]) // 100) and max(sizes[0]) <= 100


def test_counts_of_many_parts_meet_in_two_steps(spark, monkeypatch):
    from cloakframe.operators import distances

    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 1.5).alias("a"), F.concat(F.lit("c"), F.col("id") % 3).alias("c"))
    asked = df.where("k % 20 = 0")
    whole = attacks.membership_features(asked, df, ["a", "c"], "k").orderBy("k").collect()
    monkeypatch.setattr(distances, "REFERENCE_PART", 8)  # 50 parts
    narrower = distances._narrower

    def few(ranks, level, state):
        narrow = narrower(ranks, level, state)

        def checked(q, found):
            assert len(found) <= 8, f"{len(found)} rows of counts in one task"
            return narrow(q, found)

        return checked

    monkeypatch.setattr(distances, "_narrower", few)
    split = attacks.membership_features(asked, df, ["a", "c"], "k").orderBy("k").collect()
    assert [tuple(r) for r in split] == [pytest.approx(tuple(r)) for r in whole]
