"""Differential-privacy mechanisms and budget accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budget as budget_ops
from ..operators import noise as ops
from ..operators.dp_train import dp_logistic_fit as fit_logistic
from ..operators.dp_train import noise_multiplier
from .base import SALT, one_value, r, rounded, sql_alias, sql_bin, sql_drawn, sql_flip, sql_laplace, sql_normal, sql_uniform, table


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


def _customers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")


def global_sensitivity(spark, sf):
    return rounded(one_value(spark, sensitivity=ops.global_sensitivity(_orders(spark, sf), ["o_totalprice", "o_orderstatus"])))


def gaussian_mechanism(spark, sf):
    return rounded(ops.gaussian_mechanism(_orders(spark, sf), 0.5, 1e-5, ["o_orderkey"], SALT), 2)


def laplace_mechanism(spark, sf):
    return rounded(ops.laplace_mechanism(_customers(spark, sf), 1.0, ["c_custkey"], SALT), 4)


def randomized_response(spark, sf):
    return ops.randomized_response(_orders(spark, sf).select("o_orderkey", "o_orderpriority"), "o_orderpriority", 1.0, ["o_orderkey"], SALT)


def randomized_response_large(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name")
    return ops.randomized_response(df, "c_name", 5.0, ["c_custkey"], SALT)


def exponential_mechanism(spark, sf):
    return ops.exponential_mechanism(_orders(spark, sf).select("o_orderkey", "o_orderpriority"), "o_orderpriority", 0.05, ["o_orderkey"], SALT)


def exponential_large(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"))
    return ops.exponential_mechanism(df, "customer", 0.5, ["o_orderkey"], SALT)


def exponential_numeric(spark, sf):
    return ops.exponential_numeric(_customers(spark, sf).select("c_custkey", "c_acctbal"), "c_acctbal", 0.01, ["c_custkey"], SALT)


def apply_dp(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    bounds = {"p_size": (5.0, 45.0), "p_retailprice": (900.0, 1500.0)}
    return rounded(ops.apply_dp(df, 6.0, 1e-5, ["p_partkey"], SALT, "laplace", bounds=bounds, split="columns"), 4)


def _operations(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("ts").alias("timestamp"),
        (k / F.lit(100.0)).alias("epsilon"), (k * F.lit(1e-6)).alias("delta"),
        F.when(k % 3 == 0, "gaussian").when(k % 3 == 1, "laplace").alias("mechanism"), (k % 5 + 1).alias("queries"), "event_id",
    )


_K = "(json_extract(props, '$.k')::INT)"
OPERATIONS = (
    f"SELECT user_id::VARCHAR AS session_id, ts AS timestamp, {_K} / 100.0::DOUBLE AS epsilon, {_K} * 1e-6::DOUBLE AS delta, "
    f"CASE {_K} % 3 WHEN 0 THEN 'gaussian' WHEN 1 THEN 'laplace' END AS mechanism, {_K} % 5 + 1 AS queries, event_id FROM events"
)


def budget_ledger(spark, sf):
    ledger = budget_ops.budget_ledger(_operations(spark, sf))
    return rounded(ledger.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")))


def budget_totals(spark, sf):
    return rounded(budget_ops.budget_totals(_operations(spark, sf)))


def budget_remaining(spark, sf):
    return rounded(budget_ops.budget_remaining(_operations(spark, sf), 40.0, 4e-3))


def privacy_loss(spark, sf):
    df = _operations(spark, sf).withColumn("mechanism", F.coalesce("mechanism", F.lit("unknown")))
    return rounded(budget_ops.privacy_loss(df).select("event_id", "mechanism", "epsilon_loss", "delta_loss"), 9)


def dp_logistic_fit(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 500_000.0).alias("price"), (F.col("o_custkey") % 10 / 10.0).alias("group"),
        (F.col("o_totalprice") > 250_000).cast("int").alias("label"),
    )
    model = fit_logistic(df, ["price", "group"], "label", 5.0, 1e-5, ["o_orderkey"], SALT, learning_rate=1.0)
    scored = model.predict(df)
    return rounded(scored.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.avg("probability").alias("mean_probability")))


def _sql_dp_logistic(steps: int = 40, rate: float = 0.25) -> str:
    """The training of :func:`dp_logistic_fit`, one CTE per step."""
    sigma = noise_multiplier(5.0, 1e-5, steps, rate)
    inputs = ["price", "grp", "1.0::DOUBLE"]
    score = lambda w: f"({w}.w0 * price + {w}.w1 * grp + {w}.w2)"
    parts = [
        "d AS MATERIALIZED (SELECT o_orderkey, o_totalprice / 500000.0::DOUBLE AS price, (o_custkey % 10) / 10.0::DOUBLE AS grp, (o_totalprice > 250000)::INT AS label FROM orders)",
        "w_0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2)",
    ]
    for t in range(steps):
        rows = (
            f"SELECT price, grp, e, least(1.0::DOUBLE, 1.0::DOUBLE / greatest(sqrt(price * price + grp * grp + 1.0::DOUBLE) * abs(e), 1e-12::DOUBLE)) AS shrink FROM "
            f"(SELECT price, grp, 1.0::DOUBLE / (1.0::DOUBLE + exp(-{score(f'w_{t}')})) - label AS e FROM d, w_{t} WHERE {sql_uniform(SALT, f'step:{t}', 'o_orderkey')} < {rate})"
        )
        noise = [f"{sql_normal(SALT, f'noise:{t}', str(i))} * {sigma!r}::DOUBLE" for i in range(3)]
        sums = ", ".join(f"coalesce(sum({x} * e * shrink), 0.0) + {noise[i]} AS g{i}" for i, x in enumerate(inputs))
        moved = ", ".join(f"w{i} - g{i} / greatest(1.0::DOUBLE, {rate}::DOUBLE * (SELECT count(*) FROM d)) AS w{i}" for i in range(3))
        parts.append(f"w_{t + 1} AS MATERIALIZED (SELECT {moved} FROM w_{t}, (SELECT {sums} FROM ({rows})))")
    probability = f"avg(1.0::DOUBLE / (1.0::DOUBLE + exp(-{score(f'w_{steps}')})))"
    return f"WITH {', '.join(parts)} SELECT label, count(*) AS rows, {r(probability)} AS mean_probability FROM d, w_{steps} GROUP BY label"


_EXP = "floor(exp({0}::DOUBLE * (n - (SELECT max(n) FROM n))) * 1152921504606846976.0::DOUBLE)"


_SIGMA = "(sqrt(2 * ln(1.25::DOUBLE / 1e-5::DOUBLE)) * (SELECT max(o_totalprice) - min(o_totalprice) FROM orders) / 0.5::DOUBLE)"
_PRIORITY = "SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1"
_BIN = sql_bin("c_acctbal", "(SELECT min(c_acctbal) FROM customer)", "(SELECT max(c_acctbal) FROM customer)", 10)
_clip = lambda c, lo, hi: f"least(greatest({c}::DOUBLE, {lo}), {hi})"

QUERIES = {
    f.__name__: f
    for f in (
        global_sensitivity, gaussian_mechanism, laplace_mechanism, randomized_response, randomized_response_large, exponential_mechanism,
        exponential_large, exponential_numeric, apply_dp, budget_ledger, budget_totals, budget_remaining, privacy_loss, dp_logistic_fit,
    )
}

ORACLES = {
    "dp_logistic_fit": _sql_dp_logistic(),
    "global_sensitivity": f"SELECT {r('greatest(max(o_totalprice) - min(o_totalprice), 1.0)')} AS sensitivity FROM orders",
    "gaussian_mechanism": f"SELECT o_orderkey, {r('o_totalprice + ' + sql_normal(SALT, 'gauss:o_totalprice', 'o_orderkey') + ' * ' + _SIGMA, 2)} AS o_totalprice, "
    f"{sql_flip('orders', 'o_orderstatus', 'o_orderkey', 0.5, SALT)} AS o_orderstatus, {sql_flip('orders', 'o_orderpriority', 'o_orderkey', 0.5, SALT)} AS o_orderpriority FROM orders",
    "laplace_mechanism": "SELECT c_custkey, "
    + r("c_acctbal + " + sql_laplace(SALT, "lap:c_acctbal", "c_custkey", "(SELECT max(c_acctbal) - min(c_acctbal) FROM customer)"), 4)
    + f" AS c_acctbal, {sql_flip('customer', 'c_mktsegment', 'c_custkey', 1.0, SALT)} AS c_mktsegment FROM customer",
    "randomized_response": f"SELECT o_orderkey, {sql_flip('orders', 'o_orderpriority', 'o_orderkey', 1.0, SALT)} AS o_orderpriority FROM orders",
    "randomized_response_large": f"SELECT c_custkey, {sql_flip('customer', 'c_name', 'c_custkey', 5.0, SALT)} AS c_name FROM customer",
    "exponential_mechanism": f"WITH n AS ({_PRIORITY}), {sql_alias('c', 'SELECT * FROM n', _EXP.format('0.025'))} "
    + sql_drawn("c", "orders", sql_uniform(SALT, "exp:o_orderpriority", "o_orderkey"), "o_orderkey", "o_orderpriority"),
    "exponential_large": f"WITH n AS (SELECT o_custkey::VARCHAR AS v, count(*) AS n FROM orders GROUP BY 1), {sql_alias('c', 'SELECT * FROM n', _EXP.format('0.25'))} "
    + sql_drawn("c", "orders", sql_uniform(SALT, "exp:customer", "o_orderkey"), "o_orderkey", "customer"),
    "exponential_numeric": f"WITH b AS (SELECT c_custkey, {_BIN} AS bin FROM customer), n AS (SELECT bin AS v, count(*) AS n FROM b GROUP BY 1), {sql_alias('c', 'SELECT * FROM n', _EXP.format('0.005'))} "
    f"SELECT c_custkey, c_acctbal::INT AS c_acctbal FROM ({sql_drawn('c', 'b', sql_uniform(SALT, 'exp:c_acctbal', 'c_custkey'), 'c_custkey', 'c_acctbal')})",
    "apply_dp": f"SELECT p_partkey, {r(_clip('p_size', 5.0, 45.0) + ' + ' + sql_laplace(SALT, 'lap:p_size', 'p_partkey', '40.0 / 2.0'), 4)} AS p_size, "
    f"{r(_clip('p_retailprice', 900.0, 1500.0) + ' + ' + sql_laplace(SALT, 'lap:p_retailprice', 'p_partkey', '600.0 / 2.0'), 4)} AS p_retailprice, "
    f"{sql_flip('part', 'p_type', 'p_partkey', 2.0, SALT)} AS p_type FROM part",
    "budget_ledger": f"SELECT session_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, {r('epsilon')} AS epsilon, {r('delta')} AS delta, coalesce(mechanism, 'unknown') AS mechanism FROM ({OPERATIONS})",
    "budget_totals": f"SELECT session_id, {r('sum(epsilon)')} AS total_epsilon, {r('sum(delta)')} AS total_delta, count(*) AS operations FROM ({OPERATIONS}) GROUP BY 1",
    "budget_remaining": f"WITH t AS (SELECT session_id, sum(epsilon) AS e, sum(delta) AS d FROM ({OPERATIONS}) GROUP BY 1) SELECT session_id, {r('e')} AS epsilon_used, {r('d')} AS delta_used, "
    f"{r('greatest(0.0, 40.0::DOUBLE - e)')} AS epsilon_remaining, {r('greatest(0.0, 4e-3::DOUBLE - d)')} AS delta_remaining, "
    f"{r('least(100.0, e / 40.0::DOUBLE * 100)')} AS epsilon_percent, {r('least(100.0, d / 4e-3::DOUBLE * 100)')} AS delta_percent FROM t",
    "privacy_loss": "SELECT event_id, coalesce(mechanism, 'unknown') AS mechanism, "
    + r("CASE WHEN mechanism = 'gaussian' AND delta <= 0 THEN 'infinity'::DOUBLE WHEN mechanism = 'gaussian' THEN epsilon * sqrt(2.0::DOUBLE * queries * ln(1.0::DOUBLE / delta)) ELSE epsilon * queries END", 9)
    + " AS epsilon_loss, " + r("CASE WHEN mechanism = 'laplace' THEN 0.0 ELSE delta * queries END", 9) + f" AS delta_loss FROM ({OPERATIONS})",
}
