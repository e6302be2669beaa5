"""Synthetic tables and their fidelity to the original."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fidelity as fid
from ..operators import synthesis as ops
from ..operators.disclosure import generalize_categorical, suppress_rare_combinations
from ..operators.noise import laplace_mechanism
from ..session import materialize
from .base import SALT, r, rounded, sql_alias, sql_drawn, sql_flip, sql_laplace, sql_normal, sql_uniform, table

PART = ["p_partkey", "p_size", "p_retailprice", "p_type", "p_brand"]


def part_pair(spark, sf):
    """(original, derived) parts: noised numbers, flipped types, folded brands, rare combinations dropped."""
    original = table(spark, sf, "part").select(*PART)
    noisy = laplace_mechanism(original, 5.0, ["p_partkey"], "s2", 50.0, ["p_size", "p_retailprice", "p_type"])
    folded = generalize_categorical(noisy, ["p_brand"], 0.0375)
    return original, materialize(suppress_rare_combinations(folded, ["p_brand", "p_type"], 16), "derived")


_RARE = "SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= (SELECT count(*) FROM part) * 0.0375::DOUBLE"
# CTEs ``o`` (original) and ``d`` (derived) of part_pair.
PAIR = (
    "o AS (SELECT p_partkey, p_size, p_retailprice, p_type, p_brand FROM part), "
    f"m AS MATERIALIZED (SELECT p_partkey, p_size + {sql_laplace('s2', 'lap:p_size', 'p_partkey', '10.0')} AS p_size, "
    f"p_retailprice + {sql_laplace('s2', 'lap:p_retailprice', 'p_partkey', '10.0')} AS p_retailprice, "
    f"{sql_flip('part', 'p_type', 'p_partkey', 5.0, 's2')} AS p_type, "
    f"CASE WHEN p_brand IN ({_RARE}) THEN p_brand ELSE 'Other' END AS p_brand FROM part), "
    "d AS MATERIALIZED (SELECT p_partkey, p_size, p_retailprice, p_type, p_brand FROM "
    "(SELECT *, count(*) OVER (PARTITION BY p_brand, p_type) AS n FROM m) WHERE n >= 16)"
)


def _customers(spark, sf):
    return table(spark, sf, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment")


def fit_marginals(spark, sf):
    return rounded(ops.marginal_table(_customers(spark, sf)))


def sample_marginals(spark, sf):
    return rounded(ops.sample_marginals(ops.fit_marginals(_customers(spark, sf)), SALT, spark, row_id=True))


def sample_large_domain(spark, sf):
    fit = ops.fit_marginals(table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("customer")))
    return ops.sample_marginals(fit, SALT, spark, row_id=True)


def synthesize(spark, sf):
    df = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("o_totalprice"), "o_orderdate", "o_orderpriority"
    )
    return rounded(ops.synthesize(df, SALT), 2)


def sample_gaussian_copula(spark, sf):
    df = table(spark, sf, "part").select("p_size", "p_retailprice", (F.col("p_retailprice") * 2 + F.col("p_size")).alias("blend"), "p_type")
    return rounded(ops.sample_gaussian_copula(ops.fit_gaussian_copula(df), SALT, spark))


def correlation_of_correlations(spark, sf):
    return rounded(fid.correlation_of_correlations(*part_pair(spark, sf)))


def js_divergence(spark, sf):
    return rounded(fid.js_divergence(*part_pair(spark, sf), ["p_type", "p_brand"]))


def distribution_fidelity(spark, sf):
    return rounded(fid.distribution_fidelity(*part_pair(spark, sf)))


def statistic_fidelity(spark, sf):
    return rounded(fid.statistic_fidelity(*part_pair(spark, sf)))


def dcr(spark, sf):
    return rounded(fid.dcr(*part_pair(spark, sf), "p_partkey", "p_partkey"))


def nndr(spark, sf):
    return rounded(fid.nndr(*part_pair(spark, sf), "p_partkey", "p_partkey"))


def synthetic_quality(spark, sf):
    return rounded(fid.synthetic_quality(*part_pair(spark, sf), "p_partkey", "p_partkey"))


def _normal_draw(column: str, source: str) -> str:
    lo, hi, mean, std = (f"(SELECT {f}({column})::DOUBLE FROM {source})" for f in ("min", "max", "avg", "stddev_samp"))
    return f"greatest({lo}, least({hi}, {mean} + {sql_normal(SALT, 'syn:' + column, 'i')} * {std}))"


def _category_cte(name: str, column: str, source: str) -> str:
    return sql_alias(name, f"SELECT {column} AS v, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1")


def _category_draw(name: str, column: str) -> str:
    at = f"{sql_uniform(SALT, 'syn:' + column, 'i')} * (SELECT count(*) FROM {name})::DOUBLE"
    return f"(SELECT CASE WHEN {at} - idx < keep THEN v ELSE other END FROM {name} WHERE idx = least(floor({at})::BIGINT, (SELECT count(*) FROM {name}) - 1))"


def sql_ks(column: str) -> str:
    """Two-sample KS statistic of ``o`` and ``d``."""
    return (
        f"(SELECT max(abs(co / (SELECT count({column}) FROM o)::DOUBLE - cd / (SELECT count({column}) FROM d)::DOUBLE)) FROM "
        f"(SELECT v, sum(sum(a)) OVER (ORDER BY v) AS co, sum(sum(b)) OVER (ORDER BY v) AS cd FROM "
        f"(SELECT {column}::DOUBLE AS v, 1 AS a, 0 AS b FROM o UNION ALL SELECT {column}::DOUBLE, 0, 1 FROM d) WHERE v IS NOT NULL GROUP BY v))"
    )


def sql_shares(column: str) -> str:
    """(p, q) of every value of a column on the two sides."""
    return (
        f"(SELECT coalesce(a.p, 0) AS p, coalesce(b.q, 0) AS q FROM (SELECT {column} AS v, count(*) / (SELECT count({column}) FROM o)::DOUBLE AS p FROM o WHERE {column} IS NOT NULL GROUP BY 1) a "
        f"FULL OUTER JOIN (SELECT {column} AS v, count(*) / (SELECT count({column}) FROM d)::DOUBLE AS q FROM d WHERE {column} IS NOT NULL GROUP BY 1) b ON a.v = b.v)"
    )


def sql_jsd(column: str) -> str:
    return (
        "(SELECT sum(0.5::DOUBLE * (pp * ln(pp / mm) + qq * ln(qq / mm))) FROM (SELECT p + 1e-10::DOUBLE AS pp, q + 1e-10::DOUBLE AS qq, "
        f"(p + q + 2e-10::DOUBLE) * 0.5::DOUBLE AS mm FROM {sql_shares(column)}))"
    )


def sql_moments(column: str, clamp: bool) -> str:
    parts = []
    for f in ("avg", "stddev_samp"):
        a, b = f"(SELECT {f}({column}::DOUBLE) FROM o)", f"(SELECT {f}({column}::DOUBLE) FROM d)"
        v = f"(1.0::DOUBLE - abs({a} - {b}) / (abs({a}) + 1e-8::DOUBLE))"
        parts.append(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {v}))" if clamp else v)
    return f"(({parts[0]} + {parts[1]}) / 2.0::DOUBLE)"


def sql_mode_match(column: str) -> str:
    mode = lambda t: f"(SELECT {column} FROM {t} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    return f"(CASE WHEN {mode('o')} = {mode('d')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


NUMBERS, TEXTS = ["p_partkey", "p_size", "p_retailprice"], ["p_type", "p_brand"]


def _mean(parts: list[str]) -> str:
    return f"(({' + '.join(parts)}) / {len(parts)}.0::DOUBLE)"


def sql_distribution_fidelity(numbers: list[str]) -> str:
    return _mean([f"(1.0::DOUBLE - {sql_ks(c)})" for c in numbers] + [f"(1.0::DOUBLE - {sql_jsd(c)})" for c in TEXTS])


def sql_statistic_fidelity(numbers: list[str]) -> str:
    return _mean([sql_moments(c, False) for c in numbers] + [sql_mode_match(c) for c in TEXTS])


def sql_corr_of_corr(numbers: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(numbers) for b in numbers[i + 1 :]]
    rows = " UNION ALL ".join(f"SELECT (SELECT corr({a}::DOUBLE, {b}::DOUBLE) FROM o) AS x, (SELECT corr({a}::DOUBLE, {b}::DOUBLE) FROM d) AS y" for a, b in pairs)
    return f"(SELECT coalesce(CASE WHEN isnan(corr(x, y)) THEN 0.0 ELSE corr(x, y) END, 0.0::DOUBLE) FROM ({rows}))"


_Z = ", ".join(
    f"({{t}}.{c} - (SELECT avg({c}::DOUBLE) FROM o)) / (SELECT stddev_pop({c}::DOUBLE) FROM o) AS z{i}" for i, c in enumerate(["p_size", "p_retailprice"])
)
NEIGHBOURS = (
    f"zo AS MATERIALIZED (SELECT p_partkey AS id, {_Z.format(t='o')} FROM o), zd AS MATERIALIZED (SELECT p_partkey AS id, {_Z.format(t='d')} FROM d), "
    "near_o AS MATERIALIZED (SELECT a.id, min((a.z0 - b.z0) * (a.z0 - b.z0) + (a.z1 - b.z1) * (a.z1 - b.z1)) AS d2 FROM zd a, zo b GROUP BY 1), "
    "near_d AS MATERIALIZED (SELECT a.id, min((a.z0 - b.z0) * (a.z0 - b.z0) + (a.z1 - b.z1) * (a.z1 - b.z1)) AS d2 FROM zd a, zd b WHERE a.id <> b.id GROUP BY 1)"
)
SQL_DCR = "(SELECT avg(sqrt(d2)) / sqrt(2.0::DOUBLE) FROM near_o)"
SQL_NNDR = "(SELECT avg(sqrt(near_o.d2) / (sqrt(near_d.d2) + 1e-8::DOUBLE)) FROM near_o JOIN near_d USING (id))"

QUERIES = {
    f.__name__: f
    for f in (
        fit_marginals, sample_marginals, sample_large_domain, synthesize, sample_gaussian_copula, correlation_of_correlations,
        js_divergence, distribution_fidelity, statistic_fidelity, dcr, nndr, synthetic_quality,
    )
}

_FILLED = (
    "f AS (SELECT coalesce(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END, "
    "(SELECT quantile_cont(CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END, 0.5) FROM orders)) AS o_totalprice, "
    "epoch(o_orderdate)::DOUBLE AS o_orderdate, o_orderpriority FROM orders)"
)

ORACLES = {
    "fit_marginals": "".join(
        f"SELECT '{c}' AS \"column\", NULL::VARCHAR AS value, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, "
        f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, NULL::DOUBLE AS share FROM customer UNION ALL "
        for c in ("c_acctbal", "c_nationkey")
    )
    + f"SELECT 'c_mktsegment', c_mktsegment, NULL, NULL, NULL, NULL, {r('count(*) / (SELECT count(*) FROM customer)::DOUBLE')} FROM customer GROUP BY c_mktsegment",
    "sample_marginals": f"WITH {_category_cte('seg', 'c_mktsegment', 'customer')} SELECT i AS row_id, {r(_normal_draw('c_acctbal', 'customer'))} AS c_acctbal, "
    f"{r(_normal_draw('c_nationkey', 'customer'))} AS c_nationkey, {_category_draw('seg', 'c_mktsegment')} AS c_mktsegment FROM range((SELECT count(*) FROM customer)) t(i)",
    "sample_large_domain": f"WITH {_category_cte('c', 'o_custkey::VARCHAR', 'orders')}, n AS (SELECT i FROM range((SELECT count(*) FROM orders)) t(i)) "
    + sql_drawn("c", "n", sql_uniform(SALT, "syn:customer", "i"), "i AS row_id", "customer"),
    "synthesize": f"WITH {_FILLED}, {_category_cte('pri', 'o_orderpriority', 'f')} SELECT {r(_normal_draw('o_totalprice', 'f'), 2)} AS o_totalprice, "
    f"{r(_normal_draw('o_orderdate', 'f'), 2)} AS o_orderdate, {_category_draw('pri', 'o_orderpriority')} AS o_orderpriority FROM range((SELECT count(*) FROM orders)) t(i)",
    "correlation_of_correlations": f"WITH {PAIR} SELECT {r(sql_corr_of_corr(NUMBERS))} AS correlation_of_correlations",
    "js_divergence": f"WITH {PAIR} SELECT 'p_type' AS \"column\", {r(sql_jsd('p_type'))} AS divergence UNION ALL SELECT 'p_brand', {r(sql_jsd('p_brand'))}",
    "distribution_fidelity": f"WITH {PAIR} SELECT {r(sql_distribution_fidelity(NUMBERS))} AS distribution_fidelity",
    "statistic_fidelity": f"WITH {PAIR} SELECT {r(sql_statistic_fidelity(NUMBERS))} AS statistic_fidelity",
    "dcr": f"WITH {PAIR}, {NEIGHBOURS} SELECT {r(SQL_DCR)} AS dcr",
    "nndr": f"WITH {PAIR}, {NEIGHBOURS} SELECT {r(SQL_NNDR)} AS nndr",
    "synthetic_quality": f"WITH {PAIR}, {NEIGHBOURS} SELECT {r(sql_corr_of_corr(NUMBERS[1:]))} AS correlation_of_correlations, {r(sql_distribution_fidelity(NUMBERS[1:]))} AS distribution_fidelity, "
    f"{r(sql_statistic_fidelity(NUMBERS[1:]))} AS statistic_fidelity, {r(SQL_DCR)} AS dcr, {r(SQL_NNDR)} AS nndr, {r(f'({SQL_DCR} + {SQL_NNDR}) / 2.0::DOUBLE')} AS privacy_score",
}
