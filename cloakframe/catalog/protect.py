"""Column protection and disclosure control."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns as ops
from ..operators import disclosure as sdc_ops
from .base import LEVELS_SQL, SALT, key_mod_null, r, rounded, sql_bin, sql_mod_null, table

KEY = b"0123456789abcdef"


def pseudonymize(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return ops.pseudonymize(df, ["c_name", "c_mktsegment"], SALT)


def pseudonymize_full(spark, sf):
    return ops.pseudonymize(table(spark, sf, "conversations"), ["text"], SALT, buckets=None)


def hash_column(spark, sf):
    return ops.hash_column(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text", "digest").drop("text")


def encrypt_column(spark, sf):
    df = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    sealed = ops.encrypt_column(df, "text", KEY, "sealed")
    opened = ops.decrypt_column(sealed, "sealed", KEY, "opened")
    hidden = (F.col("sealed") != F.col("text")).alias("hidden")
    return opened.select("conv_id", "turn", "opened", hidden)


def owner_filter(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return ops.owner_filter(df, 7)


def select_numeric(spark, sf):
    return ops.select_numeric(table(spark, sf, "orders"))


def select_categorical(spark, sf):
    return ops.select_categorical(table(spark, sf, "customer"))


def _gappy_customer(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", key_mod_null("c_acctbal", "c_custkey", 7).alias("c_acctbal"),
        key_mod_null("c_mktsegment", "c_custkey", 5).alias("c_mktsegment"),
    )


GAPPY_CUSTOMER = (
    f"SELECT c_custkey, {sql_mod_null('c_acctbal', 'c_custkey', 7)} AS c_acctbal, "
    f"{sql_mod_null('c_mktsegment', 'c_custkey', 5)} AS c_mktsegment FROM customer"
)


def impute(spark, sf):
    return rounded(ops.impute(_gappy_customer(spark, sf), ["c_acctbal", "c_mktsegment"]))


def datetime_to_epoch(spark, sf):
    return ops.datetime_to_epoch(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"))


def label_encode(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return ops.label_encode(part.filter(~F.col("p_name").startswith("red")), part, "p_name", "code")


def standard_scale(spark, sf):
    fit_on = table(spark, sf, "customer").select(F.col("c_acctbal").alias("acctbal"))
    return rounded(ops.standard_scale(fit_on, table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("acctbal")), ["acctbal"]))


def equal_width_bin(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ops.equal_width_bin(ops.equal_width_bin(df, "o_totalprice", 5, "bin5"), "o_totalprice", 10, "bin10")


def generalize_numeric(spark, sf):
    return sdc_ops.generalize_numeric(table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"])


def generalize_categorical(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_brand").alias("brand_default"))
    return sdc_ops.generalize_categorical(sdc_ops.generalize_categorical(df, ["p_brand"], 0.0375), ["brand_default"])


def _gappy_segments(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", key_mod_null("c_nationkey", "c_custkey", 11).alias("c_nationkey"), "c_mktsegment")


def suppress_rare_combinations(spark, sf):
    return sdc_ops.suppress_rare_combinations(_gappy_segments(spark, sf), ["c_nationkey", "c_mktsegment"], 8)


def suppress_default(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return sdc_ops.suppress_rare_combinations(df, ["p_brand", "p_type", "p_size"])


def microaggregate(spark, sf):
    return rounded(sdc_ops.microaggregate(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"]))


def microaggregate_ties(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", key_mod_null("p_size", "p_partkey", 13).alias("p_size"))
    return rounded(sdc_ops.microaggregate(df, "p_size", ["p_partkey"], 4, merge_tail=True))


def sdc(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    return rounded(sdc_ops.sdc(df, ["p_brand", "p_type", "p_size"], ["p_retailprice"], ["p_partkey"], 3, 0.0375))


def _fold(column: str, source: str, threshold: float) -> str:
    return (
        f"CASE WHEN {column} IN (SELECT {column} FROM {source} GROUP BY 1 "
        f"HAVING count(*) >= (SELECT count(*) FROM {source}) * {threshold}::DOUBLE) THEN {column} ELSE 'Other' END"
    )


def _level(column: str, source: str) -> str:
    low, high = (f"(SELECT {f}({column})::DOUBLE FROM {source})" for f in ("min", "max"))
    return f"{LEVELS_SQL}[{sql_bin(column, low, high, 5)} + 1]"


_TOKEN = "(('0x' || substr(sha256('s1|' || {c}), 1, 13))::BIGINT % 10000)"

QUERIES = {
    f.__name__: f
    for f in (
        pseudonymize, pseudonymize_full, hash_column, encrypt_column, owner_filter, select_numeric, select_categorical, impute,
        datetime_to_epoch, label_encode, standard_scale, equal_width_bin, generalize_numeric, generalize_categorical,
        suppress_rare_combinations, suppress_default, microaggregate, microaggregate_ties, sdc,
    )
}

ORACLES = {
    "pseudonymize": f"SELECT c_custkey, 'anon_' || {_TOKEN.format(c='c_name')} AS c_name, "
    f"'anon_' || {_TOKEN.format(c='c_mktsegment')} AS c_mktsegment FROM customer",
    "pseudonymize_full": "SELECT conv_id, turn, role, 'anon_' || sha256('s1|' || text) AS text FROM conversations",
    "hash_column": "SELECT conv_id, turn, sha256(text) AS digest FROM conversations",
    "encrypt_column": "SELECT conv_id, turn, text AS opened, true AS hidden FROM conversations",
    "owner_filter": "SELECT event_id, user_id, event_type FROM events WHERE user_id = 7",
    "select_numeric": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "select_categorical": "SELECT c_name, c_mktsegment FROM customer",
    "impute": f"WITH g AS ({GAPPY_CUSTOMER}) SELECT c_custkey, "
    + r("coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM g))")
    + " AS c_acctbal, coalesce(c_mktsegment, (SELECT c_mktsegment FROM g WHERE c_mktsegment IS NOT NULL GROUP BY 1 "
    "ORDER BY count(*) DESC, 1 LIMIT 1)) AS c_mktsegment FROM g",
    "datetime_to_epoch": "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS o_orderdate FROM orders",
    "label_encode": "WITH d AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::INT AS code FROM "
    "(SELECT DISTINCT p_name AS v FROM part WHERE NOT starts_with(p_name, 'red'))) "
    "SELECT p_partkey, p_name, coalesce(code, -1)::INT AS code FROM part LEFT JOIN d ON p_name = v",
    "standard_scale": "SELECT s_suppkey, "
    + r("(s_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer)")
    + " AS acctbal FROM supplier",
    "equal_width_bin": "WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT o_orderkey, o_totalprice, "
    f"{sql_bin('o_totalprice', 'lo', 'hi', 5)}::INT AS bin5, {sql_bin('o_totalprice', 'lo', 'hi', 10)}::INT AS bin10 FROM orders, m",
    "generalize_numeric": f"SELECT c_custkey, {_level('c_acctbal', 'customer')} AS c_acctbal, {_level('c_nationkey', 'customer')} AS c_nationkey FROM customer",
    "generalize_categorical": f"SELECT p_partkey, {_fold('p_brand', 'part', 0.0375)} AS p_brand, {_fold('p_brand', 'part', 0.05)} AS brand_default FROM part",
    "suppress_rare_combinations": f"WITH g AS (SELECT c_custkey, {sql_mod_null('c_nationkey', 'c_custkey', 11)} AS c_nationkey, c_mktsegment FROM customer) "
    "SELECT c_custkey, c_nationkey, c_mktsegment FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM g) WHERE n >= 8 OR c_nationkey IS NULL",
    "suppress_default": "SELECT p_partkey, p_brand, p_type, p_size FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS n FROM part) WHERE n >= 3",
    "microaggregate": "WITH k AS (SELECT o_orderkey, o_totalprice, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // 3 AS c FROM orders) "
    f"SELECT o_orderkey, {r('avg(o_totalprice) OVER (PARTITION BY c)')} AS o_totalprice FROM k",
    "microaggregate_ties": f"WITH g AS (SELECT p_partkey, {sql_mod_null('p_size', 'p_partkey', 13)} AS s FROM part), "
    "k AS (SELECT *, row_number() OVER (ORDER BY s, p_partkey) - 1 AS i, count(*) OVER () AS n FROM g WHERE s IS NOT NULL), "
    "m AS (SELECT p_partkey, avg(s) OVER (PARTITION BY least(i // 4, greatest(0, n // 4 - 1))) AS s FROM k) "
    f"SELECT g.p_partkey, {r('m.s')} AS p_size FROM g LEFT JOIN m ON g.p_partkey = m.p_partkey",
    "sdc": f"WITH g AS (SELECT p_partkey, {_fold('p_brand', 'part', 0.0375)} AS p_brand, {_fold('p_type', 'part', 0.0375)} AS p_type, {_level('p_size', 'part')} AS p_size, p_retailprice FROM part), "
    "s AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS n FROM g) WHERE n >= 3), "
    "k AS (SELECT *, (row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1) // 3 AS c FROM s) "
    f"SELECT p_partkey, p_brand, p_type, p_size, {r('avg(p_retailprice) OVER (PARTITION BY c)')} AS p_retailprice FROM k",
}
