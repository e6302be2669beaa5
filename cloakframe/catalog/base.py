"""Helpers shared by the registered queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALT = "s1"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    """Round double columns so that both engines print the same value (and no negative zero)."""
    chosen = [c for c, t in df.dtypes if t == "double" and (only is None or c in only)]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in chosen}) if chosen else df


def one_value(spark: SparkSession, **values: float) -> DataFrame:
    return spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


def r(expr: str, digits: int = 6) -> str:
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE)"


def sql_bits(salt: str, stream: str, key: str, lane: int = 0) -> str:
    digest = f"sha256(concat_ws('|', '{salt}', '{stream}', coalesce(({key})::VARCHAR, '')))"
    return f"(('0x' || substr({digest}, {1 + 13 * lane}, 13))::BIGINT)"


def sql_uniform(salt: str, stream: str, key: str, lane: int = 0) -> str:
    return f"(({sql_bits(salt, stream, key, lane)} + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def sql_normal(salt: str, stream: str, key: str) -> str:
    u1, u2 = sql_uniform(salt, stream, key, 0), sql_uniform(salt, stream, key, 1)
    return f"(sqrt(-2.0::DOUBLE * ln({u1})) * cos(6.283185307179586::DOUBLE * {u2}))"


def sql_laplace(salt: str, stream: str, key: str, scale: str) -> str:
    u = f"({sql_uniform(salt, stream, key)} - 0.5::DOUBLE)"
    return f"(-({scale})::DOUBLE * sign({u}) * ln(1.0::DOUBLE - 2.0::DOUBLE * abs({u})))"


def sql_flip(source: str, column: str, key: str, epsilon: float, salt: str) -> str:
    """Randomized response of ``column`` as an SQL expression over ``source``."""
    dom = f"(SELECT list_sort(list(DISTINCT {column})) FROM {source})"
    e = f"exp({epsilon}::DOUBLE)"
    j = f"floor({sql_uniform(salt, 'rr:' + column, key, 1)} * (len({dom}) - 1))::BIGINT"
    own = f"(list_position({dom}, {column}) - 1)"
    return (
        f"CASE WHEN {sql_uniform(salt, 'rr:' + column, key, 0)} < {e} / ({e} + len({dom}) - 1) THEN {column} "
        f"ELSE {dom}[{j} + CASE WHEN {j} >= {own} THEN 1 ELSE 0 END + 1] END"
    )


def sql_bin(value: str, low: str, high: str, bins: int) -> str:
    """Right-closed equal-width bin index 0..bins-1."""
    step = f"(({high}) - ({low})) / {bins}.0::DOUBLE"
    parts = " + ".join(f"CASE WHEN ({value})::DOUBLE > {i}.0::DOUBLE * {step} + ({low}) THEN 1 ELSE 0 END" for i in range(1, bins))
    return f"(CASE WHEN ({value}) IS NULL THEN NULL WHEN ({low}) = ({high}) THEN {(bins - 1) // 2} ELSE {parts} END)"


def sql_alias(name: str, counts: str, weight: str = "n") -> str:
    """CTEs of an alias table ``{name}(idx, v, keep, other, k)`` over a (v, n) relation; ``weight`` is a whole number."""
    order = "OVER (ORDER BY v NULLS LAST)"
    return (
        f"{name}_w AS (SELECT v, ({weight})::HUGEINT AS w FROM ({counts})), "
        f"{name}_s AS MATERIALIZED (SELECT v, row_number() {order} - 1 AS idx, w * (SELECT count(*) FROM {name}_w WHERE w > 0) AS s, (SELECT sum(w) FROM {name}_w) AS t FROM {name}_w WHERE w > 0), "
        f"{name}_l AS MATERIALIZED (SELECT *, sum(t - s) {order} AS d FROM {name}_s WHERE s < t), "
        f"{name}_h AS MATERIALIZED (SELECT *, sum(s - t) {order} AS e, lead(v) {order} AS nxt, row_number() {order} AS j, count(*) OVER () AS m FROM {name}_s WHERE s > t), "
        f"{name} AS MATERIALIZED (SELECT l.idx, l.v, CASE WHEN h.j IS NULL THEN 1.0 ELSE l.s::DOUBLE / l.t::DOUBLE END AS keep, h.v AS other FROM {name}_l l ASOF LEFT JOIN {name}_h h ON l.d - (l.t - l.s) < h.e "
        f"UNION ALL SELECT h.idx, h.v, CASE WHEN h.j = h.m OR l.d IS NULL THEN 1.0 ELSE (h.t + h.e - l.d)::DOUBLE / h.t::DOUBLE END, h.nxt FROM {name}_h h ASOF LEFT JOIN {name}_l l ON h.e <= l.d "
        f"UNION ALL SELECT idx, v, 1.0, v FROM {name}_s WHERE s = t)"
    )


def sql_drawn(name: str, rows: str, u: str, columns: str, drawn: str) -> str:
    """``columns`` of ``rows`` and the value of the alias table ``name`` at ``u``, as ``drawn``."""
    k = f"(SELECT count(*) FROM {name})"
    return (
        f"SELECT {columns}, CASE WHEN _at - _own < keep THEN v ELSE other END AS {drawn} FROM (SELECT *, {u} * {k}::DOUBLE AS _at, "
        f"least(floor({u} * {k}::DOUBLE)::BIGINT, {k} - 1) AS _own FROM {rows}) JOIN {name} ON _own = idx"
    )


LEVELS_SQL = "['Very Low', 'Low', 'Medium', 'High', 'Very High']"


def key_mod_null(column: str, key: str, n: int) -> Column:
    """The column with every ``n``-th key's value made null."""
    return F.when(F.col(key) % n != 0, F.col(column))


def sql_mod_null(column: str, key: str, n: int) -> str:
    return f"CASE WHEN {key} % {n} <> 0 THEN {column} END"
