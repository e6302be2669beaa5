"""Privacy budget: a table of operations, totals by aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default limits of a session's budget.
MAX_EPSILON = 10.0
MAX_DELTA = 1e-3


def budget_totals(operations: DataFrame, session: str = "session_id") -> DataFrame:
    """Sequential composition per session: sums only, so a busy session costs one row per task."""
    who = F.coalesce(F.col(session).cast("string"), F.lit("default"))
    return operations.groupBy(who.alias("session_id")).agg(
        F.sum(F.coalesce("epsilon", F.lit(0.0))).alias("total_epsilon"),
        F.sum(F.coalesce("delta", F.lit(0.0))).alias("total_delta"),
        F.count(F.lit(1)).alias("operations"),
    )


def budget_ledger(operations: DataFrame, session: str = "session_id", time: str = "timestamp") -> DataFrame:
    """The ledger as rows: one per operation, ``mechanism`` defaulting to ``unknown``.

    The operation list stays a table (session, time) rather than one array per
    session, so that no session has to fit in one task. Totals: ``budget_totals``.
    """
    return operations.select(
        F.coalesce(F.col(session).cast("string"), F.lit("default")).alias("session_id"),
        F.col(time).alias("timestamp"),
        F.coalesce("epsilon", F.lit(0.0)).alias("epsilon"),
        F.coalesce("delta", F.lit(0.0)).alias("delta"),
        F.coalesce("mechanism", F.lit("unknown")).alias("mechanism"),
    )


def mechanism_counts(operations: DataFrame, session: str = "session_id") -> DataFrame:
    who = F.coalesce(F.col(session).cast("string"), F.lit("default"))
    return operations.groupBy(
        who.alias("session_id"), F.coalesce("mechanism", F.lit("unknown")).alias("mechanism")
    ).agg(F.count(F.lit(1)).alias("operations"), F.sum(F.coalesce("epsilon", F.lit(0.0))).alias("epsilon"))


def with_remaining(totals: DataFrame, max_epsilon: Column | float = MAX_EPSILON, max_delta: Column | float = MAX_DELTA) -> DataFrame:
    """Remaining budget (not below 0) and used share in percent (not above 100)."""
    e = F.lit(max_epsilon) if isinstance(max_epsilon, (int, float)) else max_epsilon
    d = F.lit(max_delta) if isinstance(max_delta, (int, float)) else max_delta
    used_e, used_d = F.col("total_epsilon"), F.col("total_delta")
    return totals.select(
        "session_id",
        used_e.alias("epsilon_used"),
        used_d.alias("delta_used"),
        F.greatest(F.lit(0.0), e - used_e).alias("epsilon_remaining"),
        F.greatest(F.lit(0.0), d - used_d).alias("delta_remaining"),
        F.when(e > 0, F.least(F.lit(100.0), used_e / e * 100)).otherwise(0.0).alias("epsilon_percent"),
        F.when(d > 0, F.least(F.lit(100.0), used_d / d * 100)).otherwise(0.0).alias("delta_percent"),
    )


def budget_remaining(
    operations: DataFrame, max_epsilon: float = MAX_EPSILON, max_delta: float = MAX_DELTA, session: str = "session_id"
) -> DataFrame:
    return with_remaining(budget_totals(operations, session), max_epsilon, max_delta)


def enforce_budget(
    operations: DataFrame, session_id: str, epsilon: float, delta: float, max_epsilon: float = MAX_EPSILON, max_delta: float = MAX_DELTA
) -> None:
    """Raise before a release that would overspend the session's budget."""
    mine = operations.filter(F.col("session_id") == session_id)
    row = mine.agg(F.sum("epsilon").alias("e"), F.sum("delta").alias("d")).first()
    if (row["e"] or 0.0) + epsilon > max_epsilon or (row["d"] or 0.0) + delta > max_delta:
        raise ValueError(f"privacy budget of session {session_id} would be exceeded")


def privacy_loss(operations: DataFrame) -> DataFrame:
    """Composed loss of ``queries`` uses of a mechanism with (epsilon, delta).

    The Gaussian formula has no bound at delta 0: its epsilon loss is infinite there.
    """
    mechanism = F.lower("mechanism")
    e, d, q = F.col("epsilon"), F.col("delta"), F.col("queries").cast("double")
    composed = F.when((mechanism == "gaussian") & (d <= 0), F.lit(float("inf"))).when(mechanism == "gaussian", e * F.sqrt(F.lit(2.0) * q * F.ln(F.lit(1.0) / d))).otherwise(e * q)
    return operations.withColumns(
        {"epsilon_loss": composed, "delta_loss": F.when(mechanism == "laplace", F.lit(0.0)).otherwise(d * q)}
    )
