"""The audit log: append-only JSON lines, one folder per day."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import moment
from ..operators.audit import retention_cutoff

# Fields of one audit event; ``epsilon``/``delta``/``mechanism`` are its budget use, null when it used none.
AUDIT_EVENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("resource", T.StringType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ip_address", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("execution_time", T.DoubleType()),
        T.StructField("epsilon", T.DoubleType()),
        T.StructField("delta", T.DoubleType()),
        T.StructField("mechanism", T.StringType()),
    ]
)

FILES_A_DAY = 8


def conform(events: DataFrame, schema: T.StructType = AUDIT_EVENT) -> DataFrame:
    """Exactly the schema's columns, cast; missing ones are null."""
    return events.select(
        *[(F.col(f.name) if f.name in events.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )


def append_audit_log(events: DataFrame, root: str) -> None:
    """Append events to their day's folder, at most ``FILES_A_DAY`` files each time."""
    dated = conform(events).withColumn("date", F.to_date("timestamp"))
    dated.repartition("date", F.pmod(F.xxhash64("id"), F.lit(FILES_A_DAY))).write.mode("append").partitionBy("date").json(root)


def read_audit_log(spark: SparkSession, root: str) -> DataFrame:
    """All events, with the ``date`` partition column for pruning."""
    schema = T.StructType([*AUDIT_EVENT, T.StructField("date", T.DateType())])
    return spark.read.schema(schema).json(root)


def rewrite_retained(spark: SparkSession, source: str, target: str, as_of: datetime, retention_days: int = 90) -> None:
    """Copy the days that are still retained to a new log folder; older days are not read."""
    cut = retention_cutoff(as_of, retention_days)
    logs = read_audit_log(spark, source)
    kept = logs.filter((F.col("date") >= F.lit(cut.date())) & (F.col("timestamp") > moment(cut)))
    kept.write.mode("append").partitionBy("date").json(target)
