"""Streaming twins of the audit aggregates.

Each builder maps a streaming (or batch) event frame to the running aggregate;
``run_updates`` drives it over everything available and keeps the latest row per
key in a parquet change log in the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import utc_instant, utc_wall_clock
from ..operators.audit import SECURITY_ACTIONS, SUSPICIOUS_FAILURES
from ..session import scratch_path


def read_events(spark: SparkSession, folder: str, file_glob: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet file stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def _timed(events: DataFrame, late: str) -> DataFrame:
    instant = utc_instant(F.col("timestamp"), events.schema["timestamp"].dataType)
    return events.withColumn("timestamp", instant).withWatermark("timestamp", late)


def daily_activity(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events per UTC day and action; state older than the watermark is dropped."""
    out = _timed(events, late).groupBy(F.window("timestamp", "1 day"), "action").agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.date_format(utc_wall_clock(F.col("window.start")), "yyyy-MM-dd").alias("day"), "action", "events")


def performance_windows(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Mean execution time per 4-hour window (UTC)."""
    out = _timed(events, late).groupBy(F.window("timestamp", "4 hours")).agg(F.avg("execution_time").alias("average_time"), F.count(F.lit(1)).alias("events"))
    return out.select(F.date_format(utc_wall_clock(F.col("window.start")), "yyyy-MM-dd HH:mm").alias("window_start"), "average_time", "events")


def failed_by_ip(events: DataFrame) -> DataFrame:
    """Running count of failed security events per address."""
    failed = events.filter(F.lower("action").rlike("|".join(SECURITY_ACTIONS)) & ~F.col("success") & F.col("ip_address").isNotNull())
    return failed.groupBy("ip_address").agg(F.count(F.lit(1)).alias("failures"))


def suspicious(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("failures") > SUSPICIOUS_FAILURES)


def budget_by_session(events: DataFrame) -> DataFrame:
    """Running budget per session. No watermark: spent budget never expires, so late events still count."""
    spending = events.filter(F.col("epsilon").isNotNull() | F.col("delta").isNotNull())
    return spending.groupBy(F.coalesce(F.col("session_id").cast("string"), F.lit("default")).alias("session_id")).agg(
        F.sum(F.coalesce("epsilon", F.lit(0.0))).alias("total_epsilon"),
        F.sum(F.coalesce("delta", F.lit(0.0))).alias("total_delta"),
        F.count(F.lit(1)).alias("operations"),
    )


def run_updates(running: DataFrame, keys: Sequence[str], path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process all available input; returns the latest state per key.

    Every micro-batch writes its changed keys to its own folder, overwriting it
    when a batch is replayed, so a restart does not duplicate changes.
    """
    spark = running.sparkSession
    path = path or scratch_path(spark, "updates")
    checkpoint = checkpoint or scratch_path(spark, "streamstate")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        running.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    values = [c for c in running.columns if c not in keys]
    schema = T.StructType([*running.schema, T.StructField("batch", T.LongType())])
    changes = spark.read.schema(schema).parquet(path)
    latest = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return latest.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def run_append(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process all available input of a stateless stream into a parquet file sink and read it back."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    checkpoint = checkpoint or scratch_path(spark, "streamstate")
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
