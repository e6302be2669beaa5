"""What the operators of this subpackage share: reading tables, stable splits, written intermediates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shuffle_width

__all__ = ["held_out", "materialize", "read", "shuffle_width", "width_for"]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def held_out(key: str, parts: int, rest: int) -> Column:
    """Whether a row is kept from training: crc32 of the key as text, modulo ``parts``, is ``rest``."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == rest, F.lit(False))


def width_for(spark: SparkSession, amount: float, each: float) -> int:
    """Number of parts of about ``each``, and no fewer than a shuffle of the session has."""
    return max(shuffle_width(spark), int(-(-amount // each)), 1)
