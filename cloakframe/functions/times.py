"""Times without a time zone in between: wall-clock literals and differences."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def moment(at: datetime, dtype: T.DataType | None = None) -> Column:
    """A literal wall-clock time; it does not pass through the driver's or the session's zone unless ``dtype`` has one."""
    literal = F.lit(at.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    return literal if dtype is None else literal.cast(dtype)


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def epoch_seconds(c: Column, dtype: T.DataType) -> Column:
    """Whole seconds since 1970; a time without zone is read as UTC."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_timestamp(c)
    zero = moment(datetime(1970, 1, 1))
    return F.floor(micros_between(zero, c.cast("timestamp_ntz")) / F.lit(1_000_000)).cast("bigint")


def utc_instant(c: Column, dtype: T.DataType) -> Column:
    """The instant of a time; one without zone is read as UTC (watermarks need an instant)."""
    if isinstance(dtype, T.TimestampType):
        return c
    return F.timestamp_micros(micros_between(moment(datetime(1970, 1, 1)), c.cast("timestamp_ntz")))


def utc_wall_clock(instant: Column) -> Column:
    """The UTC wall-clock time of an instant, to the second."""
    return moment(datetime(1970, 1, 1)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_seconds(instant).cast("decimal(18,6)"))
