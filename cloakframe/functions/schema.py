"""Column roles from the Spark schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers only; booleans are protected as categories."""
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame, skip: set[str] | list[str] = ()) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in skip]


def categorical_columns(df: DataFrame, skip: set[str] | list[str] = ()) -> list[str]:
    """Everything that is not a number: text, booleans, dates."""
    return [f.name for f in df.schema if not is_numeric(f.dataType) and f.name not in skip]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def temporal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_temporal(f.dataType)]


def role_name(dtype: T.DataType) -> str:
    """Short type name: int64, float64, object, bool or datetime64."""
    if isinstance(dtype, T.IntegralType):
        return "int64"
    if isinstance(dtype, T.NumericType):
        return "float64"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if is_temporal(dtype):
        return "datetime64"
    return "object"
