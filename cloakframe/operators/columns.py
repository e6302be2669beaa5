"""Per-column protection and preparation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import schema as roles
from ..functions.binning import equal_width_index
from ..functions.times import epoch_seconds
from .domains import MAX_BROADCAST, Domain, fit_domain, indexed, position
from .joins import lookup
from .quantiles import modes, quantiles
from .stats import numeric_summary, single_row


def pseudonym(value: Column, salt: str, buckets: int | None = 10_000) -> Column:
    """``anon_<n>`` from a salted hash; ``buckets=None`` gives a 256-bit token without collisions."""
    digest = F.sha2(F.concat(F.lit(salt), F.lit("|"), value.cast("string")), 256)
    if buckets is None:
        return F.concat(F.lit("anon_"), digest)
    number = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") % F.lit(buckets)
    return F.concat(F.lit("anon_"), number.cast("string"))


def pseudonymize(
    df: DataFrame, columns: Sequence[str] = ("Name", "Email"), salt: str = "", buckets: int | None = 10_000
) -> DataFrame:
    """Replace the named columns that exist; null stays null."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: pseudonym(F.col(c), salt, buckets) for c in present})


def hash_column(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or column, F.sha2(F.col(column).cast("string"), 256))


def _key_literal(key: bytes) -> Column:
    if len(key) not in (16, 24, 32):
        raise ValueError("the key must have 16, 24 or 32 bytes")
    return F.lit(key)


def encrypt_column(df: DataFrame, column: str, key: bytes, name: str | None = None) -> DataFrame:
    """AES-GCM with a fresh nonce per cell, base64 text."""
    cipher = F.aes_encrypt(F.col(column).cast("string").cast("binary"), _key_literal(key), F.lit("GCM"))
    return df.withColumn(name or column, F.base64(cipher))


def decrypt_column(df: DataFrame, column: str, key: bytes, name: str | None = None) -> DataFrame:
    plain = F.aes_decrypt(F.unbase64(F.col(column)), _key_literal(key), F.lit("GCM"))
    return df.withColumn(name or column, plain.cast("string"))


def owner_filter(df: DataFrame, user: str | int | None, column: str = "user_id") -> DataFrame:
    """Rows of one owner; without an owner, every row."""
    return df if user is None else df.filter(F.col(column) == F.lit(user))


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*roles.numeric_columns(df))


def select_categorical(df: DataFrame) -> DataFrame:
    return df.select(*roles.categorical_columns(df))


def impute(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    text: str | None = None,
    numeric: float | None = None,
) -> DataFrame:
    """Fill nulls: text with its mode (smallest on ties, ``Unknown`` if all null), others with the median.

    ``text`` / ``numeric`` replace those by a constant.
    """
    columns = list(columns or df.columns)
    numbers = [c for c in roles.numeric_columns(df) if c in columns]
    texts = [c for c in roles.text_columns(df) if c in columns]
    gaps = single_row(df, {c: F.count_if(F.col(c).isNull()) for c in [*numbers, *texts]})
    numbers, texts = [c for c in numbers if gaps[c]], [c for c in texts if gaps[c]]
    medians = {} if numeric is not None else quantiles(df, numbers, [0.5])
    commonest = {} if text is not None else modes(df, texts)
    fills = {}
    for c in numbers:
        value = numeric if numeric is not None else medians[c][0]
        if value is not None:
            fills[c] = F.coalesce(F.col(c).cast("double"), F.lit(float(value)))
    for c in texts:
        value = text if text is not None else commonest[c]
        fills[c] = F.coalesce(F.col(c), F.lit("Unknown" if value is None else value))
    fills.update({c: F.col(c).cast("double") for c in roles.numeric_columns(df) if c in columns and c not in fills})
    return df.withColumns(fills) if fills else df


def datetime_to_epoch(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Timestamps to whole epoch seconds (UTC)."""
    chosen = columns or roles.temporal_columns(df)
    return df.withColumns({c: epoch_seconds(F.col(c), df.schema[c].dataType) for c in chosen})


def fit_codes(df: DataFrame, column: str) -> Domain:
    """The sorted distinct values; a value's code is its 0-based position."""
    return fit_domain(df, column)


def apply_codes(df: DataFrame, column: str, codes: Domain, name: str) -> DataFrame:
    """Code of each value, -1 when the fit has not seen it.

    A small domain is a literal array, a larger one a broadcast or shuffled lookup.
    """
    if codes.values is not None:
        at = position(codes.values, F.col(column)) if codes.values else F.lit(None).cast("int")
        return df.withColumn(name, F.coalesce(at, F.lit(-1)).cast("int"))
    table = indexed(codes).select(F.col("value").alias(column), F.col("idx").alias(name), "n")
    joined = lookup(df, column, table, name, "n", codes.rows, MAX_BROADCAST, codes.size)
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(-1)).cast("int"))


def label_encode(fit_on: DataFrame, apply_to: DataFrame, column: str, name: str) -> DataFrame:
    return apply_codes(apply_to, column, fit_codes(fit_on, column), name)


@dataclass(frozen=True)
class Scale:
    mean: dict[str, float]
    std: dict[str, float]

    def column(self, name: str) -> Column:
        return (F.col(name).cast("double") - F.lit(self.mean[name])) / F.lit(self.std[name])


def fit_scale(df: DataFrame, columns: Sequence[str]) -> Scale:
    """Mean and population deviation; a constant column is divided by 1."""
    summary = numeric_summary(df, columns, ("mean", "pstd"))
    mean = {c: float(s["mean"] or 0.0) for c, s in summary.items()}
    return Scale(mean, {c: float(s["pstd"]) if s["pstd"] else 1.0 for c, s in summary.items()})


def standard_scale(fit_on: DataFrame, apply_to: DataFrame, columns: Sequence[str]) -> DataFrame:
    scale = fit_scale(fit_on, columns)
    return apply_to.withColumns({c: scale.column(c) for c in columns})


def equal_width_bin(df: DataFrame, column: str, bins: int, name: str) -> DataFrame:
    s = numeric_summary(df, [column])[column]
    return df.withColumn(name, equal_width_index(F.col(column), s["min"], s["max"], bins))
