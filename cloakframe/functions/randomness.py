"""Keyed randomness: noise as a function of (salt, stream, row key).

The same row draws the same number on every retry and under every partitioning,
which ``rand()`` does not give. The salt must be secret and fresh per release:
two releases under one salt carry the same noise, and it cancels.

One SHA-256 digest holds four 52-bit lanes, so an operator that needs two
uniforms per cell still hashes once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LANE_HEX = 13
RANGE = float(2**52)


def bits(salt: str, stream: str, keys: Sequence[str | Column], lane: int = 0) -> Column:
    """52 uniform bits as a long."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    digest = F.sha2(F.concat_ws("|", F.lit(salt), F.lit(stream), *parts), 256)
    return F.conv(F.substring(digest, 1 + LANE_HEX * lane, LANE_HEX), 16, 10).cast("bigint")


def uniform(salt: str, stream: str, keys: Sequence[str | Column], lane: int = 0) -> Column:
    """Uniform in (0, 1), never 0 or 1."""
    return (bits(salt, stream, keys, lane) + F.lit(0.5)) / F.lit(RANGE)


def normal(salt: str, stream: str, keys: Sequence[str | Column]) -> Column:
    """Standard normal by Box-Muller on lanes 0 and 1."""
    u1 = uniform(salt, stream, keys, 0)
    u2 = uniform(salt, stream, keys, 1)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def laplace(salt: str, stream: str, keys: Sequence[str | Column], scale: float | Column) -> Column:
    """Laplace(0, scale) by inverse CDF."""
    centred = uniform(salt, stream, keys) - F.lit(0.5)
    b = F.lit(scale) if isinstance(scale, (int, float)) else scale
    return -b * F.signum(centred) * F.ln(F.lit(1.0) - F.lit(2.0) * F.abs(centred))
