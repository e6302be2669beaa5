"""Pairwise-complete correlations of very many columns in one scan, from blocked co-moments.

For a pair of columns only the rows that have both count, so each pair has its own number of rows,
means and deviations. A task computes them for all pairs at once as products of
its batches: with ``X`` the values less a shift and nulls as zero, and ``M`` one where there is
a value, ``M'M`` counts, ``X'M`` sums, ``(X*X)'M`` sums squares and ``X'X`` products. Batches and
then tasks are merged by position with the update for means and co-moments, so nothing cancels.
What leaves a task is one row per column, as long as there are columns, however many rows it has read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CELLS = 1 << 21
MERGED_ROWS = 64  # partial rows of a column that meet in a first merge
_PARTS = 8  # count, mean of a, mean of b, squares of a, squares of b, products, largest size of a and of b
_TINY = 1e-13  # a deviation below this part of a column's largest value is rounding


def block_moments(x: np.ndarray) -> np.ndarray:
    """The arrays over pairs ``(a, b)`` of a block of rows; NaN is no value."""
    m = ~np.isnan(x)
    count = np.maximum(m.sum(axis=0), 1)
    low, high = np.where(m, x, np.inf).min(axis=0), np.where(m, x, -np.inf).max(axis=0)
    with np.errstate(invalid="ignore", over="ignore"):
        shift = np.where(m, x, 0.0).sum(axis=0) / count
        shift = np.where(low == high, low, shift)  # a constant stays exactly one
        shift = np.where(np.isfinite(shift), shift, 0.0)
        x = np.where(m, x - shift, 0.0)
        m = m.astype(float)
        n, s, p = m.T @ m, x.T @ m, x.T @ x
        q = (x * x).T @ m
        rows = np.maximum(n, 1.0)
        mean = s / rows
        squares = q - s * mean
        squares[squares <= _TINY * q] = 0.0
        size = np.maximum(np.abs(np.where(np.isfinite(low), low, 0.0)), np.abs(np.where(np.isfinite(high), high, 0.0)))[:, None] + np.zeros_like(n)
        products = p - s * s.T / rows
        mean = np.where(n > 0, mean + shift[:, None], 0.0)
    return np.stack([n, mean, mean.T, squares, squares.T, products, size, size.T])


def merged(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Moments of the rows of both; the arrays may be of any shape behind the first axis."""
    n = one[0] + two[0]
    share = one[0] * two[0] / np.maximum(n, 1.0)
    with np.errstate(invalid="ignore", over="ignore"):
        da, db = two[1] - one[1], two[2] - one[2]
        weight = two[0] / np.maximum(n, 1.0)
        da, db = np.where(share > 0, da, 0.0), np.where(share > 0, db, 0.0)
        first = one[0] == 0
        mean_a = np.where(first, two[1], one[1] + da * weight)
        mean_b = np.where(first, two[2], one[2] + db * weight)
        return np.stack([n, mean_a, mean_b, one[3] + two[3] + da * da * share, one[4] + two[4] + db * db * share, one[5] + two[5] + da * db * share,
                         np.maximum(one[6], two[6]), np.maximum(one[7], two[7])])


def _moments(width: int):
    schema = pa.schema([("a", pa.int32()), ("part", pa.int64()), ("moments", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part = batch.column(width)[0].as_py()
            step = max(1, BLOCK_CELLS // width)
            for at in range(0, batch.num_rows, step):
                block = batch.slice(at, step)
                x = np.column_stack([block.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(width)])
                found = block_moments(x)
                total = found if total is None else merged(total, found)
        for a in range(width if total is not None else 0):
            row = np.ascontiguousarray(total[:, a, :]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([part], pa.int64()), pa.array([row], pa.binary())], schema=schema)

    return run


def _sum(rows: list[bytes]) -> np.ndarray:
    total = None
    for row in rows:
        found = np.frombuffer(row).reshape(_PARTS, -1)
        total = found if total is None else merged(total, found)
    return total


def wide_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col_a, col_b, corr)`` for all pairs in the order of ``columns``; null where a pair has no deviation."""
    names, width = list(columns), len(columns)
    values = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(names)], F.spark_partition_id().cast("bigint").alias("part"))

    def some(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"a": pa.array([key[0].as_py()], pa.int32()), "moments": pa.array([_sum(table.column("moments").to_pylist()).tobytes()], pa.binary())})

    def last(key: tuple, table: pa.Table) -> pa.Table:
        a = key[0].as_py()
        n, _, _, sa, sb, p, la, lb = _sum(table.column("moments").to_pylist())[:, a + 1 :]
        with np.errstate(invalid="ignore", divide="ignore"):
            corr = np.where((sa > n * (_TINY * la) ** 2) & (sb > n * (_TINY * lb) ** 2), p / (np.sqrt(sa) * np.sqrt(sb)), np.nan)
        return pa.table({"col_a": pa.array([names[a]] * len(corr), pa.string()), "col_b": pa.array(names[a + 1 :], pa.string()), "corr": pa.array(corr, mask=np.isnan(corr))})

    parts = values.mapInArrow(_moments(width), "a int, part bigint, moments binary")
    parts = parts.withColumn("part", F.floor(F.col("part") / MERGED_ROWS))
    first = parts.groupBy("a", "part").applyInArrow(some, "a int, moments binary")
    return first.groupBy("a").applyInArrow(last, "col_a string, col_b string, corr double")
