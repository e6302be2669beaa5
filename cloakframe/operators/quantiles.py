"""Exact order statistics by radix selection, and modes; no column is sorted, shuffled or gathered.

``percentile``, ``median`` and ``mode`` keep every distinct value of a column in
one aggregation buffer, and a sort moves all values. Here a rank is found digit by digit:
the bits of a double, put in order, are read ``DIGIT`` at a time from the top. A pass over
the table counts the next digit of the values that share the digits found so far, all
columns and ranks at once; tasks send counts only, at most ``2 ** DIGIT`` per column
and rank. What fewer than ``2 ** DIGIT`` values share is read to its last bit in the next
pass, so a thousand million values take four passes and never more than six.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import COLUMNS_PER_JOB, single_row, value_counts

DIGIT = 12
_TOP = np.uint64(1 << 63)
_SCHEMA = "slot int, digit long, n long"


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order; the two zeros are one, NaN is left out by the caller."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >= _TOP, ~bits, bits | _TOP)


def from_bits(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


@dataclass
class Slot:
    """Values of ``column`` whose first ``known`` bits are ``prefix``; the next ``width`` bits are counted."""

    column: int
    prefix: int
    known: int
    width: int

    def digits(self, keys: np.ndarray) -> np.ndarray:
        if self.known:
            keys = keys[keys >> np.uint64(64 - self.known) == np.uint64(self.prefix)]
        return (keys >> np.uint64(64 - self.known - self.width)) & np.uint64((1 << self.width) - 1)


def _counter(slots: list[Slot]):
    """Counts of each slot's digits in a task; narrow digits in one array each, wide ones (few values) by value."""
    wanted = sorted({s.column for s in slots})
    schema = pa.schema([("slot", pa.int32()), ("digit", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = {i: np.zeros(1 << s.width, np.int64) for i, s in enumerate(slots) if s.width <= DIGIT}
        sparse: dict[int, list[np.ndarray]] = {i: [] for i in range(len(slots)) if i not in dense}
        for batch in batches:
            keys = {}
            for c in wanted:
                values = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
                keys[c] = ordered_bits(values[~np.isnan(values)])
            for i, s in enumerate(slots):
                digits = s.digits(keys[s.column]).astype(np.int64)
                if i in dense:
                    dense[i] += np.bincount(digits, minlength=1 << s.width)
                elif len(digits):
                    sparse[i].append(digits)
        for i in range(len(slots)):
            if i in dense:
                digit = np.flatnonzero(dense[i])
                n = dense[i][digit]
            else:
                digit, n = np.unique(np.concatenate([np.zeros(0, np.int64), *sparse[i]]), return_counts=True)
            if len(digit):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(digit), i, np.int32)), pa.array(digit), pa.array(n.astype(np.int64))], schema=schema)

    return run


def _counts(values: DataFrame, slots: list[Slot]) -> DataFrame:
    return values.mapInArrow(_counter(slots), _SCHEMA).groupBy("slot", "digit").agg(F.sum("n").alias("n"))


def values_at(df: DataFrame, columns: Sequence[str], ranks: Callable[[str, int], dict[str, int]]) -> dict[tuple[str, str], float]:
    """``(column, name) -> value`` at the 0-based ranks that ``ranks(column, n)`` names, ``n`` numbers being in the column.

    Nulls and NaN do not count; a column without numbers has no ranks.
    """
    found: dict[tuple[str, str], float] = {}
    for at in range(0, len(columns), COLUMNS_PER_JOB):
        chunk = list(columns[at : at + COLUMNS_PER_JOB])
        found.update(_values_at(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(chunk)]), chunk, ranks))
    return found


def _values_at(values: DataFrame, columns: list[str], ranks: Callable[[str, int], dict[str, int]]) -> dict[tuple[str, str], float]:
    slots = [Slot(i, 0, 0, DIGIT) for i in range(len(columns))]
    first: dict[int, list[tuple[int, int]]] = {}
    for r in _counts(values, slots).collect():  # at most 2 ** DIGIT digits of each column, signs and exponents
        first.setdefault(r["slot"], []).append((r["digit"], r["n"]))
    open_: dict[tuple[str, str], tuple[Slot, int]] = {}
    found: dict[tuple[str, str], float] = {}

    def narrowed(name: tuple[str, str], slot: Slot, digit: int, rest: int, n: int) -> None:
        known, prefix = slot.known + slot.width, slot.prefix << slot.width | digit
        if known == 64:
            found[name] = from_bits(prefix)
        else:
            left = 64 - known
            open_[name] = (Slot(slot.column, prefix, known, left if n <= 1 << DIGIT else min(DIGIT, left)), rest)

    for i, counted in first.items():
        total = sum(n for _, n in counted)
        for name, rank in ranks(columns[i], total).items():
            before = 0
            for digit, n in sorted(counted):
                if rank < before + n:
                    narrowed((columns[i], name), slots[i], digit, rank - before, n)
                    break
                before += n
    while open_:
        slots, asked = [], []
        for name, (slot, rest) in open_.items():
            if slot not in slots:
                slots.append(slot)
            asked.append((slots.index(slot), rest, *name))
        open_ = {}
        wanted = values.sparkSession.createDataFrame([(s, r, c, k) for s, r, c, k in asked], "slot int, rest long, column string, name string")
        running = _counts(values, slots).withColumn("upto", F.sum("n").over(Window.partitionBy("slot").orderBy("digit")))
        hit = running.join(F.broadcast(wanted), "slot").where((F.col("rest") < F.col("upto")) & (F.col("rest") >= F.col("upto") - F.col("n")))
        for r in hit.select("slot", "column", "name", "digit", "n", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest")).collect():
            narrowed((r["column"], r["name"]), slots[r["slot"]], r["digit"], r["rest"], r["n"])
    return found


def quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], approx: bool = False
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column; ``approx`` uses a one-pass sketch."""
    columns = list(columns)
    if not columns:
        return {}
    if approx:
        row = single_row(
            df,
            {f"q{i}": F.percentile_approx(F.col(c).cast("double"), list(probabilities), 10_000) for i, c in enumerate(columns)},
        )
        return {c: list(row[f"q{i}"] or [None] * len(probabilities)) for i, c in enumerate(columns)}
    share: dict[tuple[str, int], float] = {}

    def ranks(c: str, n: int) -> dict[str, int]:
        out = {}
        for i, p in enumerate(probabilities):
            place = p * (n - 1)
            low = int(place)
            share[c, i] = place - low
            out |= {f"lo{i}": low, f"hi{i}": min(low + 1, n - 1)}
        return out

    found = values_at(df, columns, ranks)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        if (c, "lo0") not in found:
            out[c] = [None] * len(probabilities)
            continue
        lows = [found[c, f"lo{i}"] for i in range(len(probabilities))]
        highs = [found[c, f"hi{i}"] for i in range(len(probabilities))]
        out[c] = [lo + (hi - lo) * share[c, i] if hi > lo else lo for i, (lo, hi) in enumerate(zip(lows, highs))]
    return out


def mode_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, mode)``: most frequent value as text, smallest on ties."""
    ranked = value_counts(df, columns).groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b"))
    return ranked.select("column", F.col("b.value").alias("mode"))


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    found = {r["column"]: r["mode"] for r in mode_table(df, columns).collect()} if columns else {}
    return {c: found.get(c) for c in columns}
