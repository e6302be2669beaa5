"""Equal-width, right-closed bins with the edges fixed as literals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five labels of a generalized numeric column, low to high.
FIVE_LEVELS = ["Very Low", "Low", "Medium", "High", "Very High"]


def equal_width_index(value: Column, low: float | None, high: float | None, bins: int) -> Column:
    """Bin 0..bins-1; an interior edge belongs to the bin on its left.

    Values outside [low, high] fall in the first or last bin, a constant column
    in the middle one, null stays null.
    """
    v = value.cast("double")
    if low is None or high is None:
        return F.lit(None).cast("int")
    if low == high:
        return F.when(v.isNotNull(), F.lit((bins - 1) // 2)).cast("int")
    step = (high - low) / bins
    above = [(v > F.lit(i * step + low)).cast("int") for i in range(1, bins)]
    return reduce(lambda a, b: a + b, above, F.lit(0)).cast("int")


def level_label(index: Column, labels: list[str]) -> Column:
    return F.when(index.isNotNull(), F.element_at(F.array(*map(F.lit, labels)), index + 1))
