"""Connected components of links by alternating stars, each round a few joins and a written table.

A round links every larger neighbour of a node to the smallest node it sees, then
every smaller one; links shrink to stars around the smallest node of each
component after a number of rounds that grows with the logarithm of its width.
A node with a third of all links is a skewed join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Links (v, m) with m the smallest of u and its neighbours, for v among the larger (or the smaller) neighbours of u."""
    if larger:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).select(F.col("a").alias("u"), "m")
    joined = both.join(least, both["a"] == least["u"]).select("a", "b", "m")
    if larger:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node is either the centre of links or the end of one."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    centres = links.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    seen = ends.unionByName(centres).groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up + down > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every node of ``links`` (a, b: long) that is not the smallest of its component.

    Nulls and links of a node to itself are left out. A node that is missing from the result is its own component.
    """
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _are_stars(now):
        now = materialize(_star(_star(now, True), False), "links")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))


def local_roots(a, b, n):
    """Smallest index of each of ``n`` nodes' component for index arrays of links, in one task."""
    import numpy as np

    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        new = new[new]
        new = np.minimum(new, new[root])
        if (new == root).all():
            return root
        root = new
