"""Contiguous shards of near equal bytes over atomic groups of equal texts.

Groups are ordered by a digest of their text. The smallest feasible capacity of
a shard is found by binary search with a greedy check; cuts are then placed as
near to equal shares as that capacity allows. The driver never sees the groups:
it holds sums over ranges of the digest, and ranges in which a cut could fall are
split further (``FINE`` parts each) until the capacity is exact.

Edge cases: a null text has size 1 and no crc32, and all null texts are one group;
equal texts always share a shard, so one group above a fair share sets the capacity;
repeated rows have slots of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_rank
from .base import materialize

DIGEST_BITS = 60
COARSE_BITS = 12
FINE_BITS = 8


class _Ranges:
    """Sums over ranges of the digest, in order; ``single`` where a range is one group."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: r["low"])
        self.low = [int(r["low"]) for r in rows]
        self.bits = [int(r["bits"]) for r in rows]
        self.size = np.array([int(r["bytes"]) for r in rows], dtype=np.int64)
        self.single = np.array([int(r["groups"]) == 1 for r in rows], dtype=bool)
        self.biggest = max((int(r["biggest"]) for r in rows), default=0)
        self.edge = np.concatenate([[0], np.cumsum(self.size)])
        self.rows = rows

    def cut(self, at: int, anywhere: bool) -> int:
        """Last possible cut at or before ``at`` bytes: at a range's edge, or anywhere in a range of several groups."""
        i = int(np.searchsorted(self.edge, at, side="right")) - 1
        if i >= len(self.size):
            return int(self.edge[-1])
        return at if anywhere and not self.single[i] else int(self.edge[i])

    def greedy(self, capacity: int, shards: int, anywhere: bool) -> list[int]:
        cuts, at = [], 0
        for _ in range(shards):
            at = self.cut(at + capacity, anywhere)
            cuts.append(at)
        return cuts

    def least_capacity(self, shards: int, anywhere: bool) -> int:
        total = int(self.edge[-1])
        low, high = max(-(-total // shards), self.biggest), total
        while low < high:
            middle = (low + high) // 2
            if self.greedy(middle, shards, anywhere)[-1] >= total:
                high = middle
            else:
                low = middle + 1
        return low

    def balanced(self, capacity: int, shards: int) -> list[int]:
        """Indexes of the ranges after which a shard ends: near equal shares, none above ``capacity``."""
        total, edge = int(self.edge[-1]), self.edge
        earliest, at = [0] * (shards + 1), total  # where the cuts must be at least, so that the rest still fits
        earliest[shards] = total
        for s in range(shards - 1, 0, -1):
            at = int(edge[np.searchsorted(edge, at - capacity, side="left")]) if at > capacity else 0
            earliest[s] = at
        cuts, at = [], 0
        for s in range(1, shards):
            ideal = at + (total - at) / (shards - s + 1)
            i = int(np.searchsorted(edge, ideal))
            near = min((int(edge[j]) for j in (i - 1, i) if 0 <= j < len(edge)), key=lambda x: abs(x - ideal))
            latest = self.cut(at + capacity, False)
            at = max(earliest[s], min(near, latest), at)
            cuts.append(int(np.searchsorted(edge, at)))
        return cuts


def _sums(groups: DataFrame, low: Column, bits: int) -> list:
    found = groups.groupBy(low.alias("low")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("groups"), F.max("bytes").alias("biggest"))
    return found.withColumn("bits", F.lit(bits)).collect()


def cut_keys(groups: DataFrame, shards: int) -> list[int]:
    """Digests at which shards 1 and up begin, for ``groups`` of (key, bytes)."""
    bits = DIGEST_BITS - COARSE_BITS
    start = lambda width: F.shiftleft(F.shiftright("key", width), width)
    ranges = _Ranges(_sums(groups, start(bits), bits))
    if not ranges.rows:
        return []
    while True:
        low, high = ranges.least_capacity(shards, True), ranges.least_capacity(shards, False)
        if low == high:
            break
        doubt = np.zeros(len(ranges.size), bool)
        for first, last in zip(ranges.greedy(low, shards, False), ranges.greedy(high, shards, True), strict=True):
            a, b = np.searchsorted(ranges.edge, [first, last], side="right") - 1
            doubt[max(a, 0) : b + 1] = True
        doubt &= ~ranges.single
        if not doubt.any():
            break
        # one job for all ranges of the same width
        width = max(ranges.bits[i] for i in np.flatnonzero(doubt))
        chosen = [i for i in np.flatnonzero(doubt) if ranges.bits[i] == width]
        finer = max(width - FINE_BITS, 0)
        inside = groups.where(start(width).isin([ranges.low[i] for i in chosen]))
        kept = [r for i, r in enumerate(ranges.rows) if i not in set(chosen)]
        ranges = _Ranges(kept + _sums(inside, start(finer), finer))
    lows = [*ranges.low, 1 << (DIGEST_BITS + 1)]
    return [lows[i] for i in ranges.balanced(high, shards)]


def minimax_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document."""
    text = F.col("text").cast("string")
    digest = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, DIGEST_BITS // 4), 16, 10).cast("long")
    rows = materialize(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(digest, F.lit(1 << DIGEST_BITS)).alias("key"),
    ), "sizes")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    shard = F.lit(0)
    for k in cut_keys(groups, shards):
        shard = shard + F.when(F.col("key") >= k, 1).otherwise(0)
    placed = global_rank(rows.withColumn("shard", shard.cast("int")), ["key", "doc_id"], "rank")
    before, base = 0, F.lit(0)
    for r in sorted(rows.groupBy(shard.alias("shard")).count().collect(), key=lambda r: r["shard"]):  # a row per shard
        base = F.when(F.col("shard") == r["shard"], F.lit(before)).otherwise(base)
        before += r["count"]
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - 1 - base).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
