"""Documents in shards of bounded bytes, and exact corpus counts of hashed keys per shard.

A shard is a group of whole documents by a hash of ``doc_id``, of the text where that is
null. Its distinct keys
(40 bits of a hash) are sent to ranges of keys, delta coded, one row per shard and
range; a range adds up the counts of all shards and answers each shard with one
code per key. Both sides are counted before they are sent, so a key found
everywhere costs one entry per shard. Rows between them are shards times ranges,
so neither may be small where the documents are many. Two keys that fall together share a count,
which may be too high but never too low.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import width_for
from .text import as_bytes, settled

SHARD_BYTES = 8_000_000
MOST_SHARDS = 1024  # of a wide session over few bytes
RANGE_BYTES = 16_000_000
KEY_BITS = 40
NO_ID = (1 << 63) - 1
_codec = pa.Codec("zstd", compression_level=3)
_size = np.dtype("<i8")


def packed(values: np.ndarray) -> bytes:
    """An array as bytes: planes of the bytes of its numbers, compressed."""
    raw = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def unpacked(data: bytes, dtype: str) -> np.ndarray:
    raw = _codec.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    kind = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


@dataclass
class Shards:
    docs: DataFrame  # the documents with the column shard
    count: int
    bytes: int

    def ranges(self, each: float) -> int:
        """Number of ranges when a range should get about ``each`` bytes of the documents' text."""
        return width_for(self.docs.sparkSession, self.bytes, each)


def sharded(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> Shards:
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).cast("long")).first()[0]
    spark = docs.sparkSession
    width = width_for(spark, 0, 1)
    count = max(width, min(4 * width, MOST_SHARDS), -(-total // shard_bytes))
    return Shards(docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(count)).cast("int")), count, total)


def in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """A shard's documents in an order that is the same on every run, their ids (null last) and texts."""
    texts = as_bytes(table.column("text"))
    ids = np.array([NO_ID if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    return table.take(pa.array(order, pa.int64())), ids[order], [texts[i] for i in order]


def parts(texts: list[bytes], budget: int = 1_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of documents of about ``budget`` bytes with the number of their first one."""
    at, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > budget:
            yield at, texts[at:i]
            at, total = i, 0
        total += len(text) + 1
    if at < len(texts):
        yield at, texts[at:]


def by_range(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of ascending keys by (range, key), the ranges that occur, and where each begins and the last ends."""
    which = (keys % np.uint64(ranges)).astype(np.uint16 if ranges <= 1 << 16 else np.uint32)
    order = np.argsort(which, kind="stable")
    found, first = np.unique(which[order], return_index=True)
    return order, found.astype(np.int64), np.append(first, len(keys))


def census(shards: Shards, keys_of: Callable[[np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray]], code_of: Callable[[np.ndarray], np.ndarray], ranges: int) -> DataFrame:
    """``shard, range, codes``: the code of the corpus count of each distinct key of a shard.

    ``keys_of(ids, texts)`` gives a shard's distinct keys, ascending, and their counts; ``code_of``
    turns corpus counts into codes below 256. Codes follow the keys in order of (range, key).
    """

    def send(key: tuple, table: pa.Table) -> pa.Table:
        _, ids, texts = in_order(table)
        keys, counts = keys_of(ids, texts)
        order, found, edge = by_range(keys, ranges)
        keys, counts = keys[order], counts[order].astype(np.uint32)
        rows = [(packed(np.diff(keys[a:b], prepend=np.uint64(0))), packed(counts[a:b])) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pa.table({"range": pa.array(found), "shard": pa.array(np.full(len(found), key[0].as_py()), pa.int32()),
                         "keys": pa.array([r[0] for r in rows], pa.binary()), "counts": pa.array([r[1] for r in rows], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(x, "<u8"), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        counts = [unpacked(x, "<u4") for x in table.column("counts").to_pylist()]
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(place, np.concatenate(counts), len(known)).astype(np.int64)
        codes = code_of(sums)[place].astype(np.uint8)
        edge = np.cumsum([0, *map(len, keys)])
        out = [packed(codes[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pa.table({"shard": table.column("shard"), "range": table.column("range"), "codes": pa.array(out, pa.binary())})

    sent = shards.docs.groupBy("shard").applyInArrow(settled(send), "range long, shard int, keys binary, counts binary")
    return sent.groupBy("range").applyInArrow(settled(answer), "shard int, range long, codes binary")


def codes_of(keys: np.ndarray, answers: pa.Table, ranges: int) -> np.ndarray:
    """The code of each of a shard's distinct keys, from its rows of a census."""
    order, found, _ = by_range(keys, ranges)
    rows = dict(zip(answers.column("range").to_pylist(), answers.column("codes").to_pylist(), strict=True))
    codes = np.zeros(len(keys), np.uint8)
    if len(found):
        codes[order] = np.concatenate([unpacked(rows[int(r)], "u1") for r in found])
    return codes
