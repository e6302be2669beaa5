"""Whole texts as numpy arrays: words, hashed words and hashed byte strings of many documents at once.

A ``Scan`` lays the texts of a slice of documents one after the other, with one
line feed before, between and after them. All positions below are positions in
``Scan.buf``. Hashes are polynomial modulo 2**64 with mixed letters, then mixed again.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LETTER = mix(np.arange(1, 257, dtype=np.uint64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


class Scan:
    """``texts``: one bytes object per document (null as empty)."""

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        self.buf = LOWER[raw] if lower else raw
        self.start = 1 + np.concatenate([[0], np.cumsum(self.size + 1)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        self.end = self.start + self.size
        self._sums: np.ndarray | None = None

    def sums(self) -> np.ndarray:
        if self._sums is None:
            up, _ = _power_tables(len(self.buf) + 1)
            self._sums = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum(_LETTER[self.buf] * up[: len(self.buf)], out=self._sums[1:])
        return self._sums

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``buf[start:end]`` for arrays of positions; its length counts."""
        sums = self.sums()
        _, down = _power_tables(len(self.buf) + 1)
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the ``k`` bytes at each position that has as many."""
        sums = self.sums()
        _, down = _power_tables(len(self.buf) + 1)
        n = len(self.buf) - k + 1
        return mix((sums[k:] - sums[:-k]) * down[:n]) if n > 0 else np.zeros(0, np.uint64)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the number of words of each document."""
        space = SPACE[self.buf]
        first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        last = np.flatnonzero(~space[:-1] & space[1:]) + 1
        edge = np.searchsorted(first, np.append(self.start, len(self.buf)))
        return first, last, np.diff(edge)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each line between line feeds, and the number of lines of each document."""
        feeds = np.flatnonzero(self.buf == 10)
        first, last = feeds[:-1] + 1, feeds[1:]
        edge = np.searchsorted(first, np.append(self.start, len(self.buf)))
        return first, last, np.diff(edge)


def owner(counts: np.ndarray) -> np.ndarray:
    """Number of the document that each of its ``counts`` parts belongs to."""
    return np.repeat(np.arange(len(counts)), counts)


def total(values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Sum of integer values of each owner."""
    return np.bincount(owners, weights=values, minlength=n).astype(np.int64)


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed ``k``-word shingles per document, sorted by (document, hash): owners and hashes.

    A document with fewer words has its whole sequence as one shingle; without words it has none.
    """
    n = len(words)
    doc = owner(counts)
    first = np.cumsum(counts) - counts
    place = np.arange(n) - np.repeat(first, counts)
    short = counts < k
    keep = np.repeat(counts, counts) - place >= k
    keep |= np.repeat(short, counts) & (place == 0)
    at = np.flatnonzero(keep)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = place[at] + j < counts[doc[at]]
        word = np.where(inside, words[np.minimum(at + j, n - 1)], np.uint64(j + 1)) if n else words
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + word)
    return distinct(doc[at], h)


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted by (document, hash); ``doc`` ascends."""
    h = h.copy()
    cut = np.flatnonzero(doc[1:] != doc[:-1]) + 1
    for part in np.split(h, cut):
        part.sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[cut] = True
    return doc[new], h[new]


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", budget: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches again in slices of about ``budget`` bytes of text, one document at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + budget, side="right")))
            yield batch.slice(at, to - at)
            at = to


KEPT_POWERS = 1 << 21  # entries of the power tables that a worker keeps between groups
_settled = [0.0]


def settle(often: float = 0.0) -> None:
    """Give back what a worker has freed, at most once in ``often`` seconds: workers live on, beside those of later stages."""
    now = time.monotonic()
    if now - _settled[0] < often:
        return
    _settled[0] = now
    if len(_powers[0]) > KEPT_POWERS:
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def settled(fn: Callable) -> Callable:
    """A grouped function that settles after its groups. Spark looks at the number of arguments, so it stays."""
    count = fn.__code__.co_argcount
    if count == 1:

        def one(table: pa.Table) -> pa.Table:
            out = fn(table)
            settle(1.0)
            return out

        return one
    if count == 2:

        def two(first, second):
            out = fn(first, second)
            settle(1.0)
            return out

        return two

    def three(key, first, second):
        out = fn(key, first, second)
        settle(1.0)
        return out

    return three


def settled_map(fn: Callable) -> Callable:
    """A function over batches that settles when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        settle()

    return run
