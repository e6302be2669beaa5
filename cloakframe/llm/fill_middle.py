"""Fill-in-the-middle: texts cut in three and reordered, with counts kept per content-defined chunk.

A rolling hash of the last ``WINDOW`` bytes ends a chunk wherever its low bits are all
ones, so equal passages fall into equal chunks wherever they stand. What a chunk adds to a
document is a small summary: how many units begin in it, were it to stand after a gap, and
whether its first and last bytes belong to a unit. Summaries are kept per worker under the
chunk's whole content (a hit is one whose bytes are equal), within ``CACHE_BYTES``. Added up in
order they give the document's length; a cut is found by searching the running counts and
then inside one chunk. The result never depends on what a worker remembers.

Units are code points or words; a word keeps the white space behind it, and what stands
before the first word belongs to that word.

Edge cases: a null or empty text has no unit and stays plain, with the empty output; a
text that contains a marker stays plain; very long texts are hashed in blocks of ``BLOCK``
bytes; repeated rows give the same row each; a null doc_id draws as if it were spelled
``-``; equal draws give an empty middle; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, as_bytes, mix, slices

MARKERS = ("<P>", "<S>", "<M>")
PLAIN_FROM = 90  # of 100: the rest of the documents is reordered
SPM_BELOW = 20  # of 100 of those: suffix first
WINDOW = 16
CHUNK_BITS = np.uint32((1 << 9) - 1)  # chunks of 512 bytes in the mean
LONGEST = 4096
BLOCK = 1 << 20
CACHE_BYTES = 16_000_000
_GEAR = mix(np.arange(257, 513, dtype=np.uint64)).astype(np.uint32)


def rolling(buf: np.ndarray) -> np.ndarray:
    """Hash of the ``WINDOW`` bytes that end at each position, built by doubling the window."""
    h = _GEAR[buf]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def chunk_ends(buf: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ends of the chunks of documents that begin at ``first`` (ascending; the first at 0) and fill ``buf``."""
    cuts = []
    for at in range(0, len(buf), BLOCK):
        back = min(at, WINDOW - 1)
        found = np.flatnonzero((rolling(buf[at - back : at + BLOCK]) & CHUNK_BITS) == CHUNK_BITS)
        cuts.append(found[found >= back] + (at - back))
    at = np.concatenate(cuts) if cuts else np.zeros(0, np.int64)
    home = np.searchsorted(first, at, side="right") - 1
    at = at[at - first[home] >= WINDOW - 1] + 1  # the window lies within its document
    ends = np.unique(np.concatenate([at, first[1:], [len(buf)]]))
    ends = ends[ends > 0]
    size = np.diff(ends, prepend=0)
    parts = -(-size // LONGEST)
    if (parts > 1).any():
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        ends = np.minimum(np.repeat(ends - size, parts) + (inner + 1) * LONGEST, np.repeat(ends, parts))
    return ends


@dataclass(frozen=True)
class Units:
    """``begins(chunk, after_gap)``: where units begin in a chunk's bytes; ``joins``: whether a unit runs over a chunk's edge."""

    name: str

    def begins(self, chunk: bytes, after_gap: bool = True) -> np.ndarray:
        raw = np.frombuffer(chunk, np.uint8)
        if self.name == "chars":
            return np.flatnonzero((raw & 0xC0) != 0x80)
        inside = ~SPACE[raw]
        return np.flatnonzero(inside & np.concatenate([[after_gap], ~inside[:-1]])) if len(raw) else np.zeros(0, np.int64)

    def summary(self, chunk: bytes) -> tuple[int, bool, bool]:
        """Units that begin in it, were it to stand after a gap; whether its first and its last byte are inside a word."""
        edge = (False, False) if self.name == "chars" else (not SPACE[chunk[0]], not SPACE[chunk[-1]])
        return (len(self.begins(chunk)), *edge)


UNITS = {name: Units(name) for name in ("chars", "words")}


class Memory:
    """Summaries of chunks by content: two generations, so that what is used stays and the bytes are bounded."""

    def __init__(self, units: Units) -> None:
        self.units = units
        self.young: dict[bytes, tuple[int, bool, bool]] = {}
        self.old: dict[bytes, tuple[int, bool, bool]] = {}
        self.size = 0

    def of(self, chunk: bytes) -> tuple[int, bool, bool]:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk) or self.units.summary(chunk)
            if self.size > CACHE_BYTES // 2:
                self.young, self.old, self.size = {}, self.young, 0
            self.young[chunk] = found
            self.size += len(chunk) + 100
        return found


class Counted:
    """A document as its chunks and the running number of units that begin before each of them."""

    def __init__(self, chunks: Sequence[bytes], memory: Memory) -> None:
        self.chunks, self.units = chunks, memory.units
        found = [memory.of(c) for c in chunks]
        n = np.array([f[0] for f in found], np.int64)
        head, tail = np.array([f[1] for f in found], bool), np.array([f[2] for f in found], bool)
        self.runs_on = np.zeros(len(found), bool)  # its first unit began in an earlier chunk
        self.runs_on[1:] = tail[:-1] & head[1:]
        self.before = np.concatenate([[0], np.cumsum(n - self.runs_on)]).astype(np.int64)
        self.offset = np.concatenate([[0], np.cumsum([len(c) for c in chunks])]).astype(np.int64)
        self.n = int(self.before[-1])

    def cut(self, k: int) -> int:
        """Offset in bytes behind the first ``k`` units."""
        if k <= 0 or not self.n:
            return 0
        if k >= self.n:
            return int(self.offset[-1])
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        begins = self.units.begins(self.chunks[at], not self.runs_on[at])
        return int(self.offset[at] + begins[k - self.before[at]])


def counted(texts: list[bytes], memory: Memory) -> Iterator[Counted]:
    """The texts of a slice, chunked together."""
    full = [t for t in texts if t]
    raw = b"".join(full)
    first = np.cumsum([0, *map(len, full[:-1])]).astype(np.int64) if full else np.zeros(0, np.int64)
    ends = chunk_ends(np.frombuffer(raw, np.uint8), first) if full else np.zeros(0, np.int64)
    last = np.searchsorted(ends, first + [len(t) for t in full], side="right") if full else first
    lows = np.concatenate([[0], ends[:-1]]).astype(np.int64).tolist() if full else []
    tops, number, at = ends.tolist(), 0, 0
    for text in texts:
        if not text:
            yield Counted([], memory)
            continue
        to = int(last[number])
        yield Counted([raw[a:b] for a, b in zip(lows[at:to], tops[at:to], strict=True)], memory)
        at, number = to, number + 1


_memories: dict[str, Memory] = {}


def _reorder(units: str, markers: Sequence[str]):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_units", pa.int64()), ("middle_units", pa.int64()), ("output", pa.string())])
    p, s, m = (x.encode() for x in markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memories.setdefault(units, Memory(UNITS[units]))
        for part in slices(batches):
            texts = as_bytes(part.column("text"))
            one, two, form = (part.column(c).to_pylist() for c in ("one", "two", "form"))
            rows = []
            for i, doc in enumerate(counted(texts, memory)):
                text = texts[i]
                if form[i] == "plain" or not doc.n:
                    rows.append((doc.n, "plain", None, None, text))
                    continue
                a, b = sorted((one[i] % (doc.n + 1), two[i] % (doc.n + 1)))
                x, y = doc.cut(a), doc.cut(b)
                prefix, middle, suffix = text[:x], text[x:y], text[y:]
                out = (p + prefix + s + suffix + m + middle) if form[i] == "psm" else (s + suffix + p + prefix + m + middle)
                rows.append((doc.n, form[i], a, b - a, out))
            n, forms, first, second, out = zip(*rows, strict=True)
            made = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), made], schema=schema)

    return run


def draws(doc_id: str, seed: str, count: int = 4) -> list[Column]:
    """The first groups of eight digits of the hex SHA-256 of seed, colon and decimal doc_id, as integers."""
    text = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("-"))), 256)
    return [F.conv(F.substring(text, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def fill_middle(docs: DataFrame, seed: str = "1", units: str = "chars", markers: Sequence[str] = MARKERS, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """``doc_id, n, form, prefix_units, middle_units, output`` of every document; ``output`` is what a model would read."""
    if len(set(markers)) != 3 or not all(markers) or any(a in b for a in markers for b in markers if a != b):
        raise ValueError("three markers are needed, none of them part of another")
    if any(a[i:] == b[: len(a) - i] for a in markers for b in markers for i in range(1, len(a))):
        raise ValueError("no marker may end as another one begins")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    one, two, three, four = draws("doc_id", seed)
    marked = F.lit(False)
    for x in markers:
        marked = marked | F.contains("text", F.lit(x))
    form = F.when((F.col("text") == "") | marked | (three % 100 >= plain_from), "plain").when(four % 100 < spm_below, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", one.alias("one"), two.alias("two"), form.alias("form"))
    return rows.mapInArrow(_reorder(units, markers), "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an output was made of: parts between the markers, put back in order."""
    parts = F.split(output, "|".join(re.escape(x) for x in markers), -1)
    part = lambda k: F.get(parts, F.lit(k))
    psm, spm = F.concat(part(1), part(3), part(2)), F.concat(part(2), part(3), part(1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def restore_middle(outputs: DataFrame, markers: Sequence[str] = MARKERS) -> DataFrame:
    """``outputs(output, form)`` with their ``text``."""
    return outputs.withColumn("text", restored(F.col("output"), F.col("form"), markers))
