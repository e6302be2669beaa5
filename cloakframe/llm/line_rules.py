"""Quality rules with the frequency of lines across the documents of a host.

Every line of every document is normalised (A-Z lower-cased, digits as 0, white
space collapsed) and hashed. A line found in more than ``max_docs`` documents of
one host is removed from all of them; a document of which too little is left is
rejected. A base check of the single text runs before.

Edge cases: a null text counts as empty and fails the base check; a null host is
a host of its own; lines without a word are never counted; a repeated row is a
document of its own; columns besides the three named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize
from .text import _BASE, _BASE_INVERSE, LOWER, SPACE, Scan, as_bytes, distinct, mix, owner, slices, total

MAX_DOCS = 30  # documents of one host that may share a line
LEAST_LEFT = 30  # per cent of a document's words that must be left
SALTS = 32
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FOLD = LOWER.copy()
_FOLD[48:58] = 48


def line_hashes(scan: Scan, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line: the hash of its normalised words in order, its words, and its document."""
    folded = Scan([], False)
    folded.buf = _FOLD[scan.buf]
    space = SPACE[folded.buf]
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    last = np.flatnonzero(~space[:-1] & space[1:]) + 1
    begin, _, lines = scan.lines()
    edge = np.searchsorted(first, np.append(begin, len(scan.buf)))
    n = len(first) + 1
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]).astype(np.uint64))
    down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE_INVERSE)]).astype(np.uint64))
    sums = np.zeros(n, np.uint64)
    np.cumsum(folded.hashes(first, last) * up[:-1], out=sums[1:])
    words = np.diff(edge)
    h = mix((sums[edge[1:]] - sums[edge[:-1]]) * down[edge[:-1]] + words.astype(np.uint64))
    return h, words, owner(lines)


def repeated_words(h: np.ndarray, counts: np.ndarray, k: int = 5) -> np.ndarray:
    """Words of each document inside a window of ``k`` words that the document holds twice or more."""
    out = np.zeros(len(counts), np.int64)
    if len(h) < k:
        return out
    grams = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        grams = mix(grams * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - k + 1 + j])
    first = np.cumsum(counts) - counts
    for d in np.flatnonzero(counts > k):
        own = grams[first[d] : first[d] + counts[d] - k + 1]
        ranked = np.sort(own)
        twice = ranked[1:][ranked[1:] == ranked[:-1]]
        if len(twice):
            at = np.flatnonzero(np.isin(own, twice))
            cover = np.zeros(counts[d] + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + k, -1)
            out[d] = int((np.cumsum(cover[:-1]) > 0).sum())
    return out


def text_measures(texts: list[bytes]) -> dict[str, np.ndarray]:
    scan = Scan(texts)
    first, last, counts = scan.words()
    n = len(texts)
    inside = np.concatenate([[0], np.cumsum(~SPACE[scan.buf] & ((scan.buf & 0xC0) != 0x80))])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[scan.buf])])
    h, words, doc = line_hashes(scan, counts)
    begin, end, _ = scan.lines()
    real = words > 0
    once, _ = distinct(doc[real], scan.hashes(begin[real], end[real]))
    owners, lines = distinct(doc[real], h[real])
    # words of all lines of a document with the same normalised form
    pair = _locate(owners, lines, doc[real], h[real])
    return {
        "n_words": counts.astype(np.int64),
        "word_chars": inside[scan.end] - inside[scan.start],
        "n_symbols": symbols[scan.end] - symbols[scan.start],
        "n_dup_lines": np.bincount(doc[real], minlength=n) - np.bincount(once, minlength=n),
        "n_repeat_words": repeated_words(scan.hashes(first, last), counts),
        "line_hash": lines.view(np.int64), "line_words": total(words[real], pair, len(lines)),
        "n_lines": np.bincount(owners, minlength=n),
    }


def _locate(owners: np.ndarray, lines: np.ndarray, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each (document, hash) among the distinct ones."""
    out = np.zeros(len(h), np.int64)
    edge, own = np.searchsorted(owners, np.arange(doc[-1] + 2 if len(doc) else 1)), np.searchsorted(doc, np.arange(doc[-1] + 2 if len(doc) else 1))
    for d in range(len(edge) - 1):
        out[own[d] : own[d + 1]] = edge[d] + np.searchsorted(lines[edge[d] : edge[d + 1]], h[own[d] : own[d + 1]])
    return out


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("host", pa.string()), *[(m, pa.int64()) for m in MEASURES],
    ("line_hash", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int64())),
])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = text_measures(as_bytes(part.column("text")))
        offsets = pa.array(np.concatenate([[0], np.cumsum(found["n_lines"])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(found[k])) for k in ("line_hash", "line_words")]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("host"), *[pa.array(found[m].astype(np.int64)) for m in MEASURES], *lists], schema=_SCHEMA
        )


def line_rules(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, least_left: int = LEAST_LEFT) -> DataFrame:
    """One row per document: its measures, ``base_failed``, the words and lines removed, and ``kept``.

    The hashes of lines are counted per host with a partial count before the
    shuffle; lines above the limit meet the documents again in a join that is
    salted by document, so a line of a third of all documents is split.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"))
    fields = ", ".join(["doc_id long", "host string", *[f"{m} long" for m in MEASURES], "line_hash array<long>", "line_words array<long>"])
    rows = materialize(named.mapInArrow(_measure, fields).withColumn("row", F.monotonically_increasing_id()), "measured")
    lines = rows.select("row", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("none"), F.explode(F.arrays_zip("line_hash", "line_words")).alias("l"))
    lines = lines.select("row", "host", "none", F.col("l.line_hash").alias("line"), F.col("l.line_words").alias("words"))
    frequent = lines.groupBy("host", "none", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > max_docs).drop("docs")
    frequent = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    removed = (
        salted.join(frequent, ["host", "none", "line", "salt"])
        .groupBy("row").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_lines"))
    )
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return (
        rows.drop("line_hash", "line_words").join(removed, "row", "left").drop("row")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & (100 * left >= least_left * F.col("n_words")))
    )


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        texts = as_bytes(part.column("text"))
        scan = Scan(texts)
        h, words, doc = line_hashes(scan, scan.words()[2])
        gone = part.column("removed_lines").to_pylist()
        edge = np.searchsorted(doc, np.arange(len(texts) + 1))
        out = []
        for d, text in enumerate(texts):
            if not gone[d]:
                out.append(text)
                continue
            drop = np.isin(h[edge[d] : edge[d + 1]].view(np.int64), gone[d]) & (words[edge[d] : edge[d + 1]] > 0)
            out.append(b"\n".join(x for x, y in zip(text.split(b"\n"), drop, strict=True) if not y))
        yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(out, pa.binary()).cast(pa.string()))


def strip_lines(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The texts of the kept documents without their removed lines; ``doc_id`` must be unique."""
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(verdicts.where("kept").select("doc_id", "removed_lines"), "doc_id")
    return both.mapInArrow(_strip, "doc_id long, text string, removed_lines array<long>").drop("removed_lines")
