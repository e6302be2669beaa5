"""Quality of whole texts by a support vector machine on naive-Bayes features.

Features are indicators of hashed n-grams: single words and pairs of words,
three bytes, and one to four word shapes (case, length, last character, equal
to the word before). Each indicator is scaled by the log ratio of its smoothed
shares in the two classes, each document to length one; then dual coordinate
descent fits a linear model to the hinge loss. A logistic curve through the
margins of rows left out of a first fit makes them probabilities.

Edge cases: a null text is an empty one and gets the curve's offset; with
labels of one class only, every score is the smoothed share of that class; without labels it is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .base import held_out
from .fitting import Model, fit, logistic, platt, sample_of, with_texts
from .text import Scan, as_bytes, mix, owner, settled_map, slices

SAMPLE_ROWS = 3000  # labelled documents the model is fitted on, at most
BITS = 18
_ONE = np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _last_class() -> np.ndarray:
    table = np.full(256, 1)
    table[48:58] = 2
    table[65:91] = 3
    table[97:123] = 4
    table[128:] = 5
    table[list(b".,;:?")] = 6
    table[list(b"!")] = 7
    return table


_CLASS = _last_class()
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True


def _shapes(scan: Scan, first: np.ndarray, last: np.ndarray, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    small = np.concatenate([[0], np.cumsum(_SMALL[scan.buf])])
    code = _CLASS[scan.buf[first]] * 8 + _CLASS[scan.buf[last - 1]]
    code = code * 4 + 2 * (small[last] == small[first]) + (last - first == 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    return (code * 2 + same).astype(np.uint64) + _ONE


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature), sorted; features below ``2**BITS``."""
    scan = Scan(texts)
    first, last, counts = scan.words()
    doc = owner(counts).astype(np.uint64)
    h = scan.hashes(first, last)
    found = [(doc, h)]
    shape = mix(_shapes(scan, first, last, h, doc)) if len(h) else h
    if len(h) > 1:
        pair = doc[1:] == doc[:-1]
        found.append((doc[1:][pair], mix(h[:-1] * _STEP + h[1:])[pair]))
    gram = shape
    for k in range(4):
        if k:
            gram = mix(gram[:-1] * _STEP + shape[k:]) if len(gram) > 1 else gram[:0]
        inside = doc[: len(gram)] == doc[k : k + len(gram)]
        found.append((doc[: len(gram)][inside], mix(gram + np.uint64(77 + k))[inside]))
    grams = scan.grams(3)
    size = np.maximum(scan.size - 2, 0)
    at = np.repeat(scan.start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    found.append((owner(size).astype(np.uint64), grams[at]))
    key = np.concatenate([(d << np.uint64(BITS)) | (x >> np.uint64(64 - BITS)) for d, x in found])
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _hinge(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights that minimise half their square norm plus ``cost`` times the hinge losses, by dual coordinate descent."""
    weights, alpha = np.zeros(1 << BITS), np.zeros(len(rows))
    rng = np.random.default_rng(7)
    norms = np.array([float(v @ v) for v in values])
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            if norms[i] <= 0:
                continue
            slope = y[i] * float(weights[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - slope / norms[i], 0.0), cost)
            if new != alpha[i]:
                weights[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                largest = max(largest, abs(new - alpha[i]))
                alpha[i] = new
        if largest < 1e-3:
            break
    return weights


def train(texts: list[bytes], labels: list[int]) -> Model:
    positive = np.array(labels) == 1
    n1, n = int(positive.sum()), len(positive)
    if n1 in (0, n):
        share = (n1 + 1) / (n + 2)
        return {"weight": np.zeros(1 << BITS, np.float32), "square": np.zeros(1 << BITS, np.float32), "curve": np.array([1.0, np.log(share / (1 - share))])}
    parts = [features(texts[i : i + 200]) for i in range(0, n, 200)]  # a few at a time keeps temporary arrays small
    doc = np.concatenate([(d + 200 * i).astype(np.int32) for i, (d, _) in enumerate(parts)])
    feature = np.concatenate([f.astype(np.int32) for _, f in parts])
    del parts
    edge = np.searchsorted(doc, np.arange(n + 1))
    rows = [feature[edge[i] : edge[i + 1]] for i in range(n)]
    y = np.where(positive, 1.0, -1.0)
    fold = np.arange(n) % 4 == 3

    def ratios(use: np.ndarray) -> np.ndarray:
        inside = use[doc]
        p = 1.0 + np.bincount(feature[inside & positive[doc]], minlength=1 << BITS)
        q = 1.0 + np.bincount(feature[inside & ~positive[doc]], minlength=1 << BITS)
        return np.log((p / p.sum()) / (q / q.sum()))

    def scaled(ratio: np.ndarray) -> list[np.ndarray]:
        out = [ratio[r].astype(np.float32) for r in rows]
        return [v / np.float32(max(np.sqrt(float(v @ v)), 1e-12)) for v in out]

    def fitted(use: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        ratio = ratios(use)
        values = scaled(ratio)
        chosen = np.flatnonzero(use)
        return _hinge([rows[i] for i in chosen], [values[i] for i in chosen], y[chosen]), ratio, values

    weights, _, values = fitted(~fold)
    left = np.flatnonzero(fold)
    curve = (4.0, 0.0)
    if positive[left].any() and not positive[left].all():
        curve = platt(np.array([float(weights[rows[i]] @ values[i]) for i in left]), positive[left])
    del values
    weights, ratio, _ = fitted(np.ones(n, bool))
    return {"weight": (weights * ratio).astype(np.float32), "square": (ratio**2).astype(np.float32), "curve": np.array(curve)}


def score(model: Model, texts: list[bytes]) -> np.ndarray:
    doc, feature = features(texts)
    margin = np.bincount(doc, model["weight"][feature], len(texts))
    norm = np.sqrt(np.bincount(doc, model["square"][feature], len(texts)))
    a, b = model["curve"]
    return logistic(a * margin / np.maximum(norm, 1e-12) + b)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, rest: int = 2, rows: int = SAMPLE_ROWS):
    """A broadcast model, learned from at most ``rows`` rows of ``labels`` outside the held-out part."""
    learn = labels.where(~held_out("doc_id", parts, rest) & F.col(label).isin(0, 1))
    return fit(with_texts(docs, sample_of(learn, "doc_id", label, rows)), train)


def score_quality(docs: DataFrame, model) -> DataFrame:
    """``docs`` with the column ``score``: the probability of class 1. A column of that name is replaced."""
    schema = pa.schema([("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = as_bytes(part.column("text"))
            found = score(model.value, texts) if model is not None else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], schema=pa.schema([*part.schema, *schema]))

    base = docs.drop("score")
    fields = StructType([*base.schema.fields, StructField("score", DoubleType())])
    return base.mapInArrow(settled_map(run), fields)


def quality(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = fit_quality(docs, labels)
    scored = score_quality(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


__all__ = ["features", "fit_quality", "quality", "score", "score_quality", "train"]
