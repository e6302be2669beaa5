"""Toxicity of whole texts by embeddings of subwords, averaged into a linear softmax.

A text is cut into windows of ``WINDOW`` words. A window is the average of the
vectors of its words' three to five byte n-grams (word ends included, A-Z
lower-cased, white space of any kind alike) and of the words themselves, hashed
into buckets, so an unseen spelling shares most vectors with a known one.
Vectors and softmax are trained together. Labels are of documents: a first round
averages whole documents, later rounds use the window of each document that
scores highest now, and a random one of each clean document. The score of a
document is that of its highest window.

Edge cases: a null text is an empty one and scores as a window whose average is
zero; with labels of one class only, every score is the smoothed share of that class; without labels it is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import held_out
from .fitting import Model, fit, logistic, platt, sample_of, with_texts
from .text import LOWER, SPACE, Scan, as_bytes, owner, slices

TOXIC_ROWS, CLEAN_ROWS = 1200, 1800  # labelled documents of either class the model is fitted on, at most
WINDOW = 4  # words
BITS = 17
SIZE = 8  # numbers in a vector
LEAST_DOCUMENTS = 5  # of the sample that hold a bucket; rarer buckets stay zero
RATE, SCALE = 0.1, 200.0  # step of the softmax; step of the vectors relative to it
WHOLE_ROUNDS, WINDOW_ROUNDS = 2, 14
_FOLD = LOWER.copy()
_FOLD[SPACE] = 10


class Bags:
    """Subwords of many documents: bucket and window of each, and the document of each window."""

    def __init__(self, texts: list[bytes]) -> None:
        scan = Scan(texts)
        scan.buf = _FOLD[scan.buf]
        first, last, counts = scan.words()
        windows = np.maximum(-(-counts // WINDOW), 1)
        self.doc = owner(windows)
        before = np.cumsum(windows) - windows
        place = np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts)
        window = np.repeat(before, counts) + place // WINDOW
        found = [(scan.hashes(first, last), window)]
        space = SPACE[scan.buf]
        spaces = np.concatenate([[0], np.cumsum(space)])
        word_at = np.cumsum(~space & np.concatenate([[True], space[:-1]])) - 1
        for k in (3, 4, 5):
            grams = scan.grams(k)
            at = np.arange(len(grams))
            good = np.flatnonzero(spaces[at + k - 1] == spaces[at + 1])
            found.append((grams[good], window[word_at[good + 1]] if len(window) else good))
        self.bucket = np.concatenate([(h >> np.uint64(64 - BITS)).astype(np.int64) for h, _ in found])
        self.window = np.concatenate([w for _, w in found])
        self.n = len(self.doc)

    @classmethod
    def of_sample(cls, texts: list[bytes], step: int = 200) -> Bags:
        """The same in order of windows, made a few documents at a time to keep temporary arrays small."""
        out, buckets, windows, docs, n = cls([]), [], [], [], 0
        for i in range(0, len(texts), step):
            part = cls(texts[i : i + step])
            order = np.argsort(part.window, kind="stable")
            buckets.append(part.bucket[order].astype(np.int32))
            windows.append((part.window[order] + n).astype(np.int32))
            docs.append(part.doc + i)
            n += part.n
        out.bucket, out.window, out.doc, out.n = np.concatenate(buckets), np.concatenate(windows), np.concatenate(docs), n
        return out


def window_scores(model: Model, bags: Bags) -> np.ndarray:
    sums = np.bincount(bags.window, model["weight"][bags.bucket], bags.n)
    return sums / np.maximum(np.bincount(bags.window, minlength=bags.n), 1)


def _epoch(vectors: np.ndarray, usable: np.ndarray, soft: np.ndarray, state: np.ndarray, parts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rng, rate: float, scale: float) -> None:
    """One pass of mini-batches; ``soft`` is two rows of weights and a bias column, its steps shrink with its gradients (Adagrad)."""
    for batch in np.array_split(rng.permutation(len(parts)), max(1, len(parts) // 128)):
        sizes = np.array([max(len(parts[i]), 1) for i in batch])
        ids = np.concatenate([parts[i] if len(parts[i]) else np.zeros(1, np.int64) for i in batch])
        own = owner(sizes)
        mean = np.stack([np.bincount(own, vectors[ids, d], len(batch)) for d in range(SIZE)], 1) / sizes[:, None]
        logits = mean @ soft[:, :SIZE].T + soft[:, SIZE]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(batch)), y[batch]] -= 1
        p *= weight[batch][:, None]
        grad_soft = np.hstack([p.T @ mean, p.sum(0)[:, None]])
        back = (p @ soft[:, :SIZE]) / sizes[:, None]
        state += grad_soft**2
        soft -= rate * grad_soft / np.sqrt(state + 1e-8)
        for d in range(SIZE):
            vectors[:, d] -= rate * scale * np.bincount(ids, back[own, d], 1 << BITS) * usable


def train(texts: list[bytes], labels: list[int]) -> Model:
    y = (np.array(labels) == 1).astype(np.int64)
    n1, n = int(y.sum()), len(y)
    if n1 in (0, n):
        share = (n1 + 1) / (n + 2)
        return {"weight": np.zeros(1 << BITS, np.float32), "curve": np.array([1.0, np.log(share / (1 - share))])}
    rng = np.random.default_rng(11)
    bags = Bags.of_sample(texts)
    edge = np.searchsorted(bags.window, np.arange(bags.n + 1))
    of_doc = np.searchsorted(bags.doc, np.arange(n + 1))
    vectors = rng.normal(0, 0.1, (1 << BITS, SIZE))
    soft = np.hstack([rng.normal(0, 1, (2, SIZE)), np.zeros((2, 1))])
    state = np.full((2, SIZE + 1), 1e-6)
    holders = np.zeros(1 << BITS, np.int64)
    for i in range(n):
        holders[np.unique(bags.bucket[edge[of_doc[i]] : edge[of_doc[i + 1]]])] += 1
    usable = (holders >= LEAST_DOCUMENTS).astype(float)
    vectors *= usable[:, None]
    balance = np.where(y == 1, n / (2 * n1), n / (2 * (n - n1)))
    fold = np.arange(n) % 4 == 3
    chosen = np.flatnonzero(~fold)

    def flat() -> Model:
        return {"weight": vectors @ (soft[1, :SIZE] - soft[0, :SIZE])}

    def top(score: np.ndarray) -> np.ndarray:
        order = np.lexsort((score, bags.doc))
        return order[of_doc[1:] - 1]

    whole = [bags.bucket[edge[of_doc[i]] : edge[of_doc[i + 1]]] for i in chosen]
    for _ in range(WHOLE_ROUNDS):
        _epoch(vectors, usable, soft, state, whole, y[chosen], balance[chosen], rng, RATE, SCALE)
    for _ in range(WINDOW_ROUNDS):
        best = top(window_scores(flat(), bags))
        other = of_doc[:-1] + rng.integers(0, of_doc[1:] - of_doc[:-1])
        clean = chosen[y[chosen] == 0]
        use = np.concatenate([best[chosen], other[clean]])
        labels_now = np.concatenate([y[chosen], y[clean]])
        weight = np.concatenate([balance[chosen], balance[clean] / 2])
        _epoch(vectors, usable, soft, state, [bags.bucket[edge[w] : edge[w + 1]] for w in use], labels_now, weight, rng, RATE, SCALE)
    model = flat()
    score = window_scores(model, bags)
    margin = score[top(score)]
    left = np.flatnonzero(fold) if 0 < y[fold].sum() < fold.sum() else np.arange(n)
    model["curve"] = np.array(platt(margin[left] / max(float(np.abs(margin[left]).mean()), 1e-9), y[left] == 1))
    model["curve"][0] /= max(float(np.abs(margin[left]).mean()), 1e-9)
    model["weight"] = model["weight"].astype(np.float32)
    return model


def score(model: Model, texts: list[bytes]) -> np.ndarray:
    bags = Bags(texts)
    found = window_scores(model, bags)
    best = np.maximum.reduceat(found, np.searchsorted(bags.doc, np.arange(len(texts)))) if len(texts) else found
    a, b = model["curve"]
    return logistic(a * best + b)


def toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.5, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; fitted on at most so many rows of either class of ``labels``."""
    learn = labels.where(~held_out("doc_id", 5, 0))
    sample = sample_of(learn.where(F.col("toxic") == 1), "doc_id", "toxic", toxic_rows)
    sample = sample.unionByName(sample_of(learn.where(F.col("toxic") == 0), "doc_id", "toxic", clean_rows))
    model = fit(with_texts(docs, sample), train)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = as_bytes(part.column("text"))
            found = score(model.value, texts) if model is not None else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], schema=schema)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = named.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
