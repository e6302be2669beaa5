"""Fitting a model of bounded size on a bounded sample of labelled rows, inside one Spark task."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = dict[str, np.ndarray]


def sample_of(labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled keys, the same on every run: those with the smallest hash."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(label).alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)


def with_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The sample's documents; the broadcast side has at most the rows of the sample, of two short columns."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(sample), "doc_id")


def fit(sample: DataFrame, train: Callable[[list[bytes], list], Model]) -> Broadcast | None:
    """Run ``train(texts, labels)`` over the whole sample in one task; None where the sample is empty."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), table.column("label").to_pylist(), strict=True))
        out = io.BytesIO()
        np.savez(out, **train([r[1].encode() for r in rows], [r[2] for r in rows]))
        return pa.table({"model": pa.array([out.getvalue()], pa.binary())})

    found = sample.withColumn("every", F.lit(0)).groupBy("every").applyInArrow(run, "model binary").collect()
    if not found:
        return None
    with np.load(io.BytesIO(found[0]["model"])) as stored:
        return sample.sparkSession.sparkContext.broadcast({k: stored[k] for k in stored.files})


def platt(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by Newton steps on smoothed targets."""
    n1, n0 = float(positive.sum()), float((~positive).sum())
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, w = p - target, np.maximum(p * (1 - p), 1e-9)
        ga, gb = float(g @ margin) + 1e-6 * a, float(g.sum())
        haa, hab, hbb = float(w @ margin**2) + 1e-6, float(w @ margin), float(w.sum()) + 1e-9
        det = haa * hbb - hab * hab
        if det <= 1e-18:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 4.0 / (abs(da) + abs(db) + 1e-12))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-8:
            break
    return max(a, 1e-3), b


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
