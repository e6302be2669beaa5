"""Near-duplicate vectors by random-hyperplane sign hashing in several tables.

Equal vectors become one with a count. Each distinct vector gets, in each table, a
code of the signs of its products with random directions; vectors with the same
code in some table are compared exactly, in double precision. The number of bits
follows the number of vectors, the number of tables the wanted recall of a pair
that lies exactly at the threshold. A code shared by many vectors is cut into
blocks and compared block by block, so no task holds an unbounded group; a pair
counts in the first table in which it meets.

Edge cases: vectors that are null, zero or hold null or non-finite components
link with nothing and are their own component; vectors of different lengths never
link; a repeated vec_id counts as another vector with the same id; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize
from .components import components, local_roots

COSINE = 0.95
RECALL = 0.995  # of a pair at the threshold
IN_A_BUCKET = 64  # vectors of a code, on average
BLOCK = 512  # vectors compared with as many others in one task


def plan_tables(n: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a code and number of tables."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / IN_A_BUCKET + 1)))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _units(column: pa.Array) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in column.to_pylist()])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _coder(bits: int, tables: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("embedding")
            sizes = np.array([len(v) for v in vectors.to_pylist()])
            codes = np.zeros((batch.num_rows, tables), np.int64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                planes = np.random.default_rng(int(dim)).normal(size=(tables * bits, int(dim)))
                signs = (_units(vectors.take(pa.array(at))) @ planes.T >= 0).reshape(len(at), tables, bits)
                codes[at] = signs @ (1 << np.arange(bits, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * tables, pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copies"), vectors, lists], names=["id", "copies", "embedding", "codes"])

    return code


def _compare(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        number = table.column("number")[0].as_py()
        left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        codes = np.array(table.column("codes").to_pylist())
        units, block = _units(table.column("embedding")), table.column("block").to_numpy()
        a_at, b_at = np.flatnonzero(block == left), np.flatnonzero(block == right)
        close = units[a_at] @ units[b_at].T >= cosine
        if left == right:
            close = np.triu(close, 1)
        a, b = np.nonzero(close)
        a, b = a_at[a], b_at[b]
        first = ~(codes[a, :number] == codes[b, :number]).any(1)
        links = np.bincount(a[first], copies[b[first]], len(ids)) + np.bincount(b[first], copies[a[first]], len(ids))
        root = local_roots(a, b, len(ids))
        at = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
        return pa.table({"id": pa.array(ids[at]), "links": pa.array(links[at].astype(np.int64)), "other": pa.array(ids[root[at]])})

    return run


def embedding_dups(rows: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector."""
    value = F.col("embedding").cast("array<double>")
    good = F.coalesce(F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0), F.lit(False))
    known = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good & F.col("vec_id").isNotNull(), value).alias("embedding"))
    known = known.withColumn("key", F.when(F.col("embedding").isNotNull(), F.sha2(F.array_join(F.transform("embedding", lambda x: (x + 0.0).cast("string")), ","), 256)))
    named = materialize(known, "vectors")
    same = materialize(named.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")), "distinct")
    bits, tables = plan_tables(same.count(), cosine, recall)
    coded = same.select("id", "copies", "embedding").mapInArrow(_coder(bits, tables), "id long, copies long, embedding array<double>, codes array<long>")
    coded = materialize(coded, "codes")
    entries = coded.select("id", F.size("embedding").alias("dim"), F.posexplode("codes").alias("number", "code"))
    crowded = entries.groupBy("number", "dim", "code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = entries.join(crowded, ["number", "dim", "code"]).withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("left"), F.greatest(F.col("block"), j).alias("right")))
    met = met.withColumn("pair", F.explode(pairs)).select("id", "number", "dim", "code", "block", "pair.left", "pair.right")
    full = met.join(coded, "id")
    found = full.groupBy("number", "dim", "code", "left", "right").applyInArrow(_compare(cosine), "id long, links long, other long")
    found = materialize(found, "found")
    degree = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    per_text = same.select("key", "id", "copies").join(degree, "id", "left").join(groups, "id", "left")
    per_text = per_text.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    joined = named.select("vec_id", "key").join(per_text, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
