"""Exact nearest-neighbour join over numeric vectors, without a cross join.

The reference points lie in a tree of two levels. The upper one is cut on the
driver from a bounded sample into at most ``TOP_CELLS`` cells; inside the cluster
every cell then cuts itself, from a sample of its own points, into leaves of about
``LEAF_POINTS``. Leaves keep that size however many points there are, and only one
row per cell (its subtree) is ever sent to those who look for a leaf.

A query first searches the leaf it falls into. What it finds there bounds how far
anything closer can be; the leaves within that bound are visited nearest first, a few
per round and ``WIDEN`` times as many in the next one, and each round tightens the
bound, so a query is copied about as often as it has leaves that really matter. The
answer is exact: a query is done only when no unvisited leaf reaches into its bound.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import lookup

SAMPLE_POINTS = 200_000  # on the driver, for the upper cells; as many per cell, inside the cluster
LEAF_POINTS = 4_096
ALONE_POINTS = 8_192  # up to here one leaf of all points is cheaper than rounds of jobs
TOP_CELLS = 4_096
CELL_LEAVES = 64  # leaves of a cell, unless there are more than TOP_CELLS cells of that size
CHUNK_QUERIES = 4_096
ROUTED_ROWS = 50_000  # rows that look for their leaf in one task
FIRST_LEAVES = 4
WIDEN = 4
BROADCAST_ROWS = 10_000  # of (leaf, number): 16 bytes each
_HASH_SPACE = 1 << 30
_BLOCK = 512
_BLOCK_CELLS = 1 << 16  # distances at once: buffers of this size stay in the processor's cache
_SHIFT = 32  # a leaf's number: that of its cell, then its own


@dataclass(frozen=True)
class Leaves:
    """A k-d split: inner nodes hold (dim, threshold, children), leaves a box."""

    dim: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def own(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.leaf[node] < 0)
            if not len(inner):
                return self.leaf[node]
            at = node[inner]
            goes_left = points[inner, self.dim[at]] <= self.threshold[at]
            node[inner] = np.where(goes_left, self.left[at], self.right[at])

    def within(self, points: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point row, leaf, squared gap) of the leaves whose box may hold a point within ``bound`` (squared)."""
        rows, nodes = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(rows):
            below = np.maximum(self.low[nodes] - points[rows], 0.0)
            above = np.maximum(points[rows] - self.high[nodes], 0.0)
            gap = (np.maximum(below, above) ** 2).sum(axis=1)
            near = gap <= bound[rows]
            rows, nodes, gap = rows[near], nodes[near], gap[near]
            done = self.leaf[nodes] >= 0
            hits.append((rows[done], self.leaf[nodes[done]], gap[done]))
            rows, nodes = rows[~done], nodes[~done]
            nodes = np.concatenate([self.left[nodes], self.right[nodes]])
            rows = np.concatenate([rows, rows])
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*hits))


def split_points(sample: np.ndarray, leaves: int) -> Leaves:
    """Halve the sample along its widest dimension until there are about ``leaves`` parts."""
    width = sample.shape[1]
    nodes = [(sample, np.full(width, -np.inf), np.full(width, np.inf))]
    dim, threshold, left, right = [0], [0.0], [-1], [-1]
    smallest = max(2, len(sample) // max(1, leaves))
    i = 0
    while i < len(nodes):
        points, low, high = nodes[i]
        nodes[i] = (points[:0], low, high)  # only the box is needed from here on
        if len(points) >= 2 * smallest:
            axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
            column = points[:, axis]
            cut = float(np.median(column))
            if cut >= column.max():
                cut = float(column[column < column.max()].max()) if (column < column.max()).any() else cut
            side = column <= cut
            if side.any() and not side.all():
                dim[i], threshold[i], left[i], right[i] = axis, cut, len(nodes), len(nodes) + 1
                low_right, high_left = low.copy(), high.copy()
                low_right[axis], high_left[axis] = cut, cut
                nodes += [(points[side], low, high_left), (points[~side], low_right, high)]
                dim += [0, 0]
                threshold += [0.0, 0.0]
                left += [-1, -1]
                right += [-1, -1]
        i += 1
    is_leaf = np.array(left) < 0
    number = np.where(is_leaf, np.cumsum(is_leaf) - 1, -1)
    return Leaves(
        np.array(dim), np.array(threshold), np.array(left), np.array(right), number,
        np.array([n[1] for n in nodes]), np.array([n[2] for n in nodes]),
    )


def _matrix(series: pd.Series) -> np.ndarray:
    return np.array(series.tolist(), dtype=float)


def _sorted(points: np.ndarray) -> np.ndarray:
    return points[np.lexsort(points.T)]


@dataclass(frozen=True)
class Tree:
    """The two levels: ``top`` travels with the code; ``below(cell, tree)`` is a table of one row per cell.

    With a single cell there is no table, and its leaves are those of ``only``.
    """

    top: Leaves
    only: Leaves | None
    below: DataFrame | None

    def visits(self, rows: DataFrame, types: str, nearby: bool, take: int = 0) -> DataFrame:
        """The own leaf of each ``rows(id, vec, ...)``, or (``nearby``) its next leaves within ``d2``.

        Those are the first ``take`` in order of (gap, number) after its ``far`` and ``last``, but for its ``home``. A query gets them
        from each cell it meets; the first row of a cell says in ``many`` how many there are. ``types``: the columns of ``rows``.
        Rows meet the subtree of a cell in tasks of about ``ROUTED_ROWS``.
        """
        names = rows.columns
        fields = f"{types}, leaf bigint, gap double, many bigint"

        def found(pdf: pd.DataFrame, tree: Leaves, cell: int) -> pd.DataFrame:
            vec = _matrix(pdf["vec"]) if len(pdf) else np.zeros((0, tree.low.shape[1]))
            if nearby:
                # a hair wider than the bound, so rounding cannot hide an equal point
                at, leaf, gap = tree.within(vec, pdf["d2"].to_numpy() * (1 + 1e-12))
            else:
                at, leaf, gap = np.arange(len(vec)), tree.own(vec), np.zeros(len(vec))
            leaf, many = (np.int64(cell) << _SHIFT) + leaf.astype("int64"), np.ones(len(at), dtype=np.int64)
            if nearby:
                home, far, last = (pdf[c].to_numpy()[at] for c in ("home", "far", "last"))
                # what a query has seen is what comes before its last leaf
                ahead = np.flatnonzero((leaf != home) & ((gap > far) | ((gap == far) & (leaf > last))))
                ahead = ahead[np.lexsort((leaf[ahead], gap[ahead], at[ahead]))]
                at, leaf, gap = at[ahead], leaf[ahead], gap[ahead]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                many = np.where(place == 0, np.bincount(at, minlength=len(vec))[at], 0)
                first = place < take
                at, leaf, gap, many = at[first], leaf[first], gap[first], many[first]
            return pdf[names].take(at).assign(leaf=leaf, gap=gap, many=many)

        if self.only is not None:
            only = self.only
            return rows.mapInPandas(lambda batches: (found(b, only, 0) for b in batches if len(b)), fields)
        top = self.top

        def cells(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                vec = _matrix(pdf["vec"])
                at, cell, _ = top.within(vec, pdf["d2"].to_numpy() * (1 + 1e-12)) if nearby else (np.arange(len(vec)), top.own(vec), None)
                yield pdf[names].take(at).assign(cell=cell.astype("int32"))

        asked = materialize(rows.mapInPandas(cells, f"{types}, cell int"), "asked")
        # one row per cell: TOP_CELLS at most
        parts = {r["cell"]: -(-r["n"] // ROUTED_ROWS) for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not parts:
            return rows.sparkSession.createDataFrame([], asked.drop("cell").schema.add("leaf", "long").add("gap", "double").add("many", "long"))
        counts = F.broadcast(rows.sparkSession.createDataFrame(list(parts.items()), "cell int, parts int"))
        left = asked.join(counts, "cell").withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.col("parts")).cast("int"))
        right = self.below.join(counts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

        def meet(key: tuple, asking: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            return found(asking, pickle.loads(tree["tree"].iloc[0]), int(key[0]))

        return (
            left.select("cell", "part", *names).groupBy("cell", "part")
            .cogroup(right.select("cell", "part", "tree").groupBy("cell", "part"))
            .applyInPandas(meet, fields)
        )


def plant(points: DataFrame, n: int) -> Tree:
    """The tree over ``points(vec)``, ``n`` of them and all different."""
    size = max(1, -(-n // LEAF_POINTS))
    share = lambda rows: int(_HASH_SPACE * min(1.0, SAMPLE_POINTS / rows))
    draw = F.pmod(F.xxhash64("vec"), F.lit(_HASH_SPACE))
    # about SAMPLE_POINTS distinct vectors, whatever the table's size
    sample = _sorted(_matrix(points.filter(draw < F.lit(share(n))).select("vec").toPandas()["vec"]))
    count = min(TOP_CELLS, -(-size // CELL_LEAVES))
    if count == 1:
        only = split_points(sample, size)
        return Tree(only, only, None)
    top = split_points(sample, count)

    @F.pandas_udf("int")
    def cell_of(vec: pd.Series) -> pd.Series:
        return pd.Series(top.own(_matrix(vec)).astype("int32")) if len(vec) else pd.Series([], dtype="int32")

    placed = materialize(points.select("vec", cell_of("vec").alias("cell")), "cells")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # TOP_CELLS rows at most
    again = F.pmod(F.xxhash64("vec", F.lit(1)), F.lit(_HASH_SPACE))
    drawn = placed.join(F.broadcast(sizes), "cell").filter(again < F.lit(float(_HASH_SPACE)) * F.least(F.lit(1.0), F.lit(float(SAMPLE_POINTS)) / F.col("n")))

    def subtree(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = split_points(_sorted(_matrix(pdf["vec"])), max(1, -(-int(pdf["n"].iloc[0]) // LEAF_POINTS)))
        return pd.DataFrame({"cell": [key[0]], "tree": [pickle.dumps(tree)]})

    return Tree(top, None, materialize(drawn.groupBy("cell").applyInPandas(subtree, "cell int, tree binary"), "subtrees"))


def _closest(points: pd.DataFrame, refs: pd.DataFrame, others_only: bool) -> pd.DataFrame:
    q, r = _matrix(points["vec"]), _matrix(refs["vec"])
    rid, single = refs["rid"].to_numpy(), (refs["copies"].to_numpy() == 1)
    best, who = np.empty(len(q)), np.empty(len(q), dtype=rid.dtype)
    order = np.argsort(rid, kind="stable")
    r, rid, single = r[order], rid[order], single[order]
    step = max(1, min(_BLOCK, _BLOCK_CELLS // len(r)))
    sides = [np.ascontiguousarray(r[:, j]) for j in range(q.shape[1])]
    total, gaps = np.empty((step, len(r))), np.empty((step, len(r)))
    for start in range(0, len(q), step):
        block = q[start : start + step]
        d2, gap = total[: len(block)], gaps[: len(block)]
        d2.fill(0.0)
        for j, side in enumerate(sides):
            np.subtract(block[:, j : j + 1], side, out=gap)
            np.multiply(gap, gap, out=gap)
            d2 += gap
        if others_only:
            d2[(d2 == 0.0) & single[None, :]] = np.inf
        at = d2.argmin(axis=1)
        best[start : start + step] = d2[np.arange(len(block)), at]
        who[start : start + step] = rid[at]
    return pd.DataFrame({"id": points["id"].to_numpy(), "d2": best, "rid": who})


def _search(asking: DataFrame, refs: DataFrame, others_only: bool, types: tuple[str, str], leaves: int | None = None, chunk: int | None = None) -> DataFrame:
    """``(id, d2, rid)`` of ``asking(id, vec, leaf)`` against ``refs(rid, vec, copies, leaf)``, leaf by leaf.

    The queries of a leaf are dealt to as many tasks as they fill with ``chunk``; each gets the leaf's points.
    ``leaves``: how many leaves there are, where that is known to be few.
    """
    chunk = chunk or CHUNK_QUERIES
    sizes = asking.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    if leaves is not None and leaves <= BROADCAST_ROWS:
        spark, known = asking.sparkSession, [(r["leaf"], r["chunks"]) for r in sizes.collect()]
        sizes = F.broadcast(spark.createDataFrame(known, "leaf bigint, chunks int"))
        left, right = asking.join(sizes, "leaf"), refs.join(sizes, "leaf")
    else:
        sizes = materialize(sizes, "leafsizes")
        facts = sizes.agg(F.count(F.lit(1)).alias("leaves"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
        left = lookup(asking, "leaf", sizes, "chunks", "n", facts["rows"], BROADCAST_ROWS, facts["leaves"])
        right = refs.join(F.broadcast(sizes) if facts["leaves"] <= BROADCAST_ROWS else sizes, "leaf")
    left = left.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"id": q["id"][:0], "d2": np.empty(0), "rid": r["rid"][:0]})
        return _closest(q, r, others_only)

    return (
        left.select("leaf", "chunk", "id", "vec").groupBy("leaf", "chunk")
        .cogroup(right.select("leaf", "chunk", "rid", "vec", "copies").groupBy("leaf", "chunk"))
        .applyInPandas(best, f"id {types[0]}, d2 double, rid {types[1]}")
    )


def nearest(queries: DataFrame, refs: DataFrame, others_only: bool = False) -> DataFrame:
    """For each ``queries(qid, vec)`` the nearest ``refs(rid, vec)``: ``(qid, distance, rid)``.

    Ties go to the smallest ``rid``. ``others_only`` is for a table searched
    against itself: a point is not its own neighbour, but an equal copy is.
    """
    types = (queries.schema["qid"].dataType.simpleString(), refs.schema["rid"].dataType.simpleString())
    # equal points are one point: a vector held by a third of the rows costs one row here
    points = refs.groupBy("vec").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("copies"))
    points = materialize(points, "points")
    n = points.count()
    asking = queries.select(F.col("qid").alias("id"), "vec")
    named = lambda found: found.select(F.col("id").alias("qid"), F.sqrt("d2").alias("distance"), "rid")
    if n <= ALONE_POINTS:
        # everything fits in one leaf: one round answers it
        zero = F.lit(0).cast("bigint")
        return named(_search(asking.withColumn("leaf", zero), points.withColumn("leaf", zero), others_only, types, 1, CHUNK_QUERIES // 4))
    tree = plant(points, n)
    few = int((tree.only.leaf >= 0).sum()) if tree.only is not None else None
    id_type = types[0]
    homes = tree.visits(points.select(F.col("rid").alias("id"), "vec", "copies"), f"id {types[1]}, vec array<double>, copies bigint", nearby=False)
    leaves = materialize(homes.select(F.col("id").alias("rid"), "vec", "copies", "leaf"), "leaves")
    active = materialize(tree.visits(asking, f"id {id_type}, vec array<double>", nearby=False).withColumnRenamed("leaf", "home").drop("gap", "many"), "homes")
    found = materialize(_search(active.withColumnRenamed("home", "leaf"), leaves, others_only, types, few), "found")
    everything = found
    # an empty leaf, or one that holds only the query itself, bounds nothing
    bounded = active.join(found.select("id", "d2"), "id", "left").withColumn("d2", F.coalesce("d2", F.lit(float("inf"))))
    active = bounded.select("id", "vec", "home", "d2", F.lit(-1.0).alias("far"), F.lit(-1).cast("bigint").alias("last"))
    state, take = f"id {id_type}, vec array<double>, home bigint, d2 double, far double, last bigint", FIRST_LEAVES
    while True:
        ahead, by_query = tree.visits(active, state, True, take), Window.partitionBy("id")
        ahead = ahead.withColumn("_k", F.row_number().over(by_query.orderBy("gap", "leaf"))).withColumn("_of", F.sum("many").over(by_query)).drop("many")
        ahead = materialize(ahead.filter(F.col("_k") <= take), "ahead")
        most = ahead.agg(F.max("_of").alias("most")).first()["most"]
        if most is None:
            break
        found = _search(ahead.select("id", "vec", "leaf"), leaves, others_only, types, few)
        if most <= take:  # nobody has leaves left
            everything = everything.unionByName(found)
            break
        found = materialize(found.groupBy("id").agg(F.min(F.struct("d2", "rid")).alias("_b")).select("id", "_b.d2", "_b.rid"), "found")
        everything = everything.unionByName(found)
        more = ahead.filter((F.col("_k") == take) & (F.col("_of") > take))
        more = more.join(found.select(F.col("id").alias("_id"), F.col("d2").alias("_d2")), F.col("id") == F.col("_id"), "left")
        active = more.select("id", "vec", "home", F.least("d2", F.coalesce("_d2", "d2")).alias("d2"), F.col("gap").alias("far"), F.col("leaf").alias("last"))
        take *= WIDEN
    best = everything.groupBy("id").agg(F.min(F.struct("d2", "rid")).alias("b"))
    return named(best.select("id", F.col("b.d2").alias("d2"), F.col("b.rid").alias("rid")))
