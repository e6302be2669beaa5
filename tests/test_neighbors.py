"""The two-level neighbour tree: exact at every shape, leaves and copies of queries stay level as the points grow."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.operators import neighbors


def frame(spark, points: np.ndarray, name: str):
    rows = [(int(i), [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, f"{name} long, vec array<double>").repartition(4)


def brute(queries: np.ndarray, refs: np.ndarray, others_only: bool = False) -> dict[int, tuple[float, int]]:
    out = {}
    for i, q in enumerate(queries):
        d2 = ((refs - q) ** 2).sum(axis=1)
        if others_only:
            d2[i] = np.inf
        j = int(np.flatnonzero(d2 == d2.min())[0])
        out[i] = (float(np.sqrt(d2[j])), j)
    return out


@pytest.fixture
def small_tree(monkeypatch):
    for name, value in {"LEAF_POINTS": 16, "ALONE_POINTS": 16, "CELL_LEAVES": 4, "CHUNK_QUERIES": 32, "ROUTED_ROWS": 50, "FIRST_LEAVES": 2, "WIDEN": 8, "BROADCAST_ROWS": 5}.items():
        monkeypatch.setattr(neighbors, name, value)


def shapes():
    rng = np.random.default_rng(4)
    yield "even", rng.normal(size=(500, 3)), rng.normal(size=(150, 3))
    yield "clusters", np.concatenate([rng.normal(c, 0.01, size=(150, 2)) for c in (0, 5, 500)]), rng.uniform(-10, 510, size=(100, 2))
    yield "line and copies", np.concatenate([np.stack([np.arange(400.0), np.zeros(400)], 1), np.zeros((300, 2))]), np.concatenate([np.zeros((100, 2)), rng.uniform(-50, 450, size=(100, 2))])


@pytest.mark.parametrize(("name", "refs", "queries"), list(shapes()), ids=lambda x: x if isinstance(x, str) else "")
def test_two_levels_are_exact(spark, small_tree, name, refs, queries):
    got = {r.qid: (r.distance, r.rid) for r in neighbors.nearest(frame(spark, queries, "qid"), frame(spark, refs, "rid")).collect()}
    want = brute(queries, refs)
    assert got.keys() == want.keys()
    assert all(got[i][1] == want[i][1] and np.isclose(got[i][0], want[i][0]) for i in want)


def test_a_table_against_itself(spark, small_tree):
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.normal(size=(500, 2)), np.repeat(rng.normal(size=(3, 2)), 20, axis=0)])
    got = {r.qid: r.distance for r in neighbors.nearest(frame(spark, points, "qid"), frame(spark, points, "rid"), others_only=True).collect()}
    assert all(np.isclose(got[i], d) for i, (d, _) in brute(points, points, others_only=True).items())


def test_nothing_to_ask(spark, small_tree):
    rng = np.random.default_rng(7)
    refs = frame(spark, rng.normal(size=(300, 2)), "rid")
    assert neighbors.nearest(spark.createDataFrame([], "qid long, vec array<double>"), refs).count() == 0


def test_leaves_and_copies_stay_level(spark, small_tree, monkeypatch):
    asked = []
    search = neighbors._search

    def counted(asking, refs, others_only, types, few=None, chunk=None):
        sizes = [r["count"] for r in refs.groupBy("leaf").count().collect()]
        asked.append((asking.count(), max(sizes), float(np.mean(sizes))))
        return search(asking, refs, others_only, types, few)

    monkeypatch.setattr(neighbors, "_search", counted)
    rng = np.random.default_rng(8)
    seen = {}
    for n in (300, 4_800):
        asked.clear()
        neighbors.nearest(frame(spark, rng.uniform(size=(200, 2)), "qid"), frame(spark, rng.uniform(size=(n, 2)), "rid")).count()
        seen[n] = (sum(a for a, _, _ in asked) / 200, max(m for _, m, _ in asked), asked[0][2])
    small, large = seen[300], seen[4_800]
    assert large[1] <= 4 * neighbors.LEAF_POINTS and 0.5 <= large[2] / small[2] <= 2
    assert large[0] <= 1.5 * small[0]  # copies of a query, while the points grow sixteenfold


def test_cells_are_bounded_and_split_in_the_cluster(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "LEAF_POINTS", 8)
    monkeypatch.setattr(neighbors, "TOP_CELLS", 4)
    rng = np.random.default_rng(9)
    points = frame(spark, rng.uniform(size=(2_000, 2)), "rid")
    tree = neighbors.plant(points, 2_000)
    assert int((tree.top.leaf >= 0).sum()) <= 7 and tree.below.count() <= 7
    homes = tree.visits(points.select(F.col("rid").alias("id"), "vec"), "id bigint, vec array<double>", nearby=False)
    sizes = [r["count"] for r in homes.groupBy("leaf").count().collect()]
    assert sum(sizes) == 2_000 and max(sizes) <= 4 * 8


def test_a_query_takes_only_the_leaves_of_its_round(spark, small_tree):
    rng = np.random.default_rng(11)
    tree = neighbors.plant(frame(spark, rng.uniform(size=(600, 2)), "rid"), 600)
    state = "id bigint, vec array<double>, home bigint, d2 double, far double, last bigint"
    asked = spark.createDataFrame([(i, [float(x) for x in p], -1, 9.0, -1.0, -1) for i, p in enumerate(rng.uniform(size=(20, 2)))], state)
    found = lambda take: tree.visits(asked, state, True, take).withColumn("cell", F.shiftright("leaf", 32)).toPandas()
    every, few = found(1_000), found(2)
    assert len(every) == every["many"].sum() == few["many"].sum() and len(every) > 20 * 8
    assert (few.groupby(["id", "cell"]).size() <= 2).all()
    nearest_two = every.sort_values(["gap", "leaf"]).groupby(["id", "cell"]).head(2)
    rows = lambda df: sorted(zip(df["id"], df["leaf"], df["gap"]))
    assert rows(nearest_two) == rows(few)
