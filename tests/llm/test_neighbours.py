import numpy as np
import pytest
from pyspark.sql import functions as F

from tertulia.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, score string, id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


def brute(rows, k):
    out = {}
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    for q in sorted({int(i) for i in ids if i % 100 == 0}):
        d = np.sqrt(((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        out[q] = [(int(ids[j]), d[j]) for j in order if ids[j] != q][:k]
    return out


def wanted():
    return F.col("vec_id") % 100 == 0


@pytest.mark.parametrize("block", [64, 8192])
def test_recall(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "BATCH", 3)
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=24).tolist()) for i in range(900)]
    rows += [(2000 + i, (np.ones(24) + 1e-3 * draw.normal(size=24)).tolist()) for i in range(300)]
    found = {}
    for r in N.nearest(frame(spark, rows), wanted()).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    exact = brute(rows, 10)
    assert set(found) == set(exact)
    hits = 0
    for q, near in found.items():
        near.sort()
        assert [r for r, *_ in near] == list(range(1, 11))
        assert [s for *_, s in near] == sorted(s for *_, s in near)
        hits += len({v for _, v, _ in near} & {v for v, _ in exact[q]})
    assert hits / (10 * len(exact)) >= 0.95


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, -0.5]), (3, [1.0, 0.5]), (4, None), (5, [0.0, 0.0])]
    rows += [(6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 2.0, 3.0]), (100, None), (200, [0.0, 0.0]), (None, [1.0, 1.0])]
    rows += [(1, [1.0, 0.5])]
    found = N.nearest(frame(spark, rows), wanted(), k=10).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [
        (0, 1, 1, 0.5), (0, 2, 1, 0.5), (0, 3, 2, 0.5), (0, 4, 3, 0.5)
    ]


def test_empty(spark):
    assert N.nearest(frame(spark, []), wanted()).count() == 0
    assert N.nearest(frame(spark, [(1, [1.0, 2.0])]), wanted()).count() == 0
    assert N.nearest(frame(spark, [(100, [1.0, 2.0])]), wanted()).count() == 0


def test_a_tree_gives_points_in_order():
    points = np.random.default_rng(1).normal(size=(700, 6))
    tree = N.Tree(points)
    tree.finish()
    query = np.ones(6)
    at, near = (np.concatenate(x) for x in zip(*tree.increasing(query), strict=True))
    assert sorted(at.tolist()) == list(range(700)) and np.all(np.diff(near) >= 0)
    assert np.allclose(near, ((points[at] - query) ** 2).sum(axis=1))


def test_one_query_and_many_exact_copies(spark):
    v = np.random.default_rng(4).normal(size=64).tolist()
    rows = [(100, v)] + [(i, v) for i in range(1, 13)]
    found = N.nearest(frame(spark, rows), wanted()).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(i, 0.0) for i in range(1, 11)]
