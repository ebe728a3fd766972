"""The neighbourhood map against a dense version of the same descent, and its parts."""

import math

import numpy as np
import pytest

from tertulia.operators import embedding as E

N = 500


def vectors(n=N, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, 20)) * 2
    return centres[draw.integers(0, 12, n)] + draw.normal(size=(n, 20)) * 0.6


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")


def dense_distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


def dense_shares(x, perplexity):
    d = dense_distances(x)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1)[:, :-1]
    p = np.zeros_like(d)
    np.put_along_axis(p, order, E.bandwidths(np.take_along_axis(d, order, axis=1), perplexity), axis=1)
    return (p + p.T) / (2 * len(x))


def loss(p, xy):
    near = 1 / (1 + dense_distances(xy) ** 2)
    np.fill_diagonal(near, 0)
    at = p > 0
    return float((p[at] * np.log(p[at] / (near / near.sum())[at])).sum())


def trust(x, xy, k=12):
    rank = np.argsort(np.argsort(dense_distances(x), axis=1), axis=1)
    near = np.argsort(dense_distances(xy), axis=1)[:, 1 : k + 1]
    n = len(x)
    lost = np.maximum(np.take_along_axis(rank, near, axis=1) - k, 0).sum()
    return 1 - 2 * lost / (n * k * (2 * n - 3 * k - 1))


def principal(x):
    x = x - x.mean(axis=0)
    _, axes = np.linalg.eigh(x.T @ x)
    return x @ axes[:, -2:][:, ::-1]


def dense_map(x, p, epochs):
    xy = principal(x)
    xy *= E.START / xy[:, 0].std()
    n = len(x)
    state = {a: xy[:, k].copy() for k, a in enumerate("xy")}
    state |= {"vx": np.zeros(n), "vy": np.zeros(n), "gx": np.ones(n), "gy": np.ones(n)}
    for epoch in range(epochs):
        way = {a: state[a][:, None] - state[a][None] for a in "xy"}
        near = 1 / (1 + way["x"] ** 2 + way["y"] ** 2)
        np.fill_diagonal(near, 0)
        pull = [(p * near * way[a]).sum(axis=1) for a in "xy"]
        push = [(near * near * way[a]).sum(axis=1) / near.sum() for a in "xy"]
        state = E.moved(state, pull, push, *E.schedule(epoch, epochs, n))
    return np.stack([state["x"], state["y"]], axis=1)


@pytest.mark.parametrize("sample", [2048, 250])
def test_map_beside_a_dense_version(spark, monkeypatch, sample):
    """Loss at most 5 % (12 % with a sampled repulsion) above the dense version's, trustworthiness
    within 0.01, and both better than the principal components'."""
    monkeypatch.setattr(E, "SAMPLE", sample)
    x, epochs = vectors(), 40
    p = dense_shares(x, 30.0)
    rows = E.neighbourhood_map(frame(spark, x), "id", "vector", 30.0, epochs).collect()
    xy = np.array([r[1:] for r in sorted(rows)])
    wanted, flat = dense_map(x, p, epochs), principal(x)
    assert len(xy) == N and np.isfinite(xy).all()
    print(loss(p, xy), loss(p, wanted), loss(p, flat), trust(x, xy), trust(x, wanted), trust(x, flat))
    assert loss(p, xy) <= loss(p, wanted) * (1.05 if sample > N else 1.12)
    assert trust(x, xy) >= trust(x, wanted) - 0.01
    assert trust(x, xy) > trust(x, flat) + 0.01 and loss(p, xy) < loss(p, flat)


@pytest.mark.parametrize("block", [16, 4096])
def test_neighbours_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK_ROWS", block)
    x = np.round(vectors(90), 0)  # with ties
    x[7] = x[8] = x[9]
    found = {r["id"]: (r["others"], r["distances"]) for r in E.nearest_rows(frame(spark, x), 5, 90).collect()}
    d = dense_distances(x)
    np.fill_diagonal(d, np.inf)
    for i in range(90):
        wanted = np.lexsort((np.arange(90), np.round(d[i], 9)))[:5].tolist()
        assert np.allclose(sorted(found[i][1]), d[i][wanted], atol=1e-6)
        assert len(set(found[i][0])) == 5 and i not in found[i][0]


def test_affinities(spark):
    x = vectors(60)
    p = dense_shares(x, 8.0)
    near = E.nearest_rows(frame(spark, x), 59, 60)
    got = np.zeros((60, 60))
    for r in E.affinities(near, 8.0, 60).collect():
        got[r["i"], r["j"]] = r["p"]
    assert np.allclose(got, p, atol=1e-12) and math.isclose(got.sum(), 1)
    assert (got == got.T).all()


def test_bandwidths_reach_the_perplexity():
    d = np.sort(np.random.default_rng(1).random((40, 30)), axis=1)
    p = E.bandwidths(d, 9.0)
    assert np.allclose(np.exp(-(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)), 9.0)
    tied = E.bandwidths(np.array([[0.0, 0.0, 0.0, np.inf], [1.0, 2.0, 3.0, np.inf]]), 2.0)
    assert np.allclose(tied[0], [1 / 3, 1 / 3, 1 / 3, 0]) and np.allclose(tied.sum(axis=1), 1)


def test_forces_are_the_gradient(spark):
    """Attraction less repulsion, times four, is the derivative of the loss."""
    x, draw = vectors(40), np.random.default_rng(2)
    p, xy = dense_shares(x, 5.0), draw.normal(size=(40, 2))
    positions = spark.createDataFrame([(i, *v) for i, v in enumerate(xy.tolist())], "id long, x double, y double")
    edges = spark.createDataFrame(
        [(i, j, float(p[i, j])) for i in range(40) for j in range(40) if p[i, j] > 0], "i long, j long, p double"
    )
    pull = {r["id"]: (r["ax"], r["ay"]) for r in E.attraction(edges, positions).collect()}
    push = E.repulsion(xy[:, 0], xy[:, 1], np.arange(40), xy, np.arange(40), 40)
    for i in (0, 7, 39):
        for k in (0, 1):
            step = np.zeros_like(xy)
            step[i, k] = 1e-5
            numeric = (loss(p, xy + step) - loss(p, xy - step)) / 2e-5
            assert math.isclose(4 * (pull[i][k] - push[k][i]), numeric, rel_tol=1e-4, abs_tol=1e-7)
    near = 1 / (1 + dense_distances(xy) ** 2)
    from pyspark.sql import functions as F

    got = E.map_loss(edges, positions, F.lit(float(near.sum() - 40))).first()[0]
    assert math.isclose(got, loss(p, xy), rel_tol=1e-9)


def test_few_rows(spark):
    for n in (0, 1, 2, 3, 5):
        x = np.ones((n, 4)) if n < 5 else vectors(5)
        rows = E.neighbourhood_map(frame(spark, x) if n else frame(spark, vectors(1)).limit(0), "id", "vector", epochs=3).collect()
        assert sorted(r["id"] for r in rows) == list(range(n))
        assert all(math.isfinite(r["x"]) and math.isfinite(r["y"]) for r in rows)


def test_neighbours_are_known_where_they_are_found(spark, monkeypatch):
    """Each task returns k entries a row, not k a row and block; copies of a vector send no more
    than k + 1 of them around, and ties go to the smaller id."""
    monkeypatch.setattr(E, "BLOCK_ROWS", 32)
    x = np.round(vectors(300), 0)
    x[40:200] = x[40]  # more than half are one vector
    near = E.nearest_rows(frame(spark, x), 4, 300)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan
    found = {r["id"]: r["others"] for r in near.collect()}
    exact = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(exact, np.inf)
    for i in range(300):
        assert found[i] == np.lexsort((np.arange(300), exact[i]))[:4].tolist()


@pytest.mark.parametrize("scale", [1e-14, 1.0, 1e20])
def test_neighbours_at_any_scale(scale):
    x = vectors(400) * scale
    group = E._Nearest([(np.arange(50), x[:50], np.ones(50, bool))], 7)
    group.see(np.arange(50, 400), x[50:])
    d = dense_distances(x)
    np.fill_diagonal(d, np.inf)
    ids = np.concatenate([b.column(1).flatten().to_numpy() for b in group.rows()]).reshape(50, 7)
    assert (ids == np.argsort(d[:50], axis=1)[:, :7]).all()


def test_a_tile_meets_only_rows_it_can_be_near(monkeypatch):
    """In space with room between clusters, a row is compared with a small part of all others."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(40, 8))[draw.integers(0, 40, 6000)] * 20 + draw.normal(size=(6000, 8))
    cells = E._cell_of(E._borders(x, 6), x)
    parts = [np.flatnonzero(cells == c) for c in range(6)]
    assert min(map(len, parts)) > 300
    parts = [p[np.concatenate(E._leaves(x[p]))] for p in parts]
    pairs, add = [], E._Nearest._add
    monkeypatch.setattr(E._Nearest, "_add", lambda self, found, *a: pairs.append(sum(len(f[0]) for f in found)) or add(self, found, *a))
    group = E._Nearest([(parts[0], x[parts[0]], np.ones(len(parts[0]), bool))], 7)
    own = len(pairs)
    for part in parts[1:]:
        group.see(part, x[part])
    d = ((x[parts[0]][:, None] - x[None]) ** 2).sum(axis=2)
    d[np.arange(len(parts[0])), parts[0]] = np.inf
    assert (group.others == np.argsort(d, axis=1)[:, :7]).all()
    assert sum(pairs[own:]) < 0.01 * len(parts[0]) * len(x)


@pytest.mark.parametrize("block", [65_536, 64])
def test_an_epoch_in_cells_is_that_of_joins(spark, monkeypatch, block):
    """Edges that stay in their cells, with positions sent to them, give the joins' map; the
    joins' epochs, which shuffle all edges, are only for ids that rows share."""
    monkeypatch.setattr(E, "BLOCK_ROWS", block)
    x = np.round(vectors(400, seed=8), 1)
    x[50:170] = x[50]  # copies that are not among the nearest of others
    x[399] = np.nan
    df = frame(spark, x).where("id < 399")
    with monkeypatch.context() as m:
        m.setattr(E, "_map_in_cells", None)
        shared = df.union(df.where("id = 7"))
        assert len(E.neighbourhood_map(shared, "id", "vector", 10.0, 1).collect()) == 400
    with monkeypatch.context() as m:
        m.setattr(E, "_epoch", None)
        found = E.neighbourhood_map(df, "id", "vector", 10.0, 7)
    edges = E.affinities(E.nearest_rows(df, 30, 399), 10.0, 399)
    first = E._first_positions(E.project_2d(df, "vector").select("id", "x", "y"))
    state = first.selectExpr("*", "0D vx", "0D vy", "1D gx", "1D gy")
    for epoch in range(7):
        state = E.materialise(E._epoch(state, edges, epoch, 399, *E.schedule(epoch, 7, 399)), "by-joins")
    got, wanted = (np.array(sorted(f.select("id", "x", "y").collect())) for f in (found, state))
    assert np.allclose(got, wanted, rtol=1e-6, atol=1e-9)


def test_samples_are_those_that_spark_draws(spark, monkeypatch):
    monkeypatch.setattr(E, "SAMPLE", 20)
    ids = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 500)
    df = spark.createDataFrame([(int(i),) for i in ids], "id long")
    for epoch in (0, 3):
        wanted = [r["id"] for r in df.selectExpr("id", f"xxhash64(id, {epoch}) d").orderBy("d", "id").limit(20).collect()]
        parts = [(c, ("state", {"id": ids[c::3], "x": ids[c::3] * 1.0, "y": ids[c::3] * 2.0})) for c in range(3)]
        found, places = E._drawn(spark.sparkContext.parallelize(parts, 3), epoch, 500)
        assert found.tolist() == wanted and (places == np.stack([found * 1.0, found * 2.0], axis=1)).all()


def test_repulsion_of_brute_force():
    draw = np.random.default_rng(4)
    xy, ids = draw.normal(size=(70, 2)) * 30 + 500, np.arange(70)
    some = draw.permutation(70)[:25]
    fx, fy = E.repulsion(xy[:, 0], xy[:, 1], ids, xy[some], some, 70)
    near = 1 / (1 + dense_distances(xy[some]) ** 2)
    total = (near.sum() - 25) * 70 * 69 / (25 * 24)
    for i in range(70):
        other = some[some != i]
        way = xy[i] - xy[other]
        wanted = (way / (1 + (way**2).sum(axis=1))[:, None] ** 2).sum(axis=0) * 69 / len(other) / total
        assert np.allclose((fx[i], fy[i]), wanted, rtol=1e-8, atol=1e-15)
