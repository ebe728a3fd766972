"""Heads of any depth: gradients, loss, training and edge rows."""

import math

import numpy as np
import pytest
from pyspark.errors import PythonException, SparkRuntimeException

from tertulia.operators import heads as H


def data(n=300, width=6, seed=1):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, width))
    y = np.where(x[:, 0] * x[:, 1] > 0.3, 2, np.where(x[:, 2] > 0, 1, 0))
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame(
        [(i, v, int(c)) for i, (v, c) in enumerate(zip(x.tolist(), y.tolist(), strict=True))],
        "doc_id long, x array<double>, label int",
    ).repartition(3)


@pytest.mark.parametrize("activation", sorted(H.ACTIVATIONS))
@pytest.mark.parametrize("bias", [True, False])
def test_gradients_are_the_numeric_ones(activation, bias):
    shape = H.HeadShape(6, 4, 5, bias=bias, activation=activation, smoothing=0.2, class_weights=(1.6, 1.0, 1.6))
    x, y = data(40)
    flat = shape.drawn(3) * 2
    _, _, gradient = H.summed_loss(shape, flat, x, y)
    assert gradient.shape == flat.shape
    for i in range(0, len(flat), 7):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        numeric = (H.summed_loss(shape, flat + step, x, y)[0] - H.summed_loss(shape, flat - step, x, y)[0]) / 2e-6
        assert math.isclose(gradient[i], numeric, rel_tol=2e-4, abs_tol=2e-5)


@pytest.mark.parametrize("layers", [1, 2, 5])
def test_loss_of_brute_force(spark, layers):
    """Sums over tasks equal a row-at-a-time cross entropy."""
    shape = H.HeadShape(6, layers, 4, activation="Mish", smoothing=0.1, class_weights=(1.6, 1.0, 1.6))
    x, y = data(90)
    flat = shape.drawn(5)
    rows = frame(spark, x, y).selectExpr("x", "cast(label as long) y")
    loss, weight, gradient = H.batch_gradient(rows, shape, flat)
    wanted = 0.0
    for v, c in zip(x, y, strict=True):
        h = v
        for k, (w, b) in enumerate(shape.split(flat)):
            h = [sum(h[i] * w[i, j] for i in range(len(h))) + b[j] for j in range(w.shape[1])]
            if k < layers - 1:
                h = [z * math.tanh(math.log1p(math.exp(z))) for z in h]
        total = math.log(sum(map(math.exp, h)))
        for j in range(3):
            share = 0.1 / 3 + (0.9 if j == c else 0)
            wanted += share * shape.class_weights[j] * (total - h[j])
    assert math.isclose(loss, wanted, rel_tol=1e-9)
    assert math.isclose(weight, sum(shape.class_weights[c] for c in y))
    assert np.allclose(gradient, H.summed_loss(shape, flat, x, y)[2])


def test_sums_go_through_a_tree(spark, monkeypatch):
    monkeypatch.setattr(H, "AT_ONCE", 2)
    shape = H.HeadShape(6, 2, 4)
    x, y = data(90)
    flat = shape.drawn(5)
    rows = frame(spark, x, y).selectExpr("x", "cast(label as long) y").repartition(9)
    loss, weight, gradient = H.batch_gradient(rows, shape, flat)
    whole = H.summed_loss(shape, flat, x, y)
    assert math.isclose(loss, whole[0]) and weight == whole[1] and np.allclose(gradient, whole[2])


def test_five_layers_with_weights_train(spark):
    x, y = data(600)
    df = frame(spark, x, y)
    shape = H.HeadShape(6, 5, 24, activation="SiLU", smoothing=0.1, class_weights=(1.6, 1.0, 1.6))
    seen = []
    head = H.NetworkHead(shape, epochs=16, batch=100, rate=0.01, watch=lambda e, m: seen.append(e))
    model = head.fit(df)
    assert seen == list(range(16)) and model.losses[-1] < 0.75 * model.losses[0]
    accuracy = H.predicted_accuracy(model, df)
    linear = H.NetworkHead(H.HeadShape(6), epochs=16, batch=100, rate=0.05).fit(df)
    assert accuracy > 0.85 and accuracy > H.predicted_accuracy(linear, df)
    again = head.fit(df.repartition(7))
    assert np.allclose(again.flat, model.flat, atol=1e-6)


def test_edges(spark):
    x, y = data(10)
    df = frame(spark, x, y)
    shape = H.HeadShape(6, 2, 3)
    nothing = H.NetworkHead(shape, epochs=2).fit(df.limit(0))
    assert np.array_equal(nothing.flat, shape.drawn(42)) and math.isnan(nothing.losses[0])
    more = df.union(spark.createDataFrame([(99, None, 1)], df.schema))
    found = H.NetworkHead(shape, epochs=1, batch=1000).fit(more).transform(more)
    by = {r["doc_id"]: r for r in found.collect()}
    assert by[99]["prediction"] is None and by[99]["probability"] is None
    assert math.isclose(sum(by[0]["probability"]), 1) and by[0]["prediction"] in (0.0, 1.0, 2.0)
    assert H.predicted_accuracy(nothing, df.limit(0)) is None
    with pytest.raises((PythonException, SparkRuntimeException, Exception), match="no class"):
        H.NetworkHead(shape, epochs=1).fit(df.selectExpr("doc_id", "x", "7 label"))
    for bad in ({"layers": 0}, {"activation": "Sine"}):
        with pytest.raises(ValueError):
            H.HeadShape(6, **bad)


def test_small_batches_keep_the_model_off_the_driver(spark, monkeypatch):
    """The steps of a driver that sums gradients, over several tasks, with no gradient or
    parameter collected and no model broadcast."""
    x, y = data(300)
    df = frame(spark, x, y)
    shape = H.HeadShape(6, 3, 30, activation="Mish", smoothing=0.1, class_weights=(1.6, 1.0, 1.6))
    wanted = H.NetworkHead(shape, epochs=3, batch=40)
    with monkeypatch.context() as m:
        m.setattr(H, "CHUNK_ROWS", 1)  # no batch is small
        summed = wanted.fit(df)
    monkeypatch.setattr(H, "CHUNK_ROWS", 100)  # two batches a task
    monkeypatch.setattr(H, "BLOCK", 64)
    monkeypatch.setattr(H, "batch_gradient", None)
    model = wanted.fit(df)
    assert np.allclose(model.losses, summed.losses)
    known = df.union(spark.createDataFrame([(98, None, 1), (99, [0.0] * 6, None)], df.schema))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", None)
    found = H.predicted_accuracy(model, known)
    monkeypatch.undo()
    assert np.allclose(model.flat, summed.flat, atol=1e-9)
    assert math.isclose(found, H.predicted_accuracy(summed, known))


@pytest.mark.parametrize("rows", [100, 4096])
def test_an_epoch_of_small_batches_takes_few_tasks(spark, monkeypatch, rows):
    """Their number follows from what a task can hold, not from a fixed number of rows; the rows
    are stored without a folder for each batch, and dealt anew for each epoch."""
    x, y = data(600 if rows == 100 else 9000)
    df = frame(spark, x, y)
    wanted = H.NetworkHead(H.HeadShape(6, 3, 9, activation="GELU"), epochs=2, batch=32)
    stored, folders = [], []
    keep, write = H._stored_state, type(df.write).partitionBy
    monkeypatch.setattr(H, "_stored_state", lambda state, name: stored.append(name) or keep(state, name))
    monkeypatch.setattr(type(df.write), "partitionBy", lambda self, *c: folders.extend(c) or write(self, *c))
    model = wanted.fit(df)
    assert len(stored) == 1 + 2 and not folders
    monkeypatch.setattr(H, "CHUNK_BYTES", 1)
    monkeypatch.setattr(H, "CHUNK_ROWS", rows)
    several = wanted.fit(df)
    assert len(stored) == 3 + 1 + 2 * -(-(-(-len(x) // 32)) // (rows // 32)) and folders == ["task"] * 2
    assert np.allclose(model.flat, several.flat, atol=1e-12) and np.allclose(model.losses, several.losses)


def test_error_function():
    x = np.concatenate([np.linspace(-7, 7, 4001), [0.46875, 4.0, 1e-300, 60.0, math.inf, -math.inf]])
    assert np.allclose(H._erf(x.reshape(1, -1))[0], [math.erf(v) for v in x], rtol=1e-15, atol=0)
    assert math.isnan(H._erf(np.array([math.nan]))[0])
