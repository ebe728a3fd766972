"""Binned densities against the direct sum over all rows."""

import numpy as np
import pytest

from tertulia.operators.charts import density, density_binned


def direct(values, points):
    x = np.linspace(values.min(), values.max(), points)
    h = values.std(ddof=1) * len(values) ** -0.2
    u = (x[:, None] - values[None, :]) / h
    return x, np.exp(-0.5 * u * u).sum(axis=1) / (len(values) * h * np.sqrt(2 * np.pi)), h


@pytest.mark.parametrize("steps", [4, 32])
def test_within_the_bound_of_the_direct_sum(spark, steps):
    draw = np.random.default_rng(3)
    groups = {
        "a": draw.normal(0.3, 0.05, 1500),
        "b": np.concatenate([draw.random(300), [40.0]]),  # one value far from the others
        None: draw.exponential(1, 200),
        "two": np.array([1.0, 2.0]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    rows += [("a", None), ("a", float("nan")), ("one", 5.0), ("same", 1.0), ("same", 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = density_binned(df, "g", "v", 50, steps).collect()
    assert {r["g"] for r in found} == set(groups)
    for g, values in groups.items():
        mine = sorted((r for r in found if r["g"] == g), key=lambda r: r["point"])
        x, exact, h = direct(values, 50)
        assert [r["point"] for r in mine] == list(range(50))
        np.testing.assert_allclose([r["x"] for r in mine], x, atol=1e-9)
        error = 1 / (8 * steps**2 * h * np.sqrt(2 * np.pi))
        np.testing.assert_allclose([r["error"] for r in mine], error, rtol=1e-9)
        off = np.abs(np.array([r["density"] for r in mine]) - exact)
        assert off.max() <= error * (1 + 1e-6)


def test_the_same_as_the_plain_density_and_empty(spark):
    df = spark.range(300).selectExpr("id % 2 AS g", "sqrt(id) AS v")
    near = {(r["g"], r["point"]): r for r in density_binned(df, "g", "v", 20).collect()}
    for r in density(df, "g", "v", 20).collect():
        mine = near.pop((r["g"], r["point"]))
        assert abs(mine["density"] - r["density"]) <= mine["error"] * (1 + 1e-6)
    assert not near and density_binned(df.limit(0), "g", "v").count() == 0
