"""The model-based search on functions whose best point is known."""

import math

import numpy as np
import pytest

from tertulia.operators.search import Choice, Real, best_trial, search

SPACE = {
    "rate": Real(1e-6, 1e-1, log=True),
    "hidden": Real(10, 3000, log=True, whole=True),
    "layers": Real(1, 5, whole=True),
    "smooth": Real(0.0, 0.3, step=0.1),
    "kind": Choice(("a", "b", "c", "d")),
}


def known(p):
    return -(
        (math.log10(p["rate"]) + 3) ** 2 + (math.log10(p["hidden"] / 400)) ** 2 * 4 + 0.3 * (p["layers"] - 4) ** 2
        + 20 * (p["smooth"] - 0.2) ** 2 + {"a": 1.5, "b": 0.0, "c": 1.0, "d": 2.0}[p["kind"]]
    )


def test_better_than_random_over_twenty_seeds():
    ours = [best_trial(search(lambda p, _: known(p), SPACE, 60, seed=s)).value for s in range(20)]
    random = [best_trial(search(lambda p, _: known(p), SPACE, 60, seed=s, startup=60)).value for s in range(20)]
    assert np.mean(ours) > np.mean(random) and np.median(ours) > np.median(random)
    assert sum(a > b for a, b in zip(ours, random, strict=True)) >= 14


def test_values_stay_in_their_space():
    for t in search(lambda p, _: known(p), SPACE, 60, seed=3):
        p = t.params
        assert 1e-6 <= p["rate"] <= 1e-1 and isinstance(p["hidden"], int) and 10 <= p["hidden"] <= 3000
        assert p["layers"] in (1, 2, 3, 4, 5) and p["smooth"] in (0.0, 0.1, 0.2, 0.3) and p["kind"] in "abcd"


def test_same_seed_same_trials_side_by_side():
    import time

    def slow(p, report):
        time.sleep(0.002 * (hash(p["kind"]) % 5))
        for step in range(4):
            report(step, known(p) * (4 - step))
        return known(p)

    a, b = (search(slow, SPACE, 40, seed=7, parallel=4) for _ in range(2))
    assert [(t.number, t.params, t.value, t.stopped) for t in a] == [(t.number, t.params, t.value, t.stopped) for t in b]
    assert [t.params for t in search(slow, SPACE, 12, seed=8)] != [t.params for t in a[:12]]


def test_poor_trials_are_stopped():
    ran = []

    def climbing(p, report):
        for step in range(10):
            ran.append(step)
            report(step, known(p) - 10 + step)
        return known(p)

    trials = search(climbing, SPACE, 50, seed=1, parallel=5, warm_up=2)
    stopped = [t for t in trials if t.stopped]
    assert 8 < len(stopped) < 40 and len(ran) < 450
    assert all(max(t.steps) >= 2 for t in stopped) and not best_trial(trials).stopped
    first = [t for t in trials[:5]]
    assert not any(t.stopped for t in first)  # nothing to compare with yet
    assert not any(t.stopped for t in search(climbing, SPACE, 20, seed=1, prune=False))


def test_edges():
    assert search(lambda p, _: 1.0, SPACE, 0) == []
    one = search(lambda p, _: math.nan, {"x": Real(2.0, 2.0), "y": Choice(("only",))}, 15)
    assert {(t.params["x"], t.params["y"]) for t in one} == {(2.0, "only")}
    tied = search(lambda p, _: 0.0, SPACE, 30, seed=2)
    assert best_trial(tied).number == 0
    with pytest.raises(ValueError):
        Real(0.0, 1.0, log=True)
    with pytest.raises(ValueError):
        Real(2.0, 1.0)
    with pytest.raises(ZeroDivisionError):
        search(lambda p, _: 1 / 0, SPACE, 2)
