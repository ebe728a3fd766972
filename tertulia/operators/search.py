"""Model-based search over mixed parameters, with poor trials stopped early.

A tree-structured Parzen estimator: the trials so far are split into the best and the rest,
each parameter of each part is described by a mixture of one kernel a trial and a wide prior,
and of some draws from the best's mixture the one is tried whose density there is highest over
that of the rest. Logarithmic and stepped parameters are described on their own scale.

Trials run side by side, ``parallel`` at a time; all that a round proposes or stops depends only
on rounds before it, so the same seed gives the same trials however fast each of them is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from statistics import median

import numpy as np


@dataclass(frozen=True)
class Real:
    """A number from ``low`` to ``high``: on a log scale, on multiples of ``step``, or whole."""

    low: float
    high: float
    log: bool = False
    step: float | None = None
    whole: bool = False

    def __post_init__(self):
        if not self.low <= self.high or (self.log and self.low <= 0):
            raise ValueError("bounds out of order, or a log scale that reaches zero")

    def inside(self, value: float) -> float:
        return math.log(value) if self.log else float(value)

    @property
    def bounds(self) -> tuple[float, float]:
        """On the inner scale; a grid's first and last cell reach half a step beyond."""
        half = (self.step or 1.0) / 2 if (self.step or self.whole) else 0.0
        low, high = self.low - half, self.high + half
        if self.log:
            return math.log(max(low, self.low / 2)), math.log(high)
        return low, high

    def outside(self, x: float) -> float | int:
        value = math.exp(x) if self.log else x
        if self.step:
            value = round(self.low + round((value - self.low) / self.step) * self.step, 12)
        value = min(max(value, self.low), self.high)
        return int(round(value)) if self.whole else value

    def drawn(self, draw: np.random.Generator) -> float | int:
        return self.outside(draw.uniform(*self.bounds))

    def proposed(self, best: list, rest: list, draw: np.random.Generator, candidates: int):
        low, high = self.bounds
        if low == high:
            return self.outside(low)
        good, poor = (_kernels([self.inside(v) for v in of], low, high) for of in (best, rest))
        which = draw.integers(0, len(good[0]), candidates)
        x = draw.normal(good[0][which], good[1][which])
        x = np.where((x < low) | (x > high), draw.uniform(low, high, candidates), x)
        return self.outside(float(x[np.argmax(_density(x, good, low, high) - _density(x, poor, low, high))]))


@dataclass(frozen=True)
class Choice:
    options: tuple

    def drawn(self, draw: np.random.Generator):
        return self.options[draw.integers(0, len(self.options))]

    def proposed(self, best: list, rest: list, draw: np.random.Generator, candidates: int):
        shares = []
        for of in (best, rest):
            count = np.array([1.0 + sum(v == o for v in of) for o in self.options])
            shares.append(count / count.sum())
        which = draw.choice(len(self.options), candidates, p=shares[0])
        return self.options[which[np.argmax(shares[0][which] / shares[1][which])]]


def _kernels(values: list[float], low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres and widths: a width is the larger gap to the next centres, within bounds; the
    prior is a kernel as wide as the range at its middle."""
    x = np.sort(np.array([*values, (low + high) / 2]))
    edges = np.concatenate([[low], x, [high]])
    gaps = np.maximum(edges[1:-1] - edges[:-2], edges[2:] - edges[1:-1])
    width = np.clip(gaps, (high - low) / min(100, 1 + len(x)), high - low)
    width[np.searchsorted(x, (low + high) / 2)] = high - low
    return x, width


def _density(x: np.ndarray, kernels: tuple[np.ndarray, np.ndarray], low: float, high: float) -> np.ndarray:
    """Log density of the mixture of kernels, each cut to the range."""
    centre, width = kernels
    below = np.vectorize(lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2))))
    mass = below((high - centre) / width) - below((low - centre) / width)
    z = (x[:, None] - centre) / width
    terms = -0.5 * z * z - np.log(width * mass * len(centre))
    top = terms.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(terms - top).sum(axis=1, keepdims=True)))[:, 0]


class Stopped(Exception):
    """Raised by ``report`` in a trial that is to end."""


@dataclass
class Trial:
    number: int
    params: dict
    value: float | None = None  # the last reported one, if it was stopped
    stopped: bool = False
    steps: dict[int, float] = field(default_factory=dict)


Report = Callable[[int, float], None]


def search(
    objective: Callable[[dict, Report], float],
    space: Mapping[str, Real | Choice],
    trials: int,
    seed: int = 42,
    parallel: int = 1,
    startup: int = 10,
    candidates: int = 24,
    warm_up: int = 0,
    prune: bool = True,
) -> list[Trial]:
    """All trials, in order; the objective is to be large.

    ``objective`` gets the parameters and a function to report (step, value) with. From step
    ``warm_up`` on, and once five trials of earlier rounds have reported a step, a trial
    below their median there is stopped. The first ``startup`` trials are drawn at random. A trial
    without a finite value counts as the worst.
    """
    done: list[Trial] = []
    while len(done) < trials:
        count = min(parallel, trials - len(done))
        asked = []
        for number in range(len(done), len(done) + count):
            draw = np.random.default_rng((seed, number))
            asked.append(Trial(number, _proposal(space, done, draw, startup, candidates)))
        marks = _medians(done) if prune else {}

        def run(trial: Trial, marks: dict[int, float] = marks) -> None:
            def report(step: int, value: float) -> None:
                trial.steps[step], trial.value = value, value
                if step >= warm_up and value < marks.get(step, -math.inf):
                    raise Stopped

            try:
                trial.value = objective(trial.params, report)
            except Stopped:
                trial.stopped = True

        with ThreadPool(count) as pool:
            pool.map(run, asked)
        done += asked
    return done


def best_trial(trials: list[Trial]) -> Trial:
    """The finished trial of the largest value, the first of equal ones."""
    return max((t for t in trials if not t.stopped), key=_value)


def _value(trial: Trial) -> float:
    return trial.value if trial.value is not None and math.isfinite(trial.value) else -math.inf


def _medians(done: list[Trial]) -> dict[int, float]:
    steps = {s for t in done for s in t.steps}
    reported = {s: [t.steps[s] for t in done if s in t.steps] for s in steps}
    return {s: median(v) for s, v in reported.items() if len(v) >= 5}


def _proposal(space: Mapping[str, Real | Choice], done: list[Trial], draw, startup: int, candidates: int) -> dict:
    if len(done) < startup:
        return {name: kind.drawn(draw) for name, kind in space.items()}
    # a stopped trial is worse than every finished one, and the later it was stopped the better
    order = sorted(done, key=lambda t: (t.stopped, -max(t.steps, default=0) if t.stopped else 0, -_value(t)))
    cut = min(25, math.ceil(0.15 * len(order)))
    best, rest = order[:cut], order[cut:]
    return {
        name: kind.proposed([t.params[name] for t in best], [t.params[name] for t in rest], draw, candidates)
        for name, kind in space.items()
    }
