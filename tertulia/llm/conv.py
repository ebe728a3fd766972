"""A byte-level convolutional network in NumPy, trained on the driver, applied in tasks.

A document is cut into windows of fixed length that overlap by one filter width, so that
every run of bytes lies within a window. Filters of several widths slide over the bytes;
a filter is a table of weights per offset and byte, so its response is a sum of looked-up
rows. Responses are max-pooled per window; the windows of a document are combined by
their mean (weighted by bytes) and, if asked for, their maximum; a softmax layer follows.

With ``repeats`` a second input plane says how much of the neighbourhood occurred already
within the last bytes, in eight levels; filters of so few bytes could not see it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from tertulia.llm.words import PIECE, buffers, runs

LEVELS, LAGS, NEAR = 8, 24, 32


@dataclass
class Shape:
    """What is fixed before training. All widths are even: bytes are looked up in pairs."""

    classes: int
    widths: tuple[int, ...] = (2, 4, 6)
    filters: int = 16
    window: int = 512
    with_max: bool = False
    repeats: bool = False

    @property
    def step(self) -> int:
        return self.window - max(self.widths) + 1

    @property
    def pooled(self) -> int:
        return self.filters * len(self.widths)

    @property
    def features(self) -> int:
        return self.pooled * (1 + self.with_max)


@dataclass
class Model:
    shape: Shape
    tables: list[np.ndarray]  # per width: offsets x 256 x filters
    levels: list[np.ndarray]  # per width: LEVELS x filters
    dense: np.ndarray
    bias: np.ndarray
    pairs: list[np.ndarray] = field(default_factory=list)

    def parts(self) -> list[np.ndarray]:
        return [*self.tables, *self.levels, self.dense, self.bias]


def repeat_levels(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Share of the last NEAR bytes whose four bytes stood within the LAGS bytes before.

    ``cuts`` are the rows' first bytes; a row's levels depend on its own bytes only.
    """
    n = len(data)
    seen = np.zeros(n, dtype=bool)
    at = np.arange(n)
    row = np.searchsorted(cuts, at, side="right") - 1
    start, stop = cuts[row], np.append(cuts[1:], n)[row]
    if n > 3:
        wide = data.astype(np.uint32)
        code = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
        for lag in range(2, min(LAGS, len(code) - 1) + 1):
            seen[lag : len(code)] |= (code[lag:] == code[:-lag]) & ((at - start)[lag : len(code)] >= lag)
    seen &= at + 3 < stop  # nothing is compared across the border of two rows
    total = np.concatenate([[0], np.cumsum(seen)])
    begin = np.maximum(at - NEAR + 1, start)
    return ((total[at + 1] - total[begin]) * (LEVELS - 1) // NEAR).astype(np.uint8)


def windows(data: np.ndarray, offsets: np.ndarray, shape: Shape, around: tuple[int, int] = (0, 0)):
    """Windows of the rows as a byte matrix, their levels, their sizes and each row's first one.

    An empty row has one window of zero bytes. ``around``: how many bytes before and after are
    of the same row, if there is but one and it is a part.
    """
    sizes = np.diff(offsets)
    count = np.maximum(1, -(-np.maximum(sizes - shape.window, 0) // shape.step) + 1)
    first = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(sizes)), count)
    begin = (np.arange(first[-1]) - first[row]) * shape.step
    left = np.clip(sizes[row] - begin, 0, shape.window)
    local = offsets[:-1][row] - offsets[0] + begin
    span = data[offsets[0] : offsets[-1]]
    padded = np.concatenate([span, np.zeros(shape.window, dtype=np.uint8)])
    index = local[:, None] + np.arange(shape.window)
    outside = np.arange(shape.window) >= left[:, None]
    found = np.where(outside, 0, padded[np.minimum(index, len(padded) - 1)]).astype(np.uint8)
    level = None
    if shape.repeats:
        before, after = around
        starts = np.unique(offsets[:-1] - offsets[0])
        wide = data[offsets[0] - before : offsets[-1] + after]
        marks = repeat_levels(wide, starts[starts < max(1, len(span))] if len(span) else np.zeros(1, int))
        marks = marks[before : before + len(span)]
        marks = np.concatenate([marks, np.zeros(shape.window, dtype=np.uint8)])
        level = np.where(outside, 0, marks[np.minimum(index, len(marks) - 1)]).astype(np.uint8)
    return found, level, left, first[:-1]


def ready(model: Model) -> Model:
    """Adds the tables over byte pairs that make scoring half the look-ups."""
    model.pairs = [
        (t[0::2, :, None, :] + t[1::2, None, :, :]).reshape(len(t) // 2, 65536, -1).astype(np.float32)
        for t in model.tables
    ]
    return model


def pooled(model: Model, found: np.ndarray, level: np.ndarray | None, where: bool = False):
    """Largest response of each filter in each window (and its position)."""
    pair = found[:, :-1].astype(np.uint16) << np.uint16(8) | found[:, 1:]
    best, at = [], []
    for k, table in enumerate(model.pairs):
        width = 2 * len(table)
        n = found.shape[1] - width + 1
        out = table[0].take(pair[:, :n], axis=0)
        for j in range(1, len(table)):
            out += table[j].take(pair[:, 2 * j : 2 * j + n], axis=0)
        if level is not None:
            out += model.levels[k].take(level[:, width - 1 :], axis=0)
        if where:
            spot = out.argmax(axis=1)
            at.append(spot)
            best.append(np.take_along_axis(out, spot[:, None, :], axis=1)[:, 0])
        else:
            best.append(out.max(axis=1))
    return np.concatenate(best, axis=1), at


def combined(model: Model, h: np.ndarray, weight: np.ndarray, first: np.ndarray):
    """Features per document of the window responses ``h``."""
    w = np.maximum(weight, 1).astype(np.float32)[:, None]
    mean = np.add.reduceat(h * w, first) / np.add.reduceat(w, first)
    if not model.shape.with_max:
        return mean
    return np.concatenate([mean, np.maximum.reduceat(h, first)], axis=1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def trained(
    texts: list[str],
    labels: np.ndarray,
    shape: Shape,
    epochs: int = 8,
    batch_windows: int = 96,
    rate: float = 0.01,
    weights: np.ndarray | None = None,
    seed: int = 7,
    least_steps: int = 250,
) -> Model:
    """The network fitted by Adam to the texts; ``weights`` are per class.

    A small sample is gone through more often than ``epochs``, for ``least_steps`` steps.
    """
    rng = np.random.default_rng(seed)
    model = Model(
        shape,
        [rng.normal(0, 0.3 / w**0.5, (w, 256, shape.filters)).astype(np.float32) for w in shape.widths],
        [np.zeros((LEVELS, shape.filters), np.float32) for _ in shape.widths],
        rng.normal(0, 0.1, (shape.features, shape.classes)).astype(np.float32),
        np.zeros(shape.classes, np.float32),
    )
    if not len(texts):
        return ready(model)
    data, offsets = buffers(pa.array(texts, pa.large_string()))
    per_row = np.maximum(1, -(-np.maximum(np.diff(offsets) - shape.window, 0) // shape.step) + 1)
    weights = np.ones(shape.classes) if weights is None else weights
    first_m = [np.zeros_like(p) for p in model.parts()]
    second_m = [np.zeros_like(p) for p in model.parts()]
    steps = 0
    epochs = max(epochs, -(-least_steps * batch_windows // int(per_row.sum())))
    total = max(1, int(epochs * per_row.sum() / batch_windows))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        cuts = np.flatnonzero(np.diff(np.cumsum(per_row[order]) // batch_windows)) + 1
        for rows in np.split(order, cuts):
            parts = [data[offsets[r] : offsets[r + 1]] for r in rows]
            local = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            joined = np.concatenate(parts) if local[-1] else np.zeros(0, np.uint8)
            found, level, left, first = windows(joined, local, shape)
            ready(model)
            raw, at = pooled(model, found, level, where=True)
            h = np.maximum(raw, 0)
            z = combined(model, h, left, first)
            p = softmax(z @ model.dense + model.bias)
            y = labels[rows]
            w = weights[y][:, None].astype(np.float32)
            p[np.arange(len(rows)), y] -= 1
            p *= w / len(rows)
            grads = [np.zeros_like(x) for x in model.parts()]
            grads[-2], grads[-1] = z.T @ p, p.sum(axis=0)
            dz = p @ model.dense.T
            count = np.diff([*first, len(found)])
            row = np.repeat(np.arange(len(rows)), count)
            size = np.maximum(left, 1).astype(np.float32)
            dh = dz[row, : shape.pooled] * (size / np.add.reduceat(size, first)[row])[:, None]
            if shape.with_max:
                top = np.maximum.reduceat(h, first)[row] == h
                dh += dz[row, shape.pooled :] * top
            dh *= raw > 0
            for k, width in enumerate(shape.widths):
                d = dh[:, k * shape.filters : (k + 1) * shape.filters]
                f = np.broadcast_to(np.arange(shape.filters), d.shape)
                line = np.arange(len(found))[:, None]
                for j in range(width):
                    np.add.at(grads[k], (j, found[line, at[k] + j], f), d)
                if level is not None:
                    np.add.at(grads[len(shape.widths) + k], (level[line, at[k] + width - 1], f), d)
            steps += 1
            pace = rate * max(0.05, 1 - steps / (total + 1))
            for x, g, m, v in zip(model.parts(), grads, first_m, second_m, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                x -= pace * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-7)
    return ready(model)


def scores(model: Model, column: pa.Array) -> Iterator[np.ndarray]:
    """Class probabilities of each row's whole text, in blocks of rows."""
    shape = model.shape
    data, offsets = buffers(column)
    for first, last in runs(offsets, PIECE // 2):
        local = offsets[first : last + 1]
        sums = np.zeros((last - first, shape.pooled))
        most = np.zeros((last - first, shape.pooled), np.float32)
        size = np.zeros(last - first)
        for row, found, level, left in blocks(data, local, shape):
            h = np.maximum(pooled(model, found, level)[0], 0)
            w = np.maximum(left, 1)
            np.add.at(sums, row, h * w[:, None])
            np.add.at(size, row, w)
            np.maximum.at(most, row, h)
        z = sums / size[:, None]
        if shape.with_max:
            z = np.concatenate([z, most], axis=1)
        # row by row: a matrix product may round a row otherwise beside others
        yield softmax((z[:, :, None] * model.dense[None]).sum(axis=1) + model.bias)


def blocks(
    data: np.ndarray, offsets: np.ndarray, shape: Shape, most: int = 48, around: tuple[int, int] = (0, 0)
):
    """Windows of the rows, at most ``most`` at a time; a very long row comes in parts."""
    if len(offsets) == 2 and offsets[1] - offsets[0] > PIECE and around == (0, 0):
        stride = shape.step * max(1, PIECE // 2 // shape.step)
        for at in range(offsets[0], offsets[1], stride):
            end = min(offsets[1], at + stride + shape.window - shape.step)
            if at > offsets[0] and end - at <= shape.window - shape.step:
                break
            near = min(NEAR + LAGS, at - offsets[0]), min(3, offsets[1] - end)
            yield from blocks(data, np.array([at, end]), shape, most, near)
        return
    found, level, left, first = windows(data, offsets, shape, around)
    row = np.searchsorted(first, np.arange(len(found)), side="right") - 1
    for at in range(0, len(found), most):
        part = slice(at, at + most)
        yield row[part], found[part], None if level is None else level[part], left[part]
