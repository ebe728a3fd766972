"""Toxicity by boosted trees over dense features, with isotonic calibration.

Features are rates per text: words of a learned lexicon, those near a second person,
capitals, punctuation and signs of obfuscation. They derive from counts that add up over the
parts of a text, so a very long one is read in parts. The lexicon holds whole words and
beginnings of 4 to 7 bytes that toxic texts of the training sample share and others lack.

The sample is bounded (``classify.SAMPLE`` rows in expectation, texts of at most
``classify.SAMPLE_BYTES`` bytes, picked by a hash of the id) and is split in three: lexicon,
trees, calibration. Every row is then scored where it is. A null text counts as empty, and
empty texts get the score of zero counts; repeated rows get equal scores; an empty table
gives an empty result; without a labelled text the score is 0. A column with the name of the
output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tertulia.llm.classify import labelled_sample
from tertulia.llm.store import replaced, with_computed
from tertulia.llm.words import LOWER, PIECE, Words, buffers, pieces, runs

SAMPLE = 4_000
BEGINNINGS = (4, 5, 6, 7)
NEAR = 5
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 32

# fixed values: words for a second person in the corpus languages
SECOND_PERSON = (
    "you your yours yourself du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous "
    "votre vos usted ustedes tus ti contigo vosotros"
).split()

LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
CAPITAL = np.zeros(256, dtype=bool)
CAPITAL[65:91] = True
SIGN = np.zeros(256, dtype=bool)
SIGN[[ord(c) for c in "0123456789*@$#%&!_+|"]] = True
JOINT = np.zeros(256, dtype=bool)
JOINT[[ord(c) for c in ".-'~^"]] = True
POINT = np.zeros(256, dtype=bool)
POINT[[ord(c) for c in "!?.,;:*#$%&|"]] = True

COUNTS = (
    "bytes letters words hits near capitals capital_words points shouts signs joints runs".split()
)


def splitter() -> Words:
    return Words(blank=~LETTER)


def _keys(split: Words, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
    """Hashes of the words and of their beginnings, with the words that they are of."""
    yield np.arange(len(starts)), hashes
    for n in BEGINNINGS:
        of = np.flatnonzero(ends - starts > n)
        yield of, split.span_hashes(starts[of], starts[of] + n) + np.uint64(n)


def lexicon(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Hashes of words and beginnings that toxic texts share and other texts lack."""
    split, found = splitter(), {0: [], 1: []}
    data, offsets = buffers(pa.array(texts, pa.large_string()))
    for row, label in enumerate(toxic.tolist()):
        part = data[offsets[row] : offsets[row + 1]]
        if len(part):
            starts, ends, hashes, _ = split.of(part)
            keys = [k for _, k in _keys(split, starts, ends, hashes)]
            found[label].append(np.unique(np.concatenate(keys)))
    if not found[0] or not found[1]:
        return np.zeros(0, dtype=np.uint64)
    keys, n = np.unique(np.concatenate(found[1]), return_counts=True)
    other, m = np.unique(np.concatenate(found[0]), return_counts=True)
    at = np.minimum(np.searchsorted(other, keys), len(other) - 1)
    beside = np.where(other[at] == keys, m[at], 0)
    share, rest = n / len(found[1]), beside / len(found[0])
    return keys[(n >= 4) & (share >= 0.025) & (share >= 12 * (rest + 0.001))]


def beside(person: np.ndarray, at: np.ndarray, row: np.ndarray | None = None) -> np.ndarray:
    """Which of the words ``at`` have one of the words ``person`` of the same row within NEAR."""
    out = np.zeros(len(at), dtype=bool)
    if len(person):
        for side in (np.searchsorted(person, at) - 1, np.searchsorted(person, at)):
            other = person[np.clip(side, 0, len(person) - 1)]
            out |= (np.abs(other - at) <= NEAR) & (True if row is None else row[other] == row[at])
    return out


class Counter:
    """Counts of texts, see COUNTS; those of a text do not depend on what is beside it."""

    def __init__(self, words: np.ndarray):
        self.split, self.words = splitter(), words
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[words >> np.uint64(48)] = True
        text = np.frombuffer(" ".join(SECOND_PERSON).encode(), np.uint8)
        self.second = np.sort(self.split.of(text)[2])

    def _in(self, sorted_: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(sorted_):
            return np.zeros(len(keys), dtype=bool)
        return sorted_[np.minimum(np.searchsorted(sorted_, keys), len(sorted_) - 1)] == keys

    def part(self, data: np.ndarray, local: np.ndarray) -> np.ndarray:
        """One row of counts for each range of ``local`` over the bytes."""
        rows = len(local) - 1
        out = np.zeros((rows, len(COUNTS)))
        out[:, 0] = np.diff(local)
        if not len(data):
            return out
        cuts = local[:-1][local[:-1] < len(data)]
        starts, ends, hashes, _ = self.split.of(data, cuts)
        edge = np.searchsorted(starts, local)

        def per_row(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask)])
            return np.diff(total[local])

        def per_word(mask: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask)])
            return np.diff(total[edge])

        hit = np.zeros(len(starts), dtype=bool)
        for of, keys in _keys(self.split, starts, ends, hashes):
            likely = np.flatnonzero(self.maybe[keys >> np.uint64(48)])
            hit[of[likely[self._in(self.words, keys[likely])]]] = True
        row = np.repeat(np.arange(rows), np.diff(edge))
        person, at = np.flatnonzero(self._in(self.second, hashes)), np.flatnonzero(hit)
        near = np.zeros(len(starts), dtype=bool)
        near[at] = beside(person, at, row)
        self.found = person, at, len(starts)
        letter, capital = LETTER[data], CAPITAL[data]
        raised = np.concatenate([[0], np.cumsum(capital)])
        shouted = (raised[ends] - raised[starts] == ends - starts) & (ends - starts > 2)
        between = np.zeros((3, len(data)), dtype=bool)
        if len(data) > 2:
            around = letter[:-2] & letter[2:]
            inside = np.ones(len(data), dtype=bool)  # not the first or last byte of a row
            inside[cuts], inside[local[1:][local[1:] > 0] - 1] = False, False
            around &= inside[1:-1]
            between[0, 1:-1] = around & SIGN[data[1:-1]]
            between[1, 1:-1] = around & JOINT[data[1:-1]]
            low = LOWER[data]
            between[2, 1:-1] = around & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:])
        columns = [
            per_row(letter), np.diff(edge), per_word(hit), per_word(near), per_row(capital),
            per_word(shouted), per_row(POINT[data]), per_row(data == 33),
            *(per_row(x) for x in between),
        ]
        for i, column in enumerate(columns):
            out[:, i + 1] = column
        return out

    def counts(self, column: pa.Array):
        """Blocks of counts that cover the rows in order."""
        data, offsets = buffers(column)
        for first, last in runs(offsets):
            span = data[offsets[first] : offsets[last]]
            if last == first + 1 and len(span) > PIECE:
                total, persons, hits, words = np.zeros((1, len(COUNTS))), [], [], 0
                for p in pieces(span):
                    total += self.part(p, np.array([0, len(p)]))
                    persons.append(self.found[0] + words)
                    hits.append(self.found[1] + words)
                    words += self.found[2]
                total[0, COUNTS.index("near")] = beside(np.concatenate(persons), np.concatenate(hits)).sum()
                yield total
            else:
                yield self.part(span, offsets[first : last + 1] - offsets[first])


def features(counts: np.ndarray) -> np.ndarray:
    n = dict(zip(COUNTS, counts.T, strict=True))
    words, size, letters = (np.maximum(n[k], 1) for k in ("words", "bytes", "letters"))
    return np.stack(
        [
            np.log1p(n["hits"]), n["hits"] / words, np.log1p(n["near"]), n["near"] / words,
            n["capitals"] / letters, n["capital_words"] / words, n["points"] / size,
            n["shouts"] / size, n["signs"] / words, n["joints"] / words, n["runs"] / words,
            np.log1p(n["words"]),
        ],
        axis=1,
    )


@dataclass
class Forest:
    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature and bin per node, leaves
    start: float
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        codes, line = self.binned(x), np.arange(len(x))
        total = np.full(len(x), self.start)
        for which, cut, leaves in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (codes[line, which[node]] > cut[node])
            total += leaves[node - (2**DEPTH - 1)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a share of the plain logistic value keeps the order of equal steps."""
        z = self.margin(x)
        plain = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if self.knots is None:
            return plain
        return 0.98 * np.interp(z, *self.knots) + 0.02 * plain


def boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Forest:
    """Logistic boosting of trees of DEPTH levels over binned features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    rate = np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    forest = Forest(edges, [], float(np.log(rate / (1 - rate))))
    codes = forest.binned(x)
    z = np.full(len(x), forest.start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(x), dtype=np.int64)
        which = np.zeros(2**DEPTH - 1, dtype=np.int64)
        cut = np.full(2**DEPTH - 1, BINS, dtype=np.int64)
        for level in range(DEPTH):
            nodes = 2**level
            best = np.zeros(nodes)
            base = nodes - 1
            for f in range(x.shape[1]):
                cell = (node - base) * (BINS + 1) + codes[:, f]
                gs = np.bincount(cell, g, nodes * (BINS + 1)).reshape(nodes, -1).cumsum(axis=1)
                hs = np.bincount(cell, h, nodes * (BINS + 1)).reshape(nodes, -1).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 1e-3) | (ht - hs < 1e-3)] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(nodes), top]
                better = value > best + 1e-9
                best[better] = value[better]
                which[base : base + nodes][better] = f
                cut[base : base + nodes][better] = top[better]
            node = 2 * node + 1 + (codes[np.arange(len(x)), which[node]] > cut[node])
        leaf = node - (2**DEPTH - 1)
        leaves = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        z = z + leaves[leaf]
        forest.trees.append((which, cut, leaves))
    return forest


def isotonic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit, by pooling adjacent violators."""
    values, at = np.unique(z, return_inverse=True)
    total = np.bincount(at, weight)
    mean = np.bincount(at, weight * y) / total
    blocks: list[list[float]] = []  # mean, weight, first value, last value
    for m, w, v in zip(mean.tolist(), total.tolist(), values.tolist(), strict=True):
        blocks.append([m, w, v, v])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, last = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + m2 * w2) / (b[1] + w2), b[1] + w2, last
    xs = [v for b in blocks for v in (b[2:] if b[2] < b[3] else b[2:3])]
    ys = [b[0] for b in blocks for _ in (b[2:] if b[2] < b[3] else b[2:3])]
    return np.array(xs), np.array(ys)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Forest] | None:
    """Lexicon and calibrated trees for label 1 of ``labels.toxic``; None without a label."""
    texts, toxic, class_weight = labelled_sample(docs, labels, "toxic", sample)
    if not texts:
        return None
    n = len(texts)
    a, b = int(0.4 * n), int(0.75 * n)
    words = lexicon(texts[:a], toxic[:a])
    x = features(np.concatenate(list(Counter(words).counts(pa.array(texts, pa.large_string())))))
    weight = np.maximum(class_weight[toxic], 1e-3)
    forest = boosted(x[a:b], toxic[a:b], weight[a:b]) if b > a else boosted(x, toxic, weight)
    if n > b and 0 < toxic[b:].sum() < n - b:
        forest.knots = isotonic(forest.margin(x[b:]), toxic[b:], weight[b:])
    return words, forest


def with_toxicity(
    docs: DataFrame, fitted: tuple[np.ndarray, Forest] | None, text: str = "text", score: str = "score"
) -> DataFrame:
    """Adds the probability that a text is toxic."""
    if fitted is None:
        return replaced(docs, {score: F.lit(0.0)})
    words, forest = fitted

    def make():
        counter = Counter(words)

        def compute(column: pa.Array):
            for counts in counter.counts(column):
                yield [pa.array(np.clip(forest.probability(features(counts)), 0, 1))]

        return compute

    return with_computed(docs, text, [T.StructField(score, T.DoubleType())], make)
