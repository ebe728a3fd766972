import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import ROWS, documents, empty
from pyspark.sql import functions as F

from tertulia.llm import lattice as L
from tertulia.llm.store import fold

PIECES = [b" a", b"a", b"ab", b" ab", b"b", b"bc", b" ", b"c", b"abc", b" one", b"o", b"ne", b"t", b"w"]
PIECES += [bytes([b]) for b in range(256) if bytes([b]) not in PIECES]


def cut(word, p):
    """Sum over all segmentations, by trying every first piece."""
    if not word:
        return 1.0
    return sum(x * cut(word[len(k) :], p) for k, x in p.items() if word.startswith(k))


def uniform():
    p = np.arange(1, len(PIECES) + 1, dtype=float)[::-1]
    return p / p.sum()


def test_all_segmentations():
    p = uniform()
    words = [b"abc", b"a", b"aababc", b"xyz", b"one", "é".encode()]
    table = dict(zip(PIECES, p.tolist(), strict=True))
    for _, _, data, starts in L.marked(pa.array(words, pa.binary())):
        found, _ = L.Lattice(PIECES).run(data, starts, np.log(p))
        assert np.allclose(np.exp(found), [cut(b" " + w, table) for w in words], rtol=1e-12, atol=0)


def test_expected_counts():
    """The gradient of the log likelihood is the expected count over the probability."""
    p, lattice = uniform(), L.Lattice(PIECES)
    _, _, data, starts = next(L.marked(pa.array([b"aababc", b"abc"], pa.binary())))
    weight = np.array([2.0, 5.0])
    _, counts = lattice.run(data, starts, np.log(p), weight)
    for k in (0, 1, 2, 3, 8):
        q = p.copy()
        q[k] *= 1 + 1e-6
        gain = (lattice.run(data, starts, np.log(q))[0] - lattice.run(data, starts, np.log(p))[0]) @ weight
        assert abs(gain / 1e-6 - counts[k]) < 1e-3


def tokens(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    return [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words] + [None]


@pytest.mark.parametrize("frequent", [0, 6, 1 << 18])
def test_scores(spark, frequent):
    docs = documents(spark)
    training = fold(F.col("doc_id"), 10) != 0
    found = L.scored(docs, training, PIECES, frequent=frequent).collect()
    trained = [t for i, t in ROWS if crc32(("" if i is None else str(i)).encode()) % 10]
    counts = Counter(w for t in trained for w in tokens(t))
    n, kinds = sum(counts.values()), len(counts)
    whole = math.log10(n + 0.1 * (kinds + 1))
    wanted = Counter()
    for i, t in ROWS:
        w = tokens(t)
        base = sum(math.log10(counts[x] + 0.1) - whole for x in w)
        wanted[i, len(w), sum(counts[x] > 0 for x in w), n, round(base, 5)] += 1
    assert Counter((r[0], r[1], r[2], r[3], round(r[4], 5)) for r in found) == wanted
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    same = [r["score"] for r in found if r["doc_id"] == 1]
    assert len(same) == 2 and same[0] == same[1]


def test_word_probabilities_sum_to_one(spark):
    """Seen words, the end, and every unseen word up to a length."""
    docs = spark.createDataFrame([(1, "a b a"), (2, "ab")], "doc_id long, text string")
    alone = [(9, "a"), (9, "b"), (9, "ab"), (9, "c"), (9, "")]
    both = docs.withColumn("t", F.lit(True)).union(
        spark.createDataFrame(alone, "doc_id long, text string").withColumn("t", F.lit(False))
    )
    rows = L.scored(both, F.col("t"), PIECES).where("doc_id = 9").collect()
    by = sorted(10 ** r["score"] for r in rows)
    end = max(by)
    words = [x / end for x in by if x != end]
    assert sum(words) + end < 1


def test_without_training_or_rows(spark):
    rows = L.scored(documents(spark), F.lit(False), PIECES).collect()
    assert len(rows) == len(ROWS) and all(math.isfinite(r["score"]) for r in rows)
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)
    assert L.scored(empty(spark), F.lit(True), PIECES).count() == 0


def test_vocabulary_file():
    import public_tokenizers

    pieces = L.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert len(set(pieces)) == len(pieces) > 20_000
    assert {bytes([b]) for b in range(256)} <= set(pieces)


def segmentations(word, p):
    """Every way to cut the word into pieces, with its probability."""
    if not word:
        yield [], 1.0
    for piece, x in p.items():
        if word.startswith(piece):
            for rest, y in segmentations(word[len(piece) :], p):
                yield [piece, *rest], x * y


def maximised(words, p):
    """One step of expectation and maximisation by listing all segmentations."""
    counts = dict.fromkeys(p, L.PSEUDO)
    for word in words:
        ways = list(segmentations(b" " + word, p))
        whole = sum(x for _, x in ways)
        for pieces, x in ways:
            for piece in pieces:
                counts[piece] += x / whole
    total = sum(counts.values())
    return {k: n / total for k, n in counts.items()}


def first_scores():
    p = [1 / (i + 2.7) for i in range(len(PIECES))]
    return {k: x / sum(p) for k, x in zip(PIECES, p, strict=True)}


TRAINING = ["abc ab A abc", "one two abcab", "", None, "ab ab Ab é"]
HELD = ["abc", "abcabc one", "", None, "two x", "AB é one ONE"]


@pytest.mark.parametrize("steps", [0, 1, 3])
def test_fit_of_brute_force(spark, steps):
    docs = spark.createDataFrame([(t, True) for t in TRAINING] + [(t, False) for t in HELD], "text string, t boolean")
    found = L.fitted(L.word_counts(docs, "t", "text"), PIECES, steps)
    wanted = first_scores()
    for _ in range(steps):
        wanted = maximised({w for t in TRAINING for w in tokens(t) if w is not None}, wanted)
    assert np.allclose(np.exp(found), [wanted[k] for k in PIECES], rtol=1e-10, atol=0)


def test_score_of_brute_force(spark):
    rows = [(i, t, i < len(TRAINING)) for i, t in enumerate(TRAINING + HELD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t boolean")
    counts = Counter(w for t in TRAINING for w in tokens(t))
    kinds = {w for w in counts if w is not None}
    p = first_scores()
    for _ in range(L.EM_STEPS):
        p = maximised(kinds, p)
    mass = sum(counts.values()) + 1.5

    def probability(w):
        if w is None:
            return (len(TRAINING) + 0.5) / mass
        return max(counts[w] - L.DISCOUNT, 0) / mass + (L.DISCOUNT * len(kinds) + 1) / mass * cut(b" " + w, p)

    for r in L.scored(docs, F.col("t"), PIECES).collect():
        wanted = sum(math.log10(probability(w)) for w in tokens(rows[r["doc_id"]][1]))
        assert r["score"] == pytest.approx(wanted, rel=1e-10)
