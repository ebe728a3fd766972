"""Scoring of texts cut to a number of tokens, in batches dealt by length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tertulia.functions.scoring import character_ids, dealt_by_length, padded, token_scores


@pytest.mark.parametrize("padding", [0.0, 0.1, 0.5])
def test_batches_hold_each_text_once_within_the_padding(padding):
    draw = np.random.default_rng(1)
    lengths = np.concatenate([draw.integers(0, 513, 2000), np.full(700, 512), np.zeros(5, int)])
    batches = dealt_by_length(lengths, 64, padding)
    assert sorted(np.concatenate(batches).tolist()) == list(range(len(lengths)))
    cells = filled = 0
    for b in batches:
        assert 1 <= len(b) <= 64
        width = max(1, lengths[b].max())
        assert len(b) == 1 or 1 - lengths[b].sum() / (width * len(b)) <= padding + 1e-9
        cells, filled = cells + width * len(b), filled + lengths[b].sum()
    assert 1 - filled / cells <= padding + 0.001
    if padding == 0.1:  # as they came, more than three tenths of what the model reads is empty
        given = np.split(lengths, range(64, len(lengths), 64))
        assert 1 - lengths.sum() / sum(max(g.max(initial=0), 1) * len(g) for g in given) > 0.3
        assert len(batches) < 1.3 * len(lengths) / 64


def test_padded():
    matrix, lengths = padded([[1, 2, 3], [], [4]])
    assert matrix.tolist() == [[1, 2, 3], [0, 0, 0], [4, 0, 0]] and lengths.tolist() == [3, 0, 1]
    assert padded([])[0].shape == (0, 1) and padded([[]])[0].shape == (1, 1)


def test_order_nulls_and_cuts(spark):
    def seen():
        return lambda ids, lengths: np.stack([lengths, ids.sum(axis=1), (ids > 0).sum(axis=1)], axis=1)

    rows = [(0, None), (1, ""), (2, "b"), (3, "c" * 600), (4, None), (5, "d" * 512), (6, "é🙂")]
    rows += [(10 + i, "x" * (i % 37)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    found = df.select("id", token_scores(character_ids, seen, F.col("text"), 512, 16, 0.2).alias("s")).collect()
    got = {r["id"]: r["s"] for r in found}
    for i, t in rows:
        if t is None:
            assert got[i] is None
        else:
            ids = [ord(c) for c in t[:512]]
            assert got[i] == [len(ids), sum(ids), len(ids)]
    assert df.limit(0).select(token_scores(character_ids, seen, F.col("text"))).count() == 0
