"""Embeddings of first messages and how well they separate by language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tertulia.functions.arrays import let, mean_pool, message
from tertulia.functions.scoring import MakePredict, batch_scores
from tertulia.functions.text import WHITESPACE
from tertulia.operators.ordering import bootstrap
from tertulia.operators.silhouette import by_label, over_subsets, overall, silhouettes


def hashed_words(text: Column, width: int = 16) -> Column:
    """Stand-in for a sentence model: mean of one-hot word vectors.

    Each word's digest picks a dimension, each word has mask 1.
    """
    blanks = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    words = F.array_remove(F.split(blanks, " "), "")
    slots = F.transform(
        words, lambda w: F.conv(F.left(F.md5(w), F.lit(4)), 16, 10).cast("int") % width
    )

    def share(slots: Column, i: Column) -> Column:
        hits = F.size(F.filter(slots, lambda s: s == i)).cast("double")
        return F.coalesce(F.try_divide(hits, F.size(slots).cast("double")), F.lit(0.0))

    dimensions = F.sequence(F.lit(0), F.lit(width - 1))
    return let(slots, lambda s: F.transform(dimensions, lambda i: share(s, i)))


def embed_first_message(
    df: DataFrame,
    embed: Callable[[Column], Column] = hashed_words,
    make_predict_fn: MakePredict | None = None,
    batch_size: int = 1500,
) -> DataFrame:
    """Add ``sentence_embeddings`` of the first message, natively or by a batch model."""
    text = message(F.col("conversation"), 0)["content"]
    vector = batch_scores(make_predict_fn, text, batch_size) if make_predict_fn else embed(text)
    return df.withColumn("sentence_embeddings", vector)


def pooled(df: DataFrame, tokens: str = "token_embeddings", mask: str = "attention_mask") -> DataFrame:
    return df.withColumn("sentence_embeddings", mean_pool(F.col(tokens), F.col(mask)))


def bootstrap_scores(
    df: DataFrame,
    key: Column,
    vector: str,
    label: str,
    size: int = 1000,
    subsets: int = 20,
    seed: int = 42,
    fraction: float | None = None,
) -> DataFrame:
    """Silhouettes of ``subsets`` samples with replacement: (subset, id, label, silhouette).

    The distance work is quadratic in the sample, so its ``size`` is absolute; a
    ``fraction`` of the rows in its place is for small corpora.
    """
    rows = df.count()
    draws = size if fraction is None else int(rows * fraction)
    sampled = bootstrap(df, key, draws, subsets, rows, seed)
    return silhouettes(sampled, "draw", vector, label, ["subset"], rows=draws)


def by_language(scores: DataFrame) -> DataFrame:
    return over_subsets(by_label(scores, ["subset"]))


def summary(scores: DataFrame) -> DataFrame:
    return overall(scores, "subset")
