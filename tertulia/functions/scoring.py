"""Batch scoring of text by a pluggable model.

A model is a ``make_predict_fn``: a function without arguments that loads the
model once per Python worker and returns ``f(texts) -> scores`` over NumPy arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, functions as F, types as T

from tertulia.functions.arrays import let
from tertulia.functions.text import occurrences

MakePredict = Callable[[], Callable[[np.ndarray], np.ndarray]]


def batch_scores(make_predict_fn: MakePredict, text: Column, batch_size: int = 1024) -> Column:
    """Score vector per text; a null text is never sent to the model and stays null."""

    def make_skipping_nulls() -> Callable[[np.ndarray], np.ndarray]:
        predict = make_predict_fn()

        def run(texts: np.ndarray) -> np.ndarray:
            texts = np.asarray(texts, dtype=object)
            known = np.array([t is not None for t in texts], dtype=bool)
            if known.all():
                return np.asarray(predict(texts), dtype=np.float64)
            if not known.any():
                return np.full((len(texts), 1), np.nan)
            scored = np.asarray(predict(texts[known]), dtype=np.float64)
            out = np.full((len(texts), scored.shape[1]), np.nan)
            out[known] = scored
            return out

        return run

    scorer = predict_batch_udf(
        make_skipping_nulls, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size
    )
    return F.when(text.isNotNull(), scorer(text))


def labelled(scores: Column, labels: list[str]) -> Column:
    """Score vector as ``array<struct<label, score>>`` in the order of ``labels``."""
    def pairs(vector: Column) -> Column:
        entries = [
            F.struct(F.lit(name).alias("label"), F.get(vector, F.lit(i)).alias("score"))
            for i, name in enumerate(labels)
        ]
        return F.when(vector.isNotNull(), F.array(*entries))

    return let(scores, pairs)


def label_score(scores: Column, label: str) -> Column:
    """Score of one label, looked up by name rather than by position."""
    return F.get(F.filter(scores, lambda s: s["label"] == label), F.lit(0))["score"]


def letter_sentiment() -> Callable[[np.ndarray], np.ndarray]:
    """Stand-in sentiment model: smoothed shares of the letters e, a and n."""

    def predict(texts: np.ndarray) -> np.ndarray:
        hits = np.array([[t.count(c) for c in "ean"] for t in texts], dtype=np.float64) + 1.0
        return hits / hits.sum(axis=1, keepdims=True)

    return predict


def letter_sentiment_scores(text: Column) -> Column:
    """The same stand-in as a native expression, for jobs that need no model worker."""
    hits = [(occurrences(text, c) + 1).cast("double") for c in "ean"]
    shares = let(
        F.array(*hits),
        lambda h: F.transform(h, lambda x: x / (F.get(h, F.lit(0)) + F.get(h, F.lit(1)) + F.get(h, F.lit(2)))),
    )
    return F.when(text.isNotNull(), shares)


#: A function without arguments that returns ``f(texts) -> token ids of each text``.
MakeEncode = Callable[[], Callable[[list[str]], list[list[int]]]]
MAX_TOKENS = 512


def dealt_by_length(lengths: np.ndarray, batch_size: int, padding: float) -> list[np.ndarray]:
    """Positions in batches for a model that pads each text to the longest of its batch.

    Texts go by length (equal ones as they came). A batch ends at ``batch_size`` texts, or before
    the text with which more than the share ``padding`` of its cells would be empty. Empty texts
    go with the longest, as far as the padding allows, and are alone otherwise.
    """
    order = np.argsort(-lengths, kind="stable")
    some = int(np.count_nonzero(lengths > 0))
    order, none = order[:some], order[some:]
    sorted_ = lengths[order].astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sorted_)])
    out, at = [], 0
    while at < len(order):
        longest = int(sorted_[at])
        room = min(len(none), int(padding * batch_size), batch_size - 1)
        size = np.arange(1, min(batch_size - room, len(order) - at) + 1)
        filled = total[at + size] - total[at]
        # the share of empty cells only grows, as texts get shorter
        fits = max(1, int(np.searchsorted(1 - filled / (size * longest) > padding, True)))
        more = np.arange(1, room + 1)
        more = int(np.searchsorted(1 - filled[fits - 1] / ((fits + more) * longest) > padding, True))
        out.append(np.concatenate([order[at : at + fits], none[:more]]))
        at, none = at + fits, none[more:]
    step = 1 if padding < 1 else batch_size
    return out + [none[at : at + step] for at in range(0, len(none), step)]


def padded(ids: list[list[int]], fill: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Token ids as a matrix of the longest text's width, and the texts' lengths."""
    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    out = np.full((len(ids), max(1, int(lengths.max(initial=0)))), fill, dtype=np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = [i for x in ids for i in x]
    return out, lengths


def token_scores(
    make_encode_fn: MakeEncode,
    make_predict_fn: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]],
    text: Column,
    max_tokens: int = MAX_TOKENS,
    batch_size: int = 1024,
    padding: float = 0.1,
) -> Column:
    """Score vector per text of a model that reads at most ``max_tokens`` tokens.

    Texts are encoded and cut before they are scored. The model is called with (token ids padded
    with zeros, lengths) of texts of about one length, so at most the share ``padding`` of what
    it reads is empty; scores come back in the order of the rows, and do not depend on what
    else was in a batch if the model's do not. A null text stays null and is not sent; an
    empty one is sent with no token.
    """
    encode = predict = None

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        nonlocal encode, predict
        encode, predict = encode or make_encode_fn(), predict or make_predict_fn()
        for texts in parts:
            known = np.flatnonzero(texts.notna().to_numpy())
            ids = [x[:max_tokens] for x in encode(texts.iloc[known].tolist())]
            out: list = [None] * len(texts)
            for batch in dealt_by_length(np.array([len(x) for x in ids], dtype=np.int64), batch_size, padding):
                found = np.asarray(predict(*padded([ids[i] for i in batch])), dtype=np.float64)
                for i, scores in zip(batch, found.tolist(), strict=True):
                    out[known[i]] = scores
            yield pd.Series(out, dtype=object)

    return score(text)


def character_ids() -> Callable[[list[str]], list[list[int]]]:
    """Stand-in encoder: a token for each character."""
    return lambda texts: [[ord(c) for c in t] for t in texts]


def letter_sentiment_of_ids() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The stand-in sentiment model over character tokens."""

    def predict(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        inside = np.arange(ids.shape[1]) < lengths[:, None]
        hits = np.stack([((ids == ord(c)) & inside).sum(axis=1) for c in "ean"], axis=1) + 1.0
        return hits / hits.sum(axis=1, keepdims=True)

    return predict
