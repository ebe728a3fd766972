"""Sentiment of the first user and assistant message, by language and overall."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tertulia.functions.scoring import (
    MakePredict,
    batch_scores,
    label_score,
    labelled,
    letter_sentiment_scores,
)
from tertulia.operators.aggregate import mean_and_std
from tertulia.operators.columns import augment, without
from tertulia.operators.messages import first_messages
from tertulia.schema import SENTIMENTS

SIDES = ["user", "assistant"]
SCORES = [f"{s}_{side}_sentiment" for side in SIDES for s in SENTIMENTS]


def add_sentiment(
    df: DataFrame,
    score: Callable[[Column], Column] = letter_sentiment_scores,
    make_predict_fn: MakePredict | None = None,
    batch_size: int = 1024,
) -> DataFrame:
    """Add ``user_sentiment`` and ``assistant_sentiment`` where they are missing.

    ``make_predict_fn`` scores in Arrow batches by a model loaded once per worker;
    otherwise ``score`` is a native expression.
    """
    opened = first_messages(df)
    for side in SIDES:
        text, name = F.col(f"first_{side}_message"), f"{side}_sentiment"
        if name in df.columns:  # texts already scored are not sent again
            text = F.when(F.col(name).isNull(), text)
        scores = batch_scores(make_predict_fn, text, batch_size) if make_predict_fn else score(text)
        opened = augment(opened, name, labelled(scores, SENTIMENTS))
    return without(opened, "first_user_message", "first_assistant_message")


def score_columns(df: DataFrame) -> DataFrame:
    """Six score columns next to the other columns."""
    scores = [
        label_score(F.col(f"{side}_sentiment"), s).alias(f"{s}_{side}_sentiment")
        for side in SIDES
        for s in SENTIMENTS
    ]
    rest = without(df, "user_sentiment", "assistant_sentiment")
    return df.select(*scores, *[F.col(f"`{c}`") for c in rest.columns])


def _differences() -> list[Column]:
    return [
        (F.avg(f"{s}_assistant_sentiment") - F.avg(f"{s}_user_sentiment")).alias(f"{s}_diff")
        for s in SENTIMENTS
    ]


def by_language(df: DataFrame) -> DataFrame:
    """6 means, 6 deviations, 6 counts and 3 differences per language."""
    counts = [F.count(c).alias(f"{c}_count") for c in SCORES]
    return mean_and_std(
        df, ["lang"], SCORES, "{}_avg", "{}_std", [*counts, *_differences()]
    ).orderBy("lang")


def overall(df: DataFrame) -> DataFrame:
    return mean_and_std(df, [], SCORES, "{}_avg", "{}_std", _differences())


def bars(table: DataFrame) -> DataFrame:
    """Stacked bars of user sentiment, most positive language first."""
    names = [f"{s}_user_sentiment" for s in reversed(SENTIMENTS)]
    return table.select(
        "lang", *[f"{n}_avg" for n in names], *[f"{n}_count" for n in names]
    ).orderBy(F.desc("positive_user_sentiment_avg"), "lang")
