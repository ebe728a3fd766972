"""Queries: sentiment of the opening messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tertulia.catalog.length import rounded
from tertulia.catalog.registry import query
from tertulia.catalog.tables import PARTS_SQL, documents_corpus, table
from tertulia.functions.scoring import (
    MAX_TOKENS,
    character_ids,
    letter_sentiment,
    letter_sentiment_of_ids,
    token_scores,
)
from tertulia.operators.columns import analysis_names
from tertulia.operators.messages import first_messages
from tertulia.plans import sentiment
from tertulia.schema import SENTIMENTS
from tertulia.session import new_path
from tertulia.sources.corpus import write_corpus
from tertulia.sources.resume import scored_in_parts

_HIT = "(length({t}) - length(replace({t}, '{c}', '')) + 1)"


def _score_sql(text: str, letter: str) -> str:
    hits = [_HIT.format(t=text, c=c) for c in "ean"]
    return f"CAST({_HIT.format(t=text, c=letter)} AS DOUBLE) / ({' + '.join(hits)})"


_SCORES_SQL = f"""{PARTS_SQL},
sentiment AS (
  SELECT conversation_hash, lang, {", ".join(
      f"{_score_sql(f'lines[{i + 1}]', c)} AS {s}_{side}_sentiment"
      for i, side in enumerate(sentiment.SIDES) for s, c in zip(SENTIMENTS, "ean")
  )}
  FROM parts
)"""


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return analysis_names(documents_corpus(spark, folder)).drop("openai_moderation")


@query(
    "first_messages",
    f"""WITH {PARTS_SQL}
SELECT conversation_hash, md5(lines[1]) AS first_user_message, md5(lines[2]) AS first_assistant_message
FROM parts""",
)
def first_messages_query(spark: SparkSession, folder: str) -> DataFrame:
    return first_messages(corpus(spark, folder)).select(
        "conversation_hash",
        F.md5("first_user_message").alias("first_user_message"),
        F.md5("first_assistant_message").alias("first_assistant_message"),
    )


_ROW_SQL = f"""WITH {_SCORES_SQL}
SELECT conversation_hash, {", ".join(f"round({c}, 9) AS {c}" for c in sentiment.SCORES)} FROM sentiment"""


@query("sentiment_scores", _ROW_SQL)
def sentiment_scores(spark: SparkSession, folder: str) -> DataFrame:
    df = sentiment.score_columns(sentiment.add_sentiment(corpus(spark, folder)))
    return rounded(df.select("conversation_hash", *sentiment.SCORES), 9)


@query("sentiment_batch_model", _ROW_SQL)
def sentiment_batch_model(spark: SparkSession, folder: str) -> DataFrame:
    """The same scores from a model that runs in Arrow batches."""
    df = sentiment.add_sentiment(corpus(spark, folder), make_predict_fn=letter_sentiment)
    return rounded(sentiment.score_columns(df).select("conversation_hash", *sentiment.SCORES), 9)


@query("sentiment_resumed", _ROW_SQL)
def sentiment_resumed(spark: SparkSession, folder: str) -> DataFrame:
    """The same scores from a run that ends after one part and is started again."""

    def score(df: DataFrame) -> DataFrame:
        found = sentiment.score_columns(sentiment.add_sentiment(df, make_predict_fn=letter_sentiment))
        return rounded(found.select("conversation_hash", *sentiment.SCORES), 9)

    source = write_corpus(corpus(spark, folder), new_path(spark, "to-score"))
    path = new_path(spark, "scored")
    scored_in_parts(spark, source, score, path, most_parts=1)
    return scored_in_parts(spark, source, score, path)


_CUT_SQL = ", ".join(
    f"length(head) - length(replace(head, '{c}', '')) + 1 AS h{i}" for i, c in enumerate("ean")
)


@query(
    "sentiment_of_first_tokens",
    f"""SELECT doc_id, {", ".join(f"round(h{i} / (h0 + h1 + h2), 9) AS {name}" for i, name in enumerate(SENTIMENTS))}
FROM (SELECT doc_id, {_CUT_SQL} FROM (SELECT doc_id, left(text, {MAX_TOKENS}) AS head FROM documents))""",
)
def sentiment_of_first_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of every document by a model that reads its first 512 tokens, in batches of about
    one length."""
    scores = token_scores(character_ids, letter_sentiment_of_ids, F.col("text"))
    df = table(spark, folder, "documents").select("doc_id", scores.alias("s"))
    return rounded(df.select("doc_id", *(F.get("s", F.lit(i)).alias(c) for i, c in enumerate(SENTIMENTS))), 9)


def _aggregates_sql(counts: bool) -> str:
    parts = []
    for c in sentiment.SCORES:
        parts.append(f"round(avg({c}), 7) AS {c}_avg, round(stddev_samp({c}), 7) AS {c}_std")
        if counts:
            parts.append(f"count({c}) AS {c}_count")
    for s in SENTIMENTS:
        parts.append(
            f"round(avg({s}_assistant_sentiment) - avg({s}_user_sentiment), 7) AS {s}_diff"
        )
    return ", ".join(parts)


@query(
    "sentiment_by_language",
    f"WITH {_SCORES_SQL} SELECT lang, {_aggregates_sql(True)} FROM sentiment GROUP BY lang",
)
def sentiment_by_language(spark: SparkSession, folder: str) -> DataFrame:
    df = sentiment.score_columns(sentiment.add_sentiment(corpus(spark, folder)))
    return rounded(sentiment.by_language(df), 7)


@query("sentiment_overall", f"WITH {_SCORES_SQL} SELECT {_aggregates_sql(False)} FROM sentiment")
def sentiment_overall(spark: SparkSession, folder: str) -> DataFrame:
    df = sentiment.score_columns(sentiment.add_sentiment(corpus(spark, folder)))
    return rounded(sentiment.overall(df), 7)


@query(
    "sentiment_bars",
    f"""WITH {_SCORES_SQL} SELECT lang, {", ".join(
        f"round(avg({s}_user_sentiment), 7) AS {s}_user_sentiment_avg, "
        f"count({s}_user_sentiment) AS {s}_user_sentiment_count" for s in SENTIMENTS
    )} FROM sentiment GROUP BY lang""",
)
def sentiment_bars(spark: SparkSession, folder: str) -> DataFrame:
    df = sentiment.score_columns(sentiment.add_sentiment(corpus(spark, folder)))
    return rounded(sentiment.bars(sentiment.by_language(df)), 7)
