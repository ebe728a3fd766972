"""Message-level tables: from nested conversations or from one row per message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tertulia.functions.arrays import message
from tertulia.functions.text import word_count
from tertulia.schema import CATEGORIES, SCORE_COLUMNS


def explode_messages(df: DataFrame, *keep: str) -> DataFrame:
    """One row per message of a nested corpus, with its moderation entry and position.

    The two arrays must have the same length; a row where they differ stops the
    job instead of being padded with nulls. A row where either is null has no messages.
    """
    conversation, moderation = F.col("conversation"), F.col("openai_moderation")
    unequal = conversation.isNotNull() & moderation.isNotNull() & (
        F.size(conversation) != F.size(moderation)
    )
    checked = F.when(
        unequal, F.raise_error(F.lit("conversation and openai_moderation differ in length"))
    ).otherwise(F.arrays_zip("conversation", "openai_moderation"))
    exploded = df.select(*keep, F.posexplode(checked).alias("position", "entry"))
    return exploded.select(
        *keep,
        "position",
        F.col("entry.conversation.content").alias("message"),
        F.col("entry.conversation.role").alias("role"),
        F.col("entry.openai_moderation.category_scores").alias("category_scores"),
    )


_NAMES = ", ".join(f"'{c}'" for c in CATEGORIES)


def list_scores(df: DataFrame) -> DataFrame:
    """Replace the category map by ``scores``, a list in category order."""
    return df.selectExpr(
        *[f"`{c}`" for c in df.columns if c != "category_scores"],
        f"transform(array({_NAMES}), c -> try_element_at(category_scores, c)) AS scores",
    )


def drop_incomplete(df: DataFrame, *also: str) -> DataFrame:
    """Drop messages with a null or NaN score, or a null in the named columns.

    One predicate covers all scores: the optimizer derives constraints from each
    separate one, which takes longer than a small query when there are dozens.
    """
    complete = ["NOT exists(scores, x -> x IS NULL OR isnan(x))"]
    complete += [f"`{c}` IS NOT NULL" for c in also]
    return df.where(" AND ".join(complete))


def widen_scores(df: DataFrame) -> DataFrame:
    """One column per category, their maximum and their mean; nulls are ignored by both."""
    return df.selectExpr(
        *[f"`{c}`" for c in df.columns if c != "scores"],
        *[f"get(scores, {i}) AS `{c}`" for i, c in enumerate(SCORE_COLUMNS)],
        "array_max(scores) AS max_toxicity_score",
        """aggregate(filter(scores, x -> x IS NOT NULL), named_struct('total', 0D, 'n', 0),
             (a, x) -> named_struct('total', a.total + x, 'n', a.n + 1),
             a -> try_divide(a.total, a.n)) AS avg_toxicity_score""",
    )


def message_scores(df: DataFrame, *keep: str) -> DataFrame:
    """Nested corpus to scored messages: 11 categories, their maximum and their mean."""
    listed = list_scores(explode_messages(df, *keep))
    return widen_scores(drop_incomplete(listed, "message", "role"))


def score_vector(category_scores: Column) -> Column:
    """Scores in category order as a vector; a missing score counts as 0."""
    return F.array(
        *[
            F.coalesce(F.try_element_at(category_scores, F.lit(c)), F.lit(0.0))
            for c in CATEGORIES
        ]
    )


def message_vectors(moderation: Column) -> Column:
    """One score vector per message of a conversation."""
    return F.transform(moderation, lambda m: score_vector(m["category_scores"]))


def vectors_of_role(conversation: Column, vectors: Column, role: str) -> Column:
    """Score vectors of the messages of one role, in conversation order."""
    zipped = F.arrays_zip(conversation.alias("message"), vectors.alias("vector"))
    return F.filter(zipped, lambda z: z["message"]["role"] == role)["vector"]


def first_messages(df: DataFrame) -> DataFrame:
    """Add the first two messages as the user's and the assistant's opening text.

    The second one is taken by position whatever its role, null when there is none.
    """
    conversation = F.col("conversation")
    return df.withColumns(
        {
            "first_user_message": message(conversation, 0)["content"],
            "first_assistant_message": message(conversation, 1)["content"],
        }
    )


def triples(df: DataFrame) -> DataFrame:
    """Conversations of at least three messages, with the first three as ``chat_triples``."""
    return df.where(F.size("conversation") >= 3).withColumn(
        "chat_triples", F.slice("conversation", 1, 3)
    )


def conversation_lengths(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Lengths per conversation from a table with one row per message.

    Sums and the opening turn are all mergeable aggregates, so a conversation with
    very many messages is reduced before the shuffle and never gathered whole.
    Only the opening turn's role and word count travel, not its text.
    """
    role, words = F.col("role"), word_count(F.col("text"))
    counted = messages.select(key, "turn", "role", words.alias("words"))
    return counted.groupBy(key).agg(
        F.sum(F.when(role == "user", F.col("words")).otherwise(0)).alias("num_user_words"),
        F.sum(F.when(role == "assistant", F.col("words")).otherwise(0)).alias(
            "num_assistant_words"
        ),
        F.count(F.lit(1)).alias("num_messages"),
        F.min_by(F.struct("role", "words"), F.col("turn")).alias("opening"),
    )


def opened_by_user(lengths: DataFrame, min_words: int = 5) -> DataFrame:
    """Conversations whose opening turn is the user's and has enough words."""
    return lengths.where(
        (F.col("opening.role") == "user") & (F.col("opening.words") >= min_words)
    ).drop("opening")
