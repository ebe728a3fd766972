"""Messages and words per conversation, by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tertulia.operators.aggregate import count_per_group, five_numbers, mean_and_std
from tertulia.operators.charts import log_bars
from tertulia.operators.correlation import correlations
from tertulia.operators.distribution import at_or_above_quantile

LENGTHS = ["num_messages", "num_user_words", "num_assistant_words"]


def conversations_per_language(df: DataFrame) -> DataFrame:
    counts = count_per_group(df, "lang", "num_examples_count")
    return counts.orderBy(F.desc("num_examples_count"), "lang")


def conversations_bar(df: DataFrame) -> DataFrame:
    return log_bars(conversations_per_language(df), "num_examples_count")


def length_per_language(df: DataFrame) -> DataFrame:
    return mean_and_std(df, ["lang"], LENGTHS).orderBy("lang")


def messages_box(df: DataFrame) -> DataFrame:
    """Five-number summary of messages per conversation."""
    return five_numbers(df, "lang", "num_messages")


def word_means(df: DataFrame) -> DataFrame:
    """Mean words and number of conversations per language, in one aggregation."""
    return df.groupBy("lang").agg(
        F.avg("num_user_words").alias("num_user_words"),
        F.avg("num_assistant_words").alias("num_assistant_words"),
        F.count(F.lit(1)).alias("num_examples"),
    ).where(F.col("lang").isNotNull())


def words_scatter(df: DataFrame, q: float) -> DataFrame:
    """Word means of the languages at or above a quantile of the conversation count."""
    return at_or_above_quantile(word_means(df), "num_examples", q)


def words_correlations(df: DataFrame) -> DataFrame:
    """Correlation of mean user words with the conversation count over languages."""
    return correlations(word_means(df), "num_user_words", "num_examples", buckets=None)
