"""Queries: lengths per language and their correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tertulia.catalog.registry import query
from tertulia.catalog.tables import (
    LANG_SQL,
    MEASURED_SQL,
    conversation_measures,
    languages,
    t_two_sided_sql,
    table,
    words_sql,
)
from tertulia.functions.text import word_count
from tertulia.operators.aggregate import category_codes, five_numbers
from tertulia.operators.correlation import correlations
from tertulia.operators.distribution import AUTO, at_or_above_quantile
from tertulia.plans import length


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns, so that two engines' summation orders compare equal."""
    return df.selectExpr(
        *[
            f"round(`{f.name}`, {digits}) AS `{f.name}`"
            if f.dataType.typeName() == "double"
            else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )


@query(
    "conversations_per_language",
    f"WITH {MEASURED_SQL} SELECT lang, count(*) AS num_examples_count FROM measured GROUP BY lang",
)
def conversations_per_language(spark: SparkSession, folder: str) -> DataFrame:
    return length.conversations_per_language(conversation_measures(spark, folder))


@query(
    "length_per_language",
    f"""WITH {MEASURED_SQL}
SELECT lang, {", ".join(
    f"round(avg({c}), 6) AS avg_{c}, round(stddev_samp({c}), 6) AS std_{c}" for c in length.LENGTHS
)} FROM measured GROUP BY lang""",
)
def length_per_language(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(length.length_per_language(conversation_measures(spark, folder)))


@query(
    "conversations_bar",
    f"""WITH {MEASURED_SQL}
SELECT lang, count(*) AS num_examples_count, round(log10(count(*)), 6) AS log10_num_examples_count
FROM measured GROUP BY lang""",
)
def conversations_bar(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(length.conversations_bar(conversation_measures(spark, folder)))


_WORD_MEANS_SQL = f"""{MEASURED_SQL},
means AS (
  SELECT lang, avg(num_user_words) AS num_user_words, avg(num_assistant_words) AS num_assistant_words,
         count(*) AS num_examples
  FROM measured GROUP BY lang
)"""


def _scatter_sql(q: float) -> str:
    return f"""WITH {_WORD_MEANS_SQL},
placed AS (SELECT num_examples AS v, row_number() OVER (ORDER BY num_examples) - 1 AS i,
                  count(*) OVER () AS n FROM means),
cut AS (SELECT v FROM placed WHERE i = CAST(floor((n - 1) * CAST({q} AS DOUBLE) + 0.5) AS BIGINT))
SELECT lang, round(num_user_words, 6) AS num_user_words,
       round(num_assistant_words, 6) AS num_assistant_words, num_examples
FROM means WHERE num_examples >= (SELECT v FROM cut)"""


@query("words_vs_conversations", _scatter_sql(0.0))
def words_vs_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(length.words_scatter(conversation_measures(spark, folder), 0.0))


@query("user_vs_assistant_words", _scatter_sql(0.9))
def user_vs_assistant_words(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(length.words_scatter(conversation_measures(spark, folder), 0.9))


@query(
    "documents_above_quantile",
    """WITH placed AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i,
                  count(*) OVER () AS n FROM documents),
cut AS (SELECT v FROM placed WHERE i = CAST(floor((n - 1) * CAST(0.95 AS DOUBLE) + 0.5) AS BIGINT))
SELECT doc_id, n_chars FROM documents WHERE n_chars >= (SELECT v FROM cut)""",
)
def documents_above_quantile(spark: SparkSession, folder: str) -> DataFrame:
    """The quantile over raw rows, with values cut into ordered buckets."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    return at_or_above_quantile(docs, "n_chars", 0.95, buckets=AUTO)


def _correlation_sql(source: str, x: str, y: str) -> str:
    p = t_two_sided_sql("r * sqrt((n - 2) / (1 - r * r))", "(n - 2)")
    return f"""SELECT method, round(r, 6) AS r, round({p}, 6) AS p_value, n FROM (
  SELECT 'pearson' AS method, corr({x}, {y}) AS r, count(*) AS n FROM {source}
  UNION ALL
  SELECT 'spearman', corr(rx, ry), count(*) FROM (
    SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx,
           rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry
    FROM {source})
)"""


@query(
    "language_correlations",
    f"WITH {_WORD_MEANS_SQL} {_correlation_sql('means', 'num_user_words', 'num_examples')}",
)
def language_correlations(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(length.words_correlations(conversation_measures(spark, folder)))


@query(
    "turn_length_correlations",
    f"""WITH t AS (SELECT turn, {words_sql("text")} AS words FROM conversations)
{_correlation_sql('t', 'turn', 'words')}""",
)
def turn_length_correlations(spark: SparkSession, folder: str) -> DataFrame:
    """Over all messages: ranks of many values, with many ties on one side."""
    turns = table(spark, folder, "conversations").select(
        "turn", word_count(F.col("text")).alias("words")
    )
    return rounded(correlations(turns, "turn", "words"))


def _five_sql(source: str, by: str, column: str) -> str:
    places = {"minimum": 0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1}
    picks = ", ".join(
        f"CAST(quantile_cont(CAST({column} AS DOUBLE), {q}) AS DOUBLE) AS {name}"
        for name, q in places.items()
    )
    return f"SELECT {by}, {picks} FROM {source} GROUP BY {by}"


@query("five_number_summary", f"WITH {MEASURED_SQL} {_five_sql('measured', 'lang', 'num_messages')}")
def five_number_summary(spark: SparkSession, folder: str) -> DataFrame:
    return length.messages_box(conversation_measures(spark, folder))


@query("five_numbers_of_events", _five_sql("events", "event_type", "value"))
def five_numbers_of_events(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles of a column with nearly as many values as rows."""
    events = table(spark, folder, "events").select("event_type", "value")
    return five_numbers(events, "event_type", "value", buckets=AUTO)


@query(
    "language_codes",
    f"""WITH langs AS (SELECT DISTINCT {LANG_SQL} AS lang FROM documents)
SELECT lang, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS index,
       (row_number() OVER (ORDER BY lang) - 1) / CAST(count(*) OVER () AS DOUBLE) AS code
FROM langs""",
)
def language_codes(spark: SparkSession, folder: str) -> DataFrame:
    return category_codes(languages(spark, folder), "lang")
