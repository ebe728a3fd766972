"""Queries: sources, cleaning, preparation, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tertulia.catalog.registry import query
from tertulia.catalog.tables import (
    LANG_SQL,
    LANGUAGES,
    MEASURED_SQL,
    MESSAGES_SQL,
    PARTS_SQL,
    conversation_measures,
    documents_corpus,
    first_source,
    hash_of,
    second_source,
    share_sql,
    shuffle_key_sql,
    table,
    words_sql,
)
from tertulia.functions.text import word_count
from tertulia.operators.columns import analysis_names, decode, ensure_column, region, without
from tertulia.operators.messages import triples
from tertulia.operators.ordering import cap_per_group, positions
from tertulia.operators.prepare import (
    add_lengths,
    clean_moderation,
    european,
    moderation_state,
    opens_with_user,
)
from tertulia.plans.preparation import corpus, prepared, prepared_european
from tertulia.schema import CATEGORIES, LANGUAGE_REGIONS
from tertulia.sources.corpus import materialise


def digest(conversation: Column) -> Column:
    """One hash for the roles and texts of a whole conversation."""
    lines = F.transform(conversation, lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return F.md5(F.array_join(lines, "\n"))


_LINES = "string_split(text, chr(10))"


def _digest_sql(lines: str = _LINES) -> str:
    return (
        f"md5(array_to_string(list_transform({lines}, lambda s, i: "
        "concat(CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', s)), chr(10)))"
    )


# both raw sources with one row per conversation, and per message
_BOTH_SQL = f"""both_sources AS (
  SELECT md5(CAST(doc_id AS VARCHAR)) AS conversation_hash, 'model-a' AS model, text,
         contains(text, '@') AS redacted, {LANG_SQL} AS language FROM documents
  UNION ALL
  SELECT md5(concat('b', CAST(item_id AS VARCHAR))), 'model-b', text, false, 'Esperanto'
  FROM benchmark
),
states AS (
  SELECT *, CASE WHEN contains(text, '@') THEN 'invalid' WHEN contains(text, '0') THEN 'null_score'
                 ELSE 'ok' END AS state
  FROM both_sources
),
lines AS (
  SELECT *, CASE WHEN position % 2 = 0 THEN 'user' ELSE 'assistant' END AS role
  FROM (SELECT conversation_hash, language, state, unnest({_LINES}) AS content,
               generate_subscripts({_LINES}, 1) - 1 AS position FROM states)
)"""


@query(
    "harmonised_corpus",
    f"""WITH {_BOTH_SQL}
SELECT conversation_hash, model, CAST((len({_LINES}) + 1) // 2 AS BIGINT) AS turn, redacted, language,
       CAST(len({_LINES}) AS BIGINT) AS messages, {_digest_sql()} AS digest
FROM states""",
)
def harmonised_corpus(spark: SparkSession, folder: str) -> DataFrame:
    df = corpus(first_source(spark, folder), second_source(spark, folder))
    return df.select(
        "conversation_hash",
        "model",
        "turn",
        "redacted",
        "language",
        F.size("conversation").cast("long").alias("messages"),
        digest(F.col("conversation")).alias("digest"),
    )


@query(
    "moderation_states",
    f"""WITH {_BOTH_SQL}
SELECT language, state, count(*) AS conversations FROM states GROUP BY language, state""",
)
def moderation_states(spark: SparkSession, folder: str) -> DataFrame:
    df = corpus(first_source(spark, folder), second_source(spark, folder))
    state = moderation_state(F.col("openai_moderation")).alias("state")
    return df.groupBy("language", state).agg(F.count(F.lit(1)).alias("conversations"))


@query(
    "valid_moderation",
    f"""WITH {_BOTH_SQL}
SELECT conversation_hash, count(*) AS messages, CAST({len(CATEGORIES)} AS INTEGER) AS kept_categories,
       count(*) FILTER ({share_sql("a")} > 0.1) AS flagged_messages,
       round(sum({share_sql("b")}), 6) AS threat_score
FROM lines WHERE state = 'ok' GROUP BY conversation_hash""",
)
def valid_moderation(spark: SparkSession, folder: str) -> DataFrame:
    df = clean_moderation(corpus(first_source(spark, folder), second_source(spark, folder)))
    moderation = F.col("openai_moderation")
    threat = F.aggregate(
        moderation,
        F.lit(0.0),
        lambda acc, m: acc + F.try_element_at(m["category_scores"], F.lit(CATEGORIES[1])),
    )
    return df.select(
        "conversation_hash",
        F.size(moderation).cast("long").alias("messages"),
        F.size(F.get(moderation, F.lit(0))["category_scores"]).alias("kept_categories"),
        F.size(F.filter(moderation, lambda m: m["flagged"])).cast("long").alias("flagged_messages"),
        F.round(threat, 6).alias("threat_score"),
    )


_LANGUAGE_LIST_SQL = ", ".join(f"'{x}'" for x in LANGUAGE_REGIONS)


@query(
    "european_languages",
    f"""WITH {_BOTH_SQL},
regions AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in LANGUAGE_REGIONS.items())})
            AS r(language, region))
SELECT s.language, r.region, count(*) AS conversations
FROM states s JOIN regions r ON s.language = r.language GROUP BY s.language, r.region""",
)
def european_languages(spark: SparkSession, folder: str) -> DataFrame:
    df = european(corpus(first_source(spark, folder), second_source(spark, folder)))
    return df.groupBy("language", region(F.col("language")).alias("region")).agg(
        F.count(F.lit(1)).alias("conversations")
    )


def _prepared_sql(where: str) -> str:
    return f"""WITH {_BOTH_SQL},
counted AS (SELECT *, {words_sql("content")} AS words FROM lines WHERE state = 'ok')
SELECT conversation_hash, language,
       CAST(sum(CASE WHEN role = 'user' THEN words ELSE 0 END) AS BIGINT) AS num_user_words,
       CAST(sum(CASE WHEN role = 'assistant' THEN words ELSE 0 END) AS BIGINT) AS num_assistant_words,
       count(*) AS num_messages
FROM counted GROUP BY conversation_hash, language
HAVING max(CASE WHEN position = 0 THEN words END) >= 5 {where}"""


_PREPARED_COLUMNS = [
    "conversation_hash",
    "language",
    "num_user_words",
    "num_assistant_words",
    "num_messages",
]


@query("prepared_conversations", _prepared_sql(""))
def prepared_conversations(spark: SparkSession, folder: str) -> DataFrame:
    df = prepared(first_source(spark, folder), second_source(spark, folder))
    return df.select(*_PREPARED_COLUMNS)


@query("prepared_european", _prepared_sql(f"AND language IN ({_LANGUAGE_LIST_SQL})"))
def prepared_european_query(spark: SparkSession, folder: str) -> DataFrame:
    df = prepared_european(first_source(spark, folder), second_source(spark, folder))
    return df.select(*_PREPARED_COLUMNS)


@query(
    "prepared_from_messages",
    f"""WITH {MEASURED_SQL}
SELECT conv_id, lang, num_user_words, num_assistant_words, num_messages FROM measured""",
)
def prepared_from_messages(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_measures(spark, folder).select(
        "conv_id", "lang", "num_user_words", "num_assistant_words", "num_messages"
    )


@query(
    "opening_message_rule",
    f"""WITH {MESSAGES_SQL}
SELECT lang, CAST(max(CASE WHEN {words_sql("content")} >= 5 THEN 1 ELSE 0 END) AS INTEGER) AS any_kept,
       count(*) AS conversations,
       count(*) FILTER ({words_sql("content")} >= 5) AS kept
FROM msg WHERE position = 0 GROUP BY lang""",
)
def opening_message_rule(spark: SparkSession, folder: str) -> DataFrame:
    """How many conversations of each language pass the opening rule."""
    df = analysis_names(documents_corpus(spark, folder))
    ok = opens_with_user(F.col("conversation"))
    return df.groupBy("lang").agg(
        F.max(ok.cast("int")).alias("any_kept"),
        F.count(F.lit(1)).alias("conversations"),
        F.count_if(ok).alias("kept"),
    )


@query(
    "word_counts",
    f"""SELECT doc_id, CAST({words_sql("text")} AS BIGINT) AS words FROM documents""",
)
def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", word_count(F.col("text")).alias("words"))


@query(
    "cap_per_language",
    f"""SELECT md5(CAST(doc_id AS VARCHAR)) AS conversation_hash, {LANG_SQL} AS language
FROM documents
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {shuffle_key_sql("md5(CAST(doc_id AS VARCHAR))")}) <= 100""",
)
def cap_per_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        hash_of("doc_id").alias("conversation_hash"),
        decode(F.col("lang"), LANGUAGES).alias("language"),
    )
    return cap_per_group(docs, "language", F.col("conversation_hash"), 100)


@query(
    "shuffle_positions",
    f"""SELECT doc_id, row_number() OVER (ORDER BY {shuffle_key_sql("doc_id")}) - 1 AS position
FROM documents""",
)
def shuffle_positions(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    return positions(docs, F.col("doc_id"))


@query(
    "triples",
    f"""WITH {PARTS_SQL}
SELECT conversation_hash, CAST(3 AS INTEGER) AS messages, {_digest_sql("lines[1:3]")} AS digest
FROM parts WHERE len(lines) >= 3""",
)
def triples_query(spark: SparkSession, folder: str) -> DataFrame:
    return triples(documents_corpus(spark, folder)).select(
        "conversation_hash",
        F.size("chat_triples").alias("messages"),
        digest(F.col("chat_triples")).alias("digest"),
    )


@query(
    "corpus_roundtrip",
    f"""WITH {MESSAGES_SQL}
SELECT lang, count(DISTINCT conversation_hash) AS conversations, count(*) AS messages,
       CAST(sum({words_sql("content")}) AS BIGINT) AS words
FROM msg GROUP BY lang""",
)
def corpus_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The nested corpus written to the shared folder, read back and counted."""
    stored = materialise(add_lengths(documents_corpus(spark, folder)), "corpus")
    return analysis_names(stored).groupBy("lang").agg(
        F.count(F.lit(1)).alias("conversations"),
        F.sum("num_messages").alias("messages"),
        F.sum(F.col("num_user_words") + F.col("num_assistant_words")).alias("words"),
    )


@query(
    "column_surgery",
    f"""SELECT doc_id, {LANG_SQL} AS language, 'unknown' AS country,
       CAST(NULL AS VARCHAR) AS satisfaction_label
FROM documents""",
)
def column_surgery(spark: SparkSession, folder: str) -> DataFrame:
    """All columns but some, one renamed and replaced, missing ones added."""
    docs = without(table(spark, folder, "documents"), "text", "n_chars", "source")
    docs = docs.withColumnRenamed("lang", "language")
    docs = docs.withColumn("language", decode(F.col("language"), LANGUAGES))
    docs = ensure_column(docs, "country", "string", "unknown")
    return ensure_column(docs, "satisfaction_label", "string")
