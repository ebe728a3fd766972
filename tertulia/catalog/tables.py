"""The analyses' data model derived from the given tables.

``documents`` become nested conversations, one per row: every line is a message and
the roles alternate. Nothing is shuffled for it. ``conversations`` is used as it
is, one row per message. Fields the tables lack (moderation scores, sentiment,
satisfaction) follow from the text and from ``labels`` by fixed rules that the SQL
below repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tertulia.operators.columns import decode
from tertulia.operators.messages import conversation_lengths, opened_by_user
from tertulia.schema import CATEGORIES

LETTERS = "abcdefghijk"  # one per category
LANGUAGES = {"de": "German", "en": "English", "es": "Spanish", "fr": "French"}
UNKNOWN_CATEGORY = "harassment/other"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table."""
    return table(spark, folder, name).select(*columns)


def hash_of(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def lines_as_messages(text: Column) -> Column:
    return F.transform(
        F.split(text, "\n"),
        lambda line, i: F.struct(
            line.alias("content"),
            F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"),
        ),
    )


def _moderation(then: str) -> str:
    """SQL lambda body over a message ``m``: letter shares as scores.

    ``then`` builds the entry from the share vector ``s``. It is SQL text rather than
    Columns because a plan of this many small expressions is much quicker to parse
    than to assemble call by call.
    """
    text = "m.content"
    shares = ", ".join(
        f"CASE WHEN length({text}) = 0 THEN 0D ELSE CAST(octet_length({text}) - "
        f"octet_length(replace({text}, '{x}', '')) AS DOUBLE) / length({text}) END"
        for x in LETTERS
    )
    return f"get(transform(array(array({shares})), s -> {then}), 0)"


_NAMES = "array(" + ", ".join(f"'{c}'" for c in CATEGORIES) + ")"

# a clean entry: every category scored, flagged by the first category
ENTRY = _moderation(
    f"""named_struct(
      'categories', map_from_arrays({_NAMES}, transform(s, x -> x > 0.1)),
      'category_scores', map_from_arrays({_NAMES}, s),
      'flagged', s[0] > 0.1)"""
)

# an entry as delivered: an unknown category, a null score for texts with a zero,
# no maps at all for texts with an @
RAW_ENTRY = _moderation(
    f"""named_struct(
      'categories', IF(contains(m.content, '@'), NULL,
        map_from_arrays({_NAMES}, transform(s, x -> x > 0.1))),
      'category_scores', IF(contains(m.content, '@'), NULL,
        transform_values(
          map_concat(map_from_arrays({_NAMES}, s), map('{UNKNOWN_CATEGORY}', 0D)),
          (k, v) -> IF(k = 'hate' AND contains(m.content, '0'), NULL, v))),
      'flagged', s[0] > 0.1)"""
)


def documents_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Clean nested corpus: conversation_hash, language, conversation, openai_moderation."""
    docs = texts(spark, folder, "documents", "doc_id", "lang", "text")
    nested = docs.select(
        "doc_id",
        hash_of("doc_id").alias("conversation_hash"),
        decode(F.col("lang"), LANGUAGES).alias("language"),
        lines_as_messages(F.col("text")).alias("conversation"),
    )
    return nested.withColumn("openai_moderation", F.expr(f"transform(conversation, m -> {ENTRY})"))


RAW_MODERATION = f"transform(conversation, m -> {RAW_ENTRY})"


def first_source(spark: SparkSession, folder: str) -> DataFrame:
    """Raw table with the columns of the first source, from ``documents``."""
    docs = texts(spark, folder, "documents", "doc_id", "lang", "text").select(
        F.contains("text", F.lit("@")).alias("redacted"),
        hash_of("doc_id").alias("conversation_hash"),
        F.lit("model-a").alias("model"),
        F.to_timestamp(F.lit("2024-01-01")).alias("timestamp"),
        F.transform(
            lines_as_messages(F.col("text")),
            lambda m: F.struct(
                m["content"].alias("content"), m["role"].alias("role"), F.lit("x").alias("country")
            ),
        ).alias("conversation"),
        decode(F.col("lang"), LANGUAGES).alias("language"),
    )
    size = F.size("conversation").cast("long")
    return docs.withColumns(
        {
            "turn": F.floor((size + 1) / 2).cast("long"),
            "openai_moderation": F.expr(RAW_MODERATION),
            "detoxify_moderation": F.lit(None).cast("string"),
            "toxic": F.lit(False),
            "state": F.lit("s"),
            "country": F.lit("c"),
            "hashed_ip": F.lit("i"),
            "header": F.lit("h"),
        }
    )


def second_source(spark: SparkSession, folder: str) -> DataFrame:
    """Raw table with the columns of the second source, from ``benchmark``.

    Its language is not among the analysed ones.
    """
    items = table(spark, folder, "benchmark").select(
        F.md5(F.concat(F.lit("b"), F.col("item_id").cast("string"))).alias("conversation_id"),
        F.lit("model-b").alias("model"),
        lines_as_messages(F.col("text")).alias("conversation"),
        F.lit("Esperanto").alias("language"),
        F.lit(False).alias("redacted"),
    )
    size = F.size("conversation").cast("long")
    return items.withColumns(
        {
            "turn": F.floor((size + 1) / 2).cast("long"),
            "openai_moderation": F.expr(RAW_MODERATION),
        }
    )


def languages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("conv_id"), decode(F.col("lang"), LANGUAGES).alias("lang")
    )


def conversation_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths and language of the conversations the user opens with at least 5 words."""
    messages = texts(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    lengths = conversation_lengths(messages)
    return opened_by_user(lengths).join(languages(spark, folder), "conv_id")


def satisfaction(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id with its satisfaction label, for the documents that have one."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return table(spark, folder, "labels").select(
        "doc_id",
        F.when(good & toxic, "NA").when(good, "YES").otherwise("NO").alias("satisfaction_label"),
    )


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, lang, satisfaction_label) of all documents, null where unlabelled."""
    docs = table(spark, folder, "documents").select(
        "doc_id", decode(F.col("lang"), LANGUAGES).alias("lang")
    )
    return docs.join(satisfaction(spark, folder), "doc_id", "left")


# ---- the same derivations as SQL fragments -------------------------------------

LANG_SQL = (
    "CASE lang "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items())
    + " END"
)


def share_sql(letter: str, text: str = "content") -> str:
    return (
        f"(CASE WHEN length({text}) = 0 THEN 0.0 ELSE CAST(length({text}) - "
        f"length(replace({text}, '{letter}', '')) AS DOUBLE) / length({text}) END)"
    )


def words_sql(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> ''))"


PARTS_SQL = f"""parts AS (
  SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS conversation_hash, {LANG_SQL} AS lang, n_chars,
         string_split(text, chr(10)) AS lines
  FROM documents
)"""

MESSAGES_SQL = f"""{PARTS_SQL},
msg AS (
  SELECT *, CASE WHEN position % 2 = 0 THEN 'user' ELSE 'assistant' END AS role
  FROM (SELECT doc_id, conversation_hash, lang, n_chars, unnest(lines) AS content,
               generate_subscripts(lines, 1) - 1 AS position FROM parts)
)"""

_SCORES = ", ".join(f'{share_sql(x)} AS "{c}_score"' for x, c in zip(LETTERS, CATEGORIES))
_ALL = [f'"{c}_score"' for c in CATEGORIES]
SCORED_SQL = f"""{MESSAGES_SQL},
score AS (SELECT conversation_hash, lang, position, role, content, {_SCORES} FROM msg),
scored AS (
  SELECT *, greatest({", ".join(_ALL)}) AS max_toxicity_score,
         ({" + ".join(_ALL)}) / 11 AS avg_toxicity_score
  FROM score
)"""

MEASURED_SQL = f"""turns AS (
  SELECT conv_id, turn, role, {words_sql("text")} AS words FROM conversations
),
lengths AS (
  SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN words ELSE 0 END) AS BIGINT) AS num_user_words,
         CAST(sum(CASE WHEN role = 'assistant' THEN words ELSE 0 END) AS BIGINT) AS num_assistant_words,
         count(*) AS num_messages, arg_min(role, turn) AS opening_role, arg_min(words, turn) AS opening_words
  FROM turns GROUP BY conv_id
),
measured AS (
  SELECT conv_id, {LANG_SQL} AS lang, num_user_words, num_assistant_words, num_messages
  FROM lengths JOIN documents ON doc_id = conv_id
  WHERE opening_role = 'user' AND opening_words >= 5
)"""

LABELLED_SQL = f"""labelled AS (
  SELECT d.doc_id, {LANG_SQL} AS lang,
         CASE WHEN quality = 1 AND toxic = 1 THEN 'NA' WHEN quality = 1 THEN 'YES'
              WHEN l.doc_id IS NOT NULL THEN 'NO' END AS satisfaction_label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def chi2_sf_sql(x: str, df: str) -> str:
    """Upper chi-squared tail: 1 minus the power series of the lower incomplete gamma."""
    h = f"(greatest({x}, 1e-300) / 2)"
    a = f"(({df}) / 2.0)"
    return (
        f"(CASE WHEN ({df}) = 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform("
        f"range(0, CAST(300 + {x} AS BIGINT)), "
        f"lambda i: exp(({a} + i) * ln({h}) - {h} - lgamma({a} + i + 1))))) END)"
    )


def t_two_sided_sql(t: str, df: str) -> str:
    """Two-sided Student tail: series of the incomplete beta at df / (df + t * t)."""
    x = f"(({df}) / (({df}) + ({t}) * ({t})))"
    a = f"(({df}) / 2.0)"
    return (
        f"least(1.0, exp({a} * ln({x}) + 0.5 * ln(1 - {x}) + lgamma({a} + 0.5) - lgamma({a}) "
        f"- lgamma(0.5)) / {a} * (1 + list_sum(list_transform(range(0, 20000), lambda i: "
        f"exp(lgamma({a} + 1) + lgamma(i + 1) - lgamma({a} + i + 2) "
        f"- (lgamma({a} + 0.5) + lgamma(i + 1) - lgamma({a} + i + 1.5)) + (i + 1) * ln({x}))))))"
    )


def shuffle_key_sql(key: str, seed: int = 42) -> str:
    return f"md5(concat(CAST({key} AS VARCHAR), '|{seed}'))"


def hash_number_sql(key: str, digits: int = 8, seed: int = 42) -> str:
    return f"CAST(concat('0x', left({shuffle_key_sql(key, seed)}, {digits})) AS BIGINT)"
