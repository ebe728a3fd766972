"""Queries: annotation queue and translation prompts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tertulia.catalog.registry import query
from tertulia.catalog.tables import (
    LABELLED_SQL,
    PARTS_SQL,
    documents_corpus,
    satisfaction,
    shuffle_key_sql,
)
from tertulia.operators.annotate import (
    annotation_queue,
    parsed_translations,
    prompts,
    translate,
    unannotated,
    unannotated_prefiltered,
)
from tertulia.operators.messages import triples


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return documents_corpus(spark, folder).drop("openai_moderation")


def done(spark: SparkSession, folder: str) -> DataFrame:
    """Triples of the documents that have a label."""
    return triples(corpus(spark, folder)).join(satisfaction(spark, folder), "doc_id", "left_semi")


_DONE_SQL = f"""{LABELLED_SQL}, {PARTS_SQL},
done AS (
  SELECT DISTINCT lines[1:3] AS triple FROM parts JOIN labelled ON parts.doc_id = labelled.doc_id
  WHERE satisfaction_label IS NOT NULL AND len(lines) >= 3
)"""


_REST_SQL = f"""WITH {_DONE_SQL}
SELECT conversation_hash, lang AS language FROM parts
WHERE len(lines) >= 3 AND lines[1:3] NOT IN (SELECT triple FROM done)"""


@query("unannotated_triples", _REST_SQL)
def unannotated_triples(spark: SparkSession, folder: str) -> DataFrame:
    rest = unannotated(triples(corpus(spark, folder)), done(spark, folder))
    return rest.select("conversation_hash", "language")


@query("unannotated_triples_prefiltered", _REST_SQL)
def unannotated_triples_prefiltered(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows; only those a Bloom filter lets through are shuffled."""
    rest = unannotated_prefiltered(triples(corpus(spark, folder)), done(spark, folder))
    return rest.select("conversation_hash", "language")


@query(
    "annotation_queue",
    f"""WITH {_DONE_SQL},
sampled AS (
  SELECT * FROM parts
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {shuffle_key_sql("conversation_hash")}) <= 60
)
SELECT conversation_hash, lang AS language FROM sampled
WHERE len(lines) >= 3 AND lines[1:3] NOT IN (SELECT triple FROM done)""",
)
def annotation_queue_query(spark: SparkSession, folder: str) -> DataFrame:
    queue = annotation_queue(
        corpus(spark, folder), done(spark, folder), F.col("conversation_hash"), per_language=60
    )
    return queue.select("conversation_hash", "language")


def prompt_length_model():
    """Stand-in translator: repeats the prompt and adds its length."""

    def predict(texts: np.ndarray) -> np.ndarray:
        return np.array([f"{t} \n[{len(t)}] " for t in texts], dtype=object)

    return predict


@query(
    "prompt_and_parse",
    f"""WITH {PARTS_SQL},
prompt AS (
  SELECT conversation_hash, list_transform(lines[1:3], lambda s:
         concat(lang, ': ', left(s, 200), ' English:')) AS prompts
  FROM parts WHERE len(lines) >= 3
)
SELECT conversation_hash, {", ".join(
    f"md5(prompts[{i}]) AS prompt_{i}, concat('[', length(prompts[{i}]), ']') AS parsed_{i}"
    for i in (1, 2, 3)
)}, 'user,assistant,user' AS roles FROM prompt""",
)
def prompt_and_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts, generated text of a stand-in model, text after the marker."""
    df = parsed_translations(translate(prompts(triples(corpus(spark, folder))), prompt_length_model))
    return df.selectExpr(
        "conversation_hash",
        *[f"md5(prompts[{i}]) AS prompt_{i + 1}" for i in range(3)],
        *[f"chat_triples_in_english[{i}].content AS parsed_{i + 1}" for i in range(3)],
        "array_join(chat_triples_in_english.role, ',') AS roles",
    )
