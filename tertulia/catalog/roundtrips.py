"""Queries: what is written can be read again, and a model can take the place of a stand-in."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tertulia.catalog.classifier import _ANNOTATED_SQL, annotated
from tertulia.catalog.length import rounded
from tertulia.catalog.registry import QUERIES, SQL, query
from tertulia.catalog.tables import documents_corpus
from tertulia.catalog.topics import WIDTH
from tertulia.catalog.toxicity import scored
from tertulia.operators.annotate import completed
from tertulia.operators.columns import analysis_names
from tertulia.plans import topics, toxicity
from tertulia.session import new_path
from tertulia.sources.corpus import read_annotations, write_corpus
from tertulia.sources.results import read_table, write_matrix, write_report, write_table


@query("result_table_roundtrip", SQL["length_per_language"])
def result_table_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The lengths per language through a CSV file."""
    df = QUERIES["length_per_language"](spark, folder)
    return read_table(spark, write_table(df, new_path(spark, "table"), ["lang"]), df.schema)


@query("matrix_roundtrip", SQL["dunn_matrix"])
def matrix_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """A square p-value matrix through a CSV file named after its measure."""
    measure = "max_toxicity_score"
    pairs = toxicity.dunn_table(toxicity.ranked_scores(scored(spark, folder), measures=[measure]))
    path = write_matrix(pairs, measure, None, new_path(spark, "matrix"))
    names = spark.read.option("header", True).csv(path).columns
    fields = ", ".join(f"`{n}` {'string' if n == 'lang' else 'double'}" for n in names)
    return rounded(spark.read.schema(fields).option("header", True).csv(path), 7)


@query("report_roundtrip", SQL["chi2_independence"])
def report_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The one row of a test through a JSON file."""
    df = QUERIES["chi2_independence"](spark, folder)
    return spark.read.schema(df.schema).json(write_report(df, new_path(spark, "report")))


@query(
    "annotations_roundtrip",
    f"""WITH {_ANNOTATED_SQL}
SELECT CASE lang WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' WHEN 'es' THEN 'Spanish'
            WHEN 'fr' THEN 'French' ELSE lang END AS language, answer, label, lines[1] AS opening
FROM annotated""",
)
def annotations_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Annotated triples through the annotation reader."""
    rows = annotated(spark, folder).drop("doc_id")
    back = read_annotations(spark, write_corpus(rows, new_path(spark, "annotations")))
    opening = F.get("chat_triples", F.lit(0))["content"].alias("opening")
    return completed(back).select("language", "answer", "label", opening)


def hashed_words_model(width: int = WIDTH):
    """A model that a worker loads, with the same vectors as ``topics.hashed_words``."""

    def load():
        def vectors(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), width))
            for i, text in enumerate(texts):
                words = text.split()
                for w in words:
                    out[i, int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % width] += 1
                out[i] /= max(1, len(words))
            return out

        return vectors

    return load


@query("embedding_batch_model", SQL["sentence_embeddings"])
def embedding_batch_model(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings of first messages by a batch model."""
    corpus = analysis_names(documents_corpus(spark, folder)).drop("openai_moderation")
    embedded = topics.embed_first_message(corpus, make_predict_fn=hashed_words_model())
    return rounded(
        embedded.selectExpr(
            "conversation_hash", *[f"sentence_embeddings[{i}] AS e{i}" for i in range(WIDTH)]
        ),
        9,
    )
