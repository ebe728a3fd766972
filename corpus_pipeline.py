"""A corpus pipeline over ``documents``: each stage keeps what the next one works on.

Every stage is written as Parquet to the shared folder and read again. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tertulia.llm.classify import UNKNOWN, fit_language, fit_quality, with_language, with_quality
from tertulia.llm.contamination import without_contaminated
from tertulia.llm.neardup import without_near_duplicates
from tertulia.llm.queries import token_digests
from tertulia.llm.store import fold, free, others, table, written

LEAST_QUALITY = 0.3


def least_language(languages: int) -> float:
    """The score below which a document is in none of the languages.

    It is the middle between the score of no language (one over their number) and that of two
    in equal parts (a half): 0.375 with four. Trained on four fifths of the learning folds of
    sf0.1, the 1,463 documents of the rest scored 0.3765 or more (the least are single words)
    and 900 mixtures of two of its texts 0.492 or more. With two languages or one nothing is
    below: every score is also that of a mixture.
    """
    return (1 / max(1, languages) + 0.5) / 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known; mixtures of two languages stay."""
    fitted = fit_language(docs.where(fold(F.col("doc_id"), 4) != 2))
    name, score = free(docs, "__language"), free(docs, "__score")
    found = with_language(docs, fitted, language=name, score=score)
    least = least_language(len(fitted[0]) if fitted else 0)
    known = (F.col(name) != UNKNOWN) & (F.col(score) >= least)
    return found.where(known).select(*others(docs, ()))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of quality."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    score = free(docs, "__score")
    found = with_quality(docs, fit_quality(docs, labels), score=score)
    return found.where(F.col(score) >= LEAST_QUALITY).select(*others(docs, ()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return without_near_duplicates(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what was encoded and decoded."""
    return token_digests(docs)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("contamination", contamination),
    ("tokens", tokens),
]

#: The first two stages are trained networks, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
