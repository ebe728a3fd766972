"""Raw sources to the prepared, filtered and sampled corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tertulia.operators.ordering import cap_per_group
from tertulia.operators.prepare import european, harmonise, prepare, union_sources


def corpus(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both raw sources with the same columns; the second names its key differently."""
    return union_sources(
        harmonise(first), harmonise(second, {"conversation_id": "conversation_hash"})
    )


def prepared(first: DataFrame, second: DataFrame, min_words: int = 5) -> DataFrame:
    """Prepared conversations in every language."""
    return prepare(corpus(first, second), min_words)


def prepared_european(first: DataFrame, second: DataFrame, min_words: int = 5) -> DataFrame:
    return european(prepared(first, second, min_words))


def sample_per_language(df: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """At most ``n`` conversations of each language, the same ones on every run."""
    return cap_per_group(df, "language", F.col("conversation_hash"), n, seed)
