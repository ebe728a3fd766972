"""Preparation of raw conversation tables: harmonise, clean, count, filter.

Every step is a narrow projection or filter over one row, so the whole
preparation of a corpus is a single scan without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tertulia.functions.arrays import let, message
from tertulia.functions.text import word_count
from tertulia.operators.columns import without
from tertulia.schema import CATEGORIES, CORPUS, LANGUAGE_REGIONS

# Columns of the first raw source that no analysis reads.
UNUSED_COLUMNS = [
    "timestamp",
    "toxic",
    "state",
    "country",
    "hashed_ip",
    "header",
    "detoxify_moderation",
]


def slim_messages(conversation: Column) -> Column:
    """Keep only content and role of each message."""
    return F.transform(
        conversation,
        lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")),
    )


def harmonise(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Bring one raw source to the corpus columns and order."""
    df = without(df, *UNUSED_COLUMNS).withColumnsRenamed(renames or {})
    df = df.withColumn("conversation", slim_messages(F.col("conversation")))
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    # a cast of a nested column copies it element by element, even if only nullability differs
    return df.select(
        [
            F.col(f.name)
            if types[f.name] == f.dataType.simpleString()
            else F.col(f.name).cast(f.dataType).alias(f.name)
            for f in CORPUS.fields
        ]
    )


def union_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other)
    return first


def _moderation_broken(moderation: Column) -> Column:
    """Whether any message of the row carries no category maps at all."""
    return F.exists(
        moderation, lambda m: m["categories"].isNull() | m["category_scores"].isNull()
    )


def _known(entry: Column, name: str) -> Column:
    return F.map_filter(entry[name], lambda key, _: key.isin(CATEGORIES))


def _reduced(moderation: Column) -> Column:
    """Known categories only, message by message."""
    return F.transform(
        moderation,
        lambda m: F.struct(
            _known(m, "categories").alias("categories"),
            _known(m, "category_scores").alias("category_scores"),
            m["flagged"].alias("flagged"),
        ),
    )


def keep_known_categories(moderation: Column) -> Column:
    """Drop unknown category keys; a row with a missing map gets empty maps throughout."""
    emptied = F.transform(
        moderation,
        lambda m: F.struct(
            F.create_map().cast("map<string,boolean>").alias("categories"),
            F.create_map().cast("map<string,double>").alias("category_scores"),
            m["flagged"].alias("flagged"),
        ),
    )
    return F.when(_moderation_broken(moderation), emptied).otherwise(_reduced(moderation))


def scores_complete(moderation: Column) -> Column:
    """Whether no known score of any message is null; an empty list is complete."""
    return ~F.exists(
        moderation,
        lambda m: F.size(
            F.map_filter(m["category_scores"], lambda k, v: v.isNull() & k.isin(CATEGORIES))
        )
        > 0,
    )


def moderation_state(moderation: Column) -> Column:
    """``invalid`` (a map is missing), ``null_score`` or ``ok``: why a row is kept or not."""

    def state(entries: Column) -> Column:
        return (
            F.when(entries.isNull() | _moderation_broken(entries), "invalid")
            .when(~scores_complete(entries), "null_score")
            .otherwise("ok")
        )

    return let(moderation, state)


def clean_moderation(df: DataFrame) -> DataFrame:
    """Keep rows with usable scores, reduced to the known categories."""
    # null-safe equality: a plain one makes the optimizer test the state for null as well,
    # which evaluates it twice
    return df.where(moderation_state(F.col("openai_moderation")).eqNullSafe("ok")).withColumn(
        "openai_moderation", _reduced(F.col("openai_moderation"))
    )


def role_words(conversation: Column, role: str) -> Column:
    """Words in all messages of one role.

    Joining the texts with a blank and counting once is the same as summing the
    counts per message, and leaves the counting in generated code.
    """
    texts = F.filter(conversation, lambda m: m["role"] == role)["content"]
    return word_count(F.array_join(texts, " "))


def opens_with_user(conversation: Column, min_words: int = 5) -> Column:
    """First message is the user's and long enough; empty conversations fail."""
    first = message(conversation, 0)
    return (first["role"] == "user") & (word_count(first["content"]) >= min_words)


def add_lengths(df: DataFrame) -> DataFrame:
    conversation = F.col("conversation")
    return df.withColumns(
        {
            "num_user_words": role_words(conversation, "user"),
            "num_assistant_words": role_words(conversation, "assistant"),
            "num_messages": F.coalesce(F.size(conversation), F.lit(0)).cast("long"),
        }
    )


def european(df: DataFrame, column: str = "language") -> DataFrame:
    """Rows in one of the analysed languages; a null language is dropped.

    An ``IN`` list of literals is pushed to the Parquet scan, a join would not be.
    """
    return df.where(F.col(column).isin(list(LANGUAGE_REGIONS)))


def prepare(df: DataFrame, min_words: int = 5) -> DataFrame:
    """Clean scores, drop conversations with a short or foreign first turn, count words."""
    df = clean_moderation(df).where(opens_with_user(F.col("conversation"), min_words))
    return add_lengths(df)
