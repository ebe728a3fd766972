"""Rows that every operator must take: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import types as T

CLASHING = (
    "score Score hits ids decoded n_shingles digest minima members node comp key block shard slot "
    "size law lang_pred n_tokens label _id _text _row __source word component_id kept"
).split()
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING if c != "Score"]
)


def long_text(words: int = 60_000, seed: int = 3) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefgh", k=draw.randint(1, 9))) for _ in range(words))


ROWS = [
    (1, "one two three four five six seven eight nine ten"),
    (2, "One TWO three four five six seven eight nine ten"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "word"),
    (7, long_text()),
    (8, "x" * 70_000),
    (1, "one two three four five six seven eight nine ten"),
    (9, "é ñ ü 漢字 🙂\x00 \x1c."),
    (None, "word"),
    (None, None),
]


def documents(spark, rows=ROWS):
    extra = tuple(f"old {c}" for c in CLASHING if c != "Score")
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")
