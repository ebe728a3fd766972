"""Annotation queue, translation prompts and labelling of unlabelled rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tertulia.functions.arrays import argmax
from tertulia.functions.scoring import MakePredict, batch_scores
from tertulia.functions.text import after_last_marker, translation_prompt
from tertulia.operators.bloom import blocks_for, bloom_table, with_possible
from tertulia.operators.columns import decode, ensure_column
from tertulia.operators.messages import triples
from tertulia.operators.ordering import cap_per_group
from tertulia.schema import SATISFACTION_CODES
from tertulia.sources.corpus import materialise

ROLES = ["user", "assistant", "user"]


def unannotated(candidates: DataFrame, annotated: DataFrame) -> DataFrame:
    """Candidates whose triple is not among the annotated ones.

    The hash keeps the join key short for sorting; the arrays themselves are still
    compared. Annotations are reduced to distinct triples first; which side is
    broadcast, if any, is left to their measured sizes.
    """
    key = F.xxhash64(F.to_json("chat_triples"))
    done = annotated.select(
        key.alias("_done_key"), F.col("chat_triples").alias("_done")
    ).distinct()
    keyed = candidates.withColumn("_key", key)
    same = (F.col("_key") == F.col("_done_key")) & F.col("chat_triples").eqNullSafe(F.col("_done"))
    return keyed.join(done, same, "left_anti").drop("_key")


def unannotated_prefiltered(candidates: DataFrame, annotated: DataFrame) -> DataFrame:
    """The same rows, for annotations too many to broadcast.

    The annotated triples are written once and a Bloom filter of them is broadcast. A candidate
    it rules out stays without being moved; only the others, which are the annotated ones and
    some false positives, are shuffled and compared. The candidates are read twice, so they
    should be a stored table or a narrow projection of one.
    """
    key = F.xxhash64(F.to_json("chat_triples"))
    done = materialise(
        annotated.select(key.alias("_done_key"), F.col("chat_triples").alias("_done")).distinct(), "annotated"
    )
    blocks = blocks_for(done.count())
    table = materialise(bloom_table(done, "_done_key", blocks), "annotated-filter")
    marked = with_possible(candidates.withColumn("_key", key), "_key", table, blocks, "_possible")
    same = (F.col("_key") == F.col("_done_key")) & F.col("chat_triples").eqNullSafe(F.col("_done"))
    compared = marked.where("_possible").join(done, same, "left_anti")
    return marked.where("NOT _possible").unionByName(compared).drop("_key", "_possible")


def annotation_queue(
    corpus: DataFrame, annotated: DataFrame, key: Column, per_language: int = 1000, seed: int = 42
) -> DataFrame:
    """Sampled conversations as triples that nobody has annotated yet."""
    sampled = cap_per_group(corpus, "language", key, per_language, seed)
    return unannotated(triples(sampled), annotated)


def prompts(df: DataFrame, max_chars: int = 200) -> DataFrame:
    """Add ``prompts``: one translation prompt per message of the triple."""
    return df.withColumn(
        "prompts",
        F.transform(
            "chat_triples",
            lambda m: translation_prompt(F.col("language"), m["content"], max_chars),
        ),
    )


def translate(df: DataFrame, make_predict_fn: MakePredict, batch_size: int = 32) -> DataFrame:
    """Add ``generated``: the model's text for each of the three prompts.

    A null prompt is never sent to the model and stays null.
    """

    def make_skipping_nulls():
        predict = make_predict_fn()

        def run(texts: np.ndarray) -> np.ndarray:
            texts = np.asarray(texts, dtype=object)
            known = np.array([t is not None for t in texts], dtype=bool)
            out = np.full(len(texts), None, dtype=object)
            if known.any():
                out[known] = np.asarray(predict(texts[known]), dtype=object)
            return out

        return run

    generate = predict_batch_udf(
        make_skipping_nulls, return_type=T.StringType(), batch_size=batch_size
    )
    return df.withColumn(
        "generated", F.array(*[generate(F.get("prompts", F.lit(i))) for i in range(3)])
    )


def parsed_translations(df: DataFrame) -> DataFrame:
    """Generated texts back to a triple of messages, text after the marker only."""
    parts = [
        F.struct(
            after_last_marker(F.get("generated", F.lit(i))).alias("content"),
            F.lit(role).alias("role"),
        )
        for i, role in enumerate(ROLES)
    ]
    return df.withColumn("chat_triples_in_english", F.array(*parts))


def completed(df: DataFrame) -> DataFrame:
    """Annotations with an answer; the first (only) annotator's label and its code."""
    answer = F.get(F.col("`response-satisfaction.responses`"), F.lit(0))
    return df.where(F.col("status") == "completed").withColumns(
        {"answer": answer, "label": decode(answer, SATISFACTION_CODES)}
    )


def label_missing(
    df: DataFrame, scores: Column, column: str = "satisfaction_label"
) -> DataFrame:
    """Fill ``column`` where it is null and the conversation has three messages.

    ``scores`` is a vector in class-code order; its largest entry decides. Rows that
    have a label keep it and shorter conversations stay null, in one pass.
    """
    df = ensure_column(df, column, "string")
    todo = F.col(column).isNull() & (F.size("conversation") >= 3)
    decoded = decode(argmax(scores), {code: name for name, code in SATISFACTION_CODES.items()})
    return df.withColumn(column, F.when(todo, decoded).otherwise(F.col(column)))


def label_missing_by_model(
    df: DataFrame,
    make_predict_fn: MakePredict,
    column: str = "satisfaction_label",
    batch_size: int = 900,
) -> DataFrame:
    """The same with a batch model over the three texts; other rows are sent as null."""
    df = ensure_column(df, column, "string")
    todo = F.col(column).isNull() & (F.size("conversation") >= 3)
    text = F.to_json(F.slice("conversation", 1, 3)["content"])
    return label_missing(
        df, batch_scores(make_predict_fn, F.when(todo, text), batch_size), column
    )


def label_missing_by_head(
    df: DataFrame,
    model,
    features: Callable[[DataFrame], DataFrame],
    column: str = "satisfaction_label",
) -> DataFrame:
    """The same with a fitted head; keeps ``chat_triples``, null for shorter conversations.

    ``features`` adds the head's input to a frame with ``chat_triples``, whatever these are.
    Nothing is joined: rows are scored where they are.
    """
    df = ensure_column(df, column, "string")
    kept = [c for c in df.columns if c != "chat_triples"]
    three = F.when(F.size("conversation") >= 3, F.slice("conversation", 1, 3))
    scored = model.transform(features(df.withColumn("chat_triples", three)))
    names = {code: name for name, code in SATISFACTION_CODES.items()}
    todo = F.col(column).isNull() & F.col("chat_triples").isNotNull()
    found = F.when(todo, decode(F.col("prediction").cast("int"), names)).otherwise(F.col(column))
    return scored.withColumn(column, found).select(*kept, "chat_triples")
