"""Exact token counts under every context limit, from a histogram of encoded lengths.

Documents are counted by length once; everything else follows from suffix sums over the
distinct lengths: how many documents and tokens are at or above a length, quantiles, and
what is left when texts are cut to a limit. The sums are taken within buckets of BUCKET
lengths and over the buckets, so no task sees more than a bucket or a row per bucket.

A null text counts as empty (length 0). Repeated rows count each. An empty table gives an
empty result. Only the text column is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tertulia.llm.bpe import sent, texts_encoder
from tertulia.llm.store import with_computed, written
from tertulia.llm.words import buffers, runs

BUCKET = 1024


def with_token_count(
    docs: DataFrame, vocabulary: dict, text: str = "text", count: str = "n_tokens"
) -> DataFrame:
    """Replaces the text by the number of its byte-level BPE tokens."""
    shared = sent(docs, vocabulary)

    def make():
        encode = texts_encoder(shared.value)

        def compute(column: pa.Array):
            _, offsets = buffers(column)
            for first, last in runs(offsets, 1 << 20):
                rows = encode(column.slice(first, last - first).to_pylist())
                yield [pa.array(np.array([len(ids) // 4 for ids in rows], dtype=np.int64))]

        return compute

    return with_computed(docs, text, [T.StructField(count, T.LongType())], make, drop=(text,))


def length_table(counted: DataFrame, count: str = "n_tokens") -> DataFrame:
    """One row for each distinct length L, which answers for the context limit L.

    docs: documents of this length; docs_at_least, tokens_at_least: of this length or longer;
    docs_at_most: of this length or shorter; truncated_tokens: tokens left when every document
    is cut to L. Between two lengths the last grows linearly, by docs_at_least of the longer
    a token; see ``at_limits``.
    """
    rows = counted.groupBy(F.col(count).alias("length")).agg(F.count(F.lit(1)).alias("docs"))
    # written, as two branches read it and the texts are to be encoded once
    rows = written(rows.withColumn("_bucket", F.floor(F.col("length") / BUCKET)), "lengths")
    totals = rows.groupBy("_bucket").agg(
        F.sum("docs").alias("_docs"), F.sum(F.col("docs") * F.col("length")).alias("_tokens")
    )
    order = Window.orderBy("_bucket")  # a row per BUCKET lengths
    above = order.rowsBetween(1, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beyond = totals.select(
        "_bucket",
        F.coalesce(F.sum("_docs").over(above), F.lit(0)).alias("_docs_above"),
        F.coalesce(F.sum("_tokens").over(above), F.lit(0)).alias("_tokens_above"),
        F.sum("_docs").over(whole).alias("_all_docs"),
        F.sum("_tokens").over(whole).alias("_all_tokens"),
    )
    suffix = Window.partitionBy("_bucket").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select(
        "length",
        "docs",
        "_bucket",
        F.sum("docs").over(suffix).alias("_n"),
        F.sum(F.col("docs") * F.col("length")).over(suffix).alias("_t"),
    ).join(beyond, "_bucket")
    docs, tokens = F.col("_n") + F.col("_docs_above"), F.col("_t") + F.col("_tokens_above")
    return summed.select(
        "length",
        "docs",
        docs.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        (F.col("_all_docs") - docs + F.col("docs")).alias("docs_at_most"),
        (F.col("_all_tokens") - tokens + docs * F.col("length")).alias("truncated_tokens"),
    )


def at_limits(lengths: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_cut (longer than it) and truncated_tokens for any context limits."""
    asked = lengths.sparkSession.createDataFrame([(x,) for x in limits], "limit long")
    over = F.col("length") > F.col("limit")
    first = F.min_by("docs_at_least", F.when(over, F.col("length")))
    base = F.min_by(
        F.col("truncated_tokens") - F.col("docs_at_least") * (F.col("length") - F.col("limit")),
        F.when(over, F.col("length")),
    )
    return (
        lengths.join(F.broadcast(asked))  # the histogram times a few limits, reduced at once
        .groupBy("limit")
        .agg(
            F.coalesce(first, F.lit(0)).alias("docs_cut"),
            F.coalesce(base, F.max("truncated_tokens")).alias("truncated_tokens"),
        )
    )


def quantile(lengths: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share q of the documents does not exceed."""
    total = lengths.agg(F.max("docs_at_most")).first()[0]
    if total is None:
        return None
    return lengths.where(F.col("docs_at_most") >= q * total).agg(F.min("length")).first()[0]
