"""Language and quality of whole texts by the byte network of ``conv``.

Both are trained on the driver on a bounded sample of labelled rows (``SAMPLE`` rows at most
or one a label, texts of at most ``SAMPLE_BYTES`` bytes; a hash of the id picks them, so the
sample does not depend on how rows are stored) and then applied to every row where it is.
Null and empty texts get the score of a window of zero bytes, so never null; repeated rows
get equal scores; an empty table gives an empty result; with nothing to learn from, the
quality is 0.5 and the language ``und``. A column with the name of an output is replaced.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tertulia.llm import conv
from tertulia.llm.store import free, others, replaced, with_computed

SAMPLE, SAMPLE_BYTES = 2_400, 16_384
UNKNOWN = "und"
_SCALE = 1 << 30


def balanced(df: DataFrame, label: str, key: str, sample: int) -> DataFrame:
    """At most ``sample`` rows and a label, as many of each label, the same ones each time.

    A row without ``key`` is not taken, and a key once for each label, with its smallest values.
    """
    df = df.where(F.col(key).isNotNull())
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    if not counts:
        return df.limit(0)
    share = max(1, sample // len(counts))
    rates = df.sparkSession.createDataFrame(
        [(k, int(min(1.0, share / n) * _SCALE)) for k, n in counts.items()],
        T.StructType([T.StructField(label, df.schema[label].dataType), T.StructField("_rate", T.LongType())]),
    )  # one row per label
    draw = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(_SCALE))
    near = df.join(F.broadcast(rates), label).where(draw < 2 * F.col("_rate")).drop("_rate")
    rest = others(df, (key, label))
    least = F.min(F.struct(*rest)) if rest else F.lit(None)
    near = near.groupBy(key, label).agg(least.alias("_least")).select(key, label, *(F.col(f"_least.{c}") for c in rest))
    order = Window.partitionBy(label).orderBy(draw, key)
    return near.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= share).drop("_place")


def short(text: Column) -> Column:
    return text.isNotNull() & (F.octet_length(text) <= SAMPLE_BYTES)


def plain(model: conv.Model) -> conv.Model:
    """Without the tables that each task builds anew."""
    return replace(model, pairs=[])


def fit_language(docs: DataFrame, sample: int = SAMPLE, epochs: int = 4) -> tuple[list[str], conv.Model] | None:
    """Languages (sorted) and the network, from the columns doc_id, text and lang."""
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & short(F.col("text")))
    picked = balanced(known, "lang", "doc_id", sample)
    rows = sorted((r["lang"], r["text"]) for r in picked.select("lang", "text").collect())
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    number = {x: i for i, x in enumerate(languages)}
    order = np.random.default_rng(3).permutation(len(rows))
    labels = np.array([number[rows[i][0]] for i in order])
    shape = conv.Shape(len(languages))
    return languages, plain(conv.trained([rows[i][1] for i in order], labels, shape, epochs))


def with_language(
    docs: DataFrame,
    fitted: tuple[list[str], conv.Model] | None,
    text: str = "text",
    language: str = "lang_pred",
    score: str = "score",
) -> DataFrame:
    """Adds the likeliest language and its probability; ``und`` and 0 without any letter."""
    fields = [T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())]
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if fitted is None:
        return replaced(docs, {language: F.lit(UNKNOWN), score: F.lit(0.0)})
    languages, model = fitted
    names = np.array(languages, dtype=object)

    def make():
        ready = conv.ready(replace(model))

        def compute(column: pa.Array):
            for p in conv.scores(ready, column):
                best = p.argmax(axis=1)
                found = p[np.arange(len(p)), best].astype(np.float64)
                yield [pa.array(names[best], pa.string()), pa.array(np.clip(found, 0, 1))]

        return compute

    has = free(docs, "__letters")
    out = with_computed(replaced(docs, {has: letters}), text, fields, make)
    found = F.col(has)
    return replaced(
        out,
        {
            language: F.when(found, F.col(language)).otherwise(F.lit(UNKNOWN)),
            score: F.when(found, F.col(score)).otherwise(F.lit(0.0)),
        },
    ).drop(has)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, 0/1 labels, and the weight of each label that undoes the balancing."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("_label")).where(
        F.col("_label").isin(0, 1) & F.col("doc_id").isNotNull()
    )
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    picked = balanced(known, "_label", "doc_id", sample)  # about ``sample`` rows
    texts = docs.select("doc_id", "text").where(short(F.col("text")))
    met = texts.join(F.broadcast(picked), "doc_id")  # ``sample`` rows
    rows = met.groupBy("doc_id", "_label").agg(F.min("text").alias("text")).collect()
    rows = sorted((r["_label"], r["text"]) for r in rows)
    order = np.random.default_rng(5).permutation(len(rows))
    total = max(1, sum(counts.values()))
    weights = np.array([2 * counts.get(c, 0) / total for c in (0, 1)])
    return [rows[i][1] for i in order], np.array([rows[i][0] for i in order], dtype=int), weights


def fit_quality(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = 8
) -> conv.Model | None:
    """The network for label 1 of ``labels.quality``; None without any labelled text."""
    texts, wanted, weights = labelled_sample(docs, labels, "quality", sample)
    if not texts:
        return None
    shape = conv.Shape(2, widths=(4, 6), filters=12, with_max=True, repeats=True)
    return plain(conv.trained(texts, wanted, shape, epochs, weights=weights))


def with_quality(
    docs: DataFrame, model: conv.Model | None, text: str = "text", score: str = "score"
) -> DataFrame:
    """Adds the probability that the label is 1."""
    if model is None:
        return replaced(docs, {score: F.lit(0.5)})

    def make():
        ready = conv.ready(replace(model))

        def compute(column: pa.Array):
            for p in conv.scores(ready, column):
                yield [pa.array(np.clip(p[:, 1].astype(np.float64), 0, 1))]

        return compute

    return with_computed(docs, text, [T.StructField(score, T.DoubleType())], make)
