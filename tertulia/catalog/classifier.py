"""Queries: annotated triples, features, splits, baselines, metrics, trained heads."""

from __future__ import annotations

from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, functions as F

from tertulia.catalog.length import rounded
from tertulia.catalog.registry import query
from tertulia.catalog.tables import (
    LABELLED_SQL,
    PARTS_SQL,
    documents_corpus,
    hash_number_sql,
    labelled_documents,
    satisfaction,
    share_sql,
    shuffle_key_sql,
    table,
)
from tertulia.functions.arrays import argmax, doubles, pair_features
from tertulia.functions.scoring import letter_sentiment_scores
from tertulia.operators import classify
from tertulia.operators.aggregate import count_per_group, mode
from tertulia.operators.annotate import completed, label_missing_by_head
from tertulia.operators.columns import analysis_names, decode
from tertulia.operators.heads import ACTIVATIONS, HeadShape, NetworkHead, predicted_accuracy, weights_of
from tertulia.operators.messages import triples
from tertulia.operators.ordering import positions
from tertulia.operators.search import Choice, Real, search
from tertulia.plans import satisfaction as satisfaction_plan
from tertulia.plans.topics import hashed_words
from tertulia.schema import SATISFACTION_CODES
from tertulia.sources.corpus import materialise


def annotated(spark: SparkSession, folder: str) -> DataFrame:
    """Triples with a status and responses: completed where ``labels`` knows the document."""
    joined = triples(documents_corpus(spark, folder).drop("openai_moderation")).join(
        satisfaction(spark, folder), "doc_id", "left"
    )
    known = F.col("satisfaction_label").isNotNull()
    return joined.select(
        "doc_id",
        "chat_triples",
        "language",
        F.when(known, "completed").otherwise("pending").alias("status"),
        F.when(known, F.array("satisfaction_label"))
        .otherwise(F.array().cast("array<string>"))
        .alias("response-satisfaction.responses"),
    )


_ANNOTATED_SQL = f"""{LABELLED_SQL}, {PARTS_SQL},
annotated AS (
  SELECT p.doc_id, p.lang, p.lines, satisfaction_label AS answer,
         CASE satisfaction_label WHEN 'YES' THEN 1 WHEN 'NO' THEN 0 ELSE 2 END AS label
  FROM parts p JOIN labelled l ON p.doc_id = l.doc_id
  WHERE satisfaction_label IS NOT NULL AND len(lines) >= 3
)"""


@query("annotation_labels", f"WITH {_ANNOTATED_SQL} SELECT doc_id, answer, label FROM annotated")
def annotation_labels(spark: SparkSession, folder: str) -> DataFrame:
    return completed(annotated(spark, folder)).select("doc_id", "answer", "label")


@query(
    "annotated_per_language",
    f'WITH {_ANNOTATED_SQL} SELECT lang, count(*) AS "count" FROM annotated GROUP BY lang',
)
def annotated_per_language(spark: SparkSession, folder: str) -> DataFrame:
    df = analysis_names(completed(annotated(spark, folder)))
    return count_per_group(df, "lang", "count").orderBy(F.desc("count"), "lang")


@query(
    "pair_features",
    f"""WITH whole AS (SELECT vec_id, list_concat(CAST(embedding AS DOUBLE[]), [0.0, 0.0]) AS v FROM embeddings),
cut AS (SELECT vec_id, {", ".join(
        f"v[{22 * i + 1}:{22 * i + 22}] AS v{i}" for i in range(3)
    )} FROM whole),
gaps AS (SELECT vec_id, v0, v1, v2, {", ".join(
    f"list_transform(range(1, 23), lambda i: abs(v{a}[i] - v{b}[i])) AS d{k}"
    for k, (a, b) in enumerate([(1, 0), (2, 1), (2, 0)])
)} FROM cut)
SELECT vec_id, CAST(132 AS INTEGER) AS features, {", ".join(
    f"round(list_sum({c}), 7) AS s{i}, round({c}[1], 7) AS f{i}"
    for i, c in enumerate(["v0", "v1", "v2", "d0", "d1", "d2"])
)} FROM gaps""",
)
def pair_features_query(spark: SparkSession, folder: str) -> DataFrame:
    """Three 22-wide parts of a vector and two zeros as the three messages of a triple."""
    whole = F.concat(doubles(F.col("embedding")), F.array(F.lit(0.0), F.lit(0.0)))
    parts = [F.slice(whole, 22 * i + 1, 22) for i in range(3)]
    df = table(spark, folder, "embeddings").select(
        "vec_id", pair_features(*parts).alias("features")
    )
    sums = [
        f"aggregate(slice(features, {22 * i + 1}, 22), 0D, (a, x) -> a + x) AS s{i}"
        for i in range(6)
    ]
    first = [f"features[{22 * i}] AS f{i}" for i in range(6)]
    return rounded(
        df.selectExpr("vec_id", *sums, *first, "size(features) AS features"), 7
    )


def coded(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, label code) of the labelled documents."""
    return labelled_documents(spark, folder).where(F.col("satisfaction_label").isNotNull()).select(
        "doc_id", decode(F.col("satisfaction_label"), SATISFACTION_CODES).alias("label")
    )


_CODED_SQL = f"""{LABELLED_SQL},
coded AS (
  SELECT doc_id, CASE satisfaction_label WHEN 'YES' THEN 1 WHEN 'NO' THEN 0 ELSE 2 END AS label
  FROM labelled WHERE satisfaction_label IS NOT NULL
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY {shuffle_key_sql("doc_id")}) - 1 AS position,
         count(*) OVER () AS n FROM coded
),
folded AS (
  SELECT *, CAST(ntile(10) OVER (ORDER BY position) - 1 AS INTEGER) AS fold FROM placed
  WHERE position < CAST(floor(0.8 * n) AS BIGINT) + CAST(floor(0.1 * n) AS BIGINT)
)"""


@query(
    "train_eval_test_split",
    f"""WITH {_CODED_SQL}
SELECT doc_id, label, position, CASE WHEN position < CAST(floor(0.8 * n) AS BIGINT) THEN 'train'
       WHEN position < n - CAST(floor(0.1 * n) AS BIGINT) THEN 'test' ELSE 'eval' END AS split
FROM placed""",
)
def train_eval_test_split(spark: SparkSession, folder: str) -> DataFrame:
    """Parts, found by comparison, beside the positions they are cut at."""
    df = coded(spark, folder)
    return positions(classify.split(df, F.col("doc_id"), df.count()), F.col("doc_id"))


def _folded(spark: SparkSession, folder: str) -> DataFrame:
    df = coded(spark, folder)
    return classify.folds(df, F.col("doc_id"), df.count())


_MAJORITY_SQL = f"""{_CODED_SQL},
grid AS (
  SELECT f.fold, l.label, count(*) FILTER (p.label = l.label AND p.fold <> f.fold) AS outside
  FROM (SELECT DISTINCT fold FROM folded) f, (SELECT DISTINCT label FROM folded) l, folded p
  GROUP BY f.fold, l.label
),
choice AS (
  SELECT fold, label AS prediction FROM grid
  QUALIFY row_number() OVER (PARTITION BY fold ORDER BY outside DESC, label) = 1
),
per_fold AS (
  SELECT c.fold, c.prediction, count(*) AS rows, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS accuracy
  FROM choice c JOIN folded p ON c.fold = p.fold GROUP BY c.fold, c.prediction
)"""


@query(
    "kfold_majority_baseline",
    f"WITH {_MAJORITY_SQL} SELECT fold, prediction, rows, round(accuracy, 9) AS accuracy FROM per_fold",
)
def kfold_majority_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(classify.majority_baseline(_folded(spark, folder)), 9)


@query(
    "majority_baseline_summary",
    f"""WITH {_MAJORITY_SQL}
SELECT round(avg(accuracy), 9) AS mean_accuracy, round(stddev_pop(accuracy), 9) AS std_accuracy FROM per_fold""",
)
def majority_baseline_summary(spark: SparkSession, folder: str) -> DataFrame:
    per_fold = classify.majority_baseline(_folded(spark, folder))
    return rounded(classify.mean_and_spread(per_fold), 9)


@query(
    "random_baseline",
    f"""WITH {_CODED_SQL}
SELECT fold, count(*) AS rows,
       round(avg(CASE WHEN label = {hash_number_sql("doc_id", 12)} % 3 THEN 1.0 ELSE 0.0 END), 9) AS accuracy
FROM folded GROUP BY fold""",
)
def random_baseline(spark: SparkSession, folder: str) -> DataFrame:
    """A uniformly drawn class per row; the draw is a hash, so it can be repeated."""
    return rounded(classify.random_baseline(_folded(spark, folder), F.col("doc_id")), 9)


@query(
    "label_mode",
    f"""WITH {LABELLED_SQL}
SELECT lang, satisfaction_label AS mode FROM labelled WHERE satisfaction_label IS NOT NULL
GROUP BY lang, satisfaction_label
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, satisfaction_label) = 1""",
)
def label_mode(spark: SparkSession, folder: str) -> DataFrame:
    known = labelled_documents(spark, folder).where(F.col("satisfaction_label").isNotNull())
    return mode(known.select("lang", F.col("satisfaction_label").alias("label")), ["lang"], "label")


def predicted(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with the class a stand-in model gives their first three messages."""
    docs = documents_corpus(spark, folder).drop("openai_moderation")
    text = F.array_join(F.transform(F.slice("conversation", 1, 3), lambda m: m["content"]), " ")
    scored = docs.select("doc_id", argmax(letter_sentiment_scores(text)).alias("prediction"))
    return scored.join(coded(spark, folder), "doc_id")


_PREDICTED_SQL = f"""{_CODED_SQL}, {PARTS_SQL},
predicted AS (
  SELECT c.doc_id, label, list_position(s, list_max(s)) - 1 AS prediction
  FROM coded c JOIN (SELECT doc_id, [{", ".join(share_sql(c, "three") for c in "ean")}] AS s
    FROM (SELECT doc_id, array_to_string(lines[1:3], ' ') AS three FROM parts)) p
  ON c.doc_id = p.doc_id
)"""


@query(
    "accuracy",
    f"""WITH {_PREDICTED_SQL}
SELECT count(*) AS rows, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 9) AS accuracy
FROM predicted""",
)
def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        predicted(spark, folder).agg(
            F.count(F.lit(1)).alias("rows"),
            classify.accuracy(F.col("label"), F.col("prediction")).alias("accuracy"),
        ),
        9,
    )


@query(
    "confusion_matrix",
    f"""WITH {_PREDICTED_SQL}
SELECT label, {", ".join(
    f"count(*) FILTER (prediction = {c}) AS predicted_{c}" for c in range(3)
)} FROM predicted GROUP BY label""",
)
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return classify.confusion_matrix(predicted(spark, folder), "label", "prediction")


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Annotated triples as pair features of their three embedded messages."""
    df = completed(annotated(spark, folder)).select("doc_id", "chat_triples", "label")
    return triple_features(df).drop("chat_triples")


def triple_features(df: DataFrame, width: int = 8) -> DataFrame:
    """Adds the head's input of ``chat_triples`` (zeros where it is null), label and weight."""
    parts = [f"_v{i}" for i in range(3)]
    for i, name in enumerate(parts):
        df = df.withColumn(name, hashed_words(F.get("chat_triples", F.lit(i))["content"], width))
    df = df.withColumn("x", pair_features(*map(F.col, parts))).drop(*parts)
    if "label" not in df.columns:
        df = df.withColumn("label", decode(F.col("satisfaction_label"), SATISFACTION_CODES))
    return classify.ready(df, "x")


@query("train_head")
def train_head(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy on the test part of a weighted linear and a two-layer head."""
    df = features(spark, folder).select("doc_id", "label", "weight", "features")
    parts = materialise(classify.split(df, F.col("doc_id"), df.count()), "features")
    train, test = (parts.where(F.col("split") == s) for s in ("train", "test"))
    rows = []
    for name, layers, weighted in (("linear", 1, True), ("two layers", 2, False)):
        model = classify.head(layers, inputs=48, hidden=8, weighted=weighted).fit(train)
        hit = classify.accuracy(F.col("label"), F.col("prediction"))
        rows.append(
            model.transform(test).agg(
                F.lit(name).alias("head"), F.count(F.lit(1)).alias("rows"), hit.alias("accuracy")
            )
        )
    return rows[0].unionByName(rows[1])


def _folded_features(spark: SparkSession, folder: str) -> DataFrame:
    df = materialise(features(spark, folder), "features")
    return materialise(classify.folds(df, F.col("doc_id"), df.count()), "folds")


@query("cross_validation")
def cross_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Ten-fold accuracy of the linear head: mean and population deviation."""
    df = _folded_features(spark, folder)
    return classify.mean_and_spread(classify.cross_validate(df, classify.head(1)))


@query("grid_search")
def grid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Mean ten-fold accuracy over layers, width, bias and regularisation, best first."""
    df = _folded_features(spark, folder)
    linear = classify.head(1)
    grid = (
        ParamGridBuilder()
        .addGrid(linear.regParam, [0.0, 0.1])
        .addGrid(linear.fitIntercept, [True, False])
        .build()
    )
    scores = classify.cross_validate(df, linear, grid).withColumn("layers", F.lit(1))
    for width in (8, 16):
        deep = classify.head(2, inputs=48, hidden=width)
        found = classify.cross_validate(df, deep).withColumn("params", F.lit(f"hidden={width}"))
        scores = scores.unionByName(found.withColumn("layers", F.lit(2)))
    means = scores.groupBy("layers", "params").agg(F.avg("accuracy").alias("mean_accuracy"))
    return means.orderBy(F.desc("mean_accuracy"), "layers", "params")


def labelled_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus with a label for every conversation of three messages: the known one, or
    that of a head fitted on the known ones."""
    corpus = documents_corpus(spark, folder).drop("openai_moderation")
    df = corpus.join(satisfaction(spark, folder), "doc_id", "left")
    train = features(spark, folder).select("label", "weight", "features")
    model = classify.head(1, weighted=True).fit(train)
    return label_missing_by_head(df, model, triple_features)


@query("labelled_by_head")
def labelled_by_head(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of the whole corpus, with the messages they were read from."""
    return labelled_corpus(spark, folder).select(
        "doc_id", F.col("language").alias("lang"), "satisfaction_label", "chat_triples"
    )


@query("head_satisfaction_pivot")
def head_satisfaction_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Satisfaction per language over the corpus that the head has labelled."""
    return satisfaction_plan.table(analysis_names(labelled_corpus(spark, folder)))


@query("head_chi2_independence")
def head_chi2_independence(spark: SparkSession, folder: str) -> DataFrame:
    """Whether satisfaction depends on the language, over the labelled corpus."""
    return satisfaction_plan.independence(head_satisfaction_pivot(spark, folder))


@query("train_deep_head")
def train_deep_head(spark: SparkSession, folder: str) -> DataFrame:
    """Loss of the last epoch, and accuracy on the test part, of a weighted head of five layers
    with smoothed labels, beside that of one layer."""
    df = features(spark, folder).select("doc_id", "label", "x")
    parts = materialise(classify.split(df, F.col("doc_id"), df.count()), "features")
    train, test = (parts.where(F.col("split") == s) for s in ("train", "test"))
    weights = weights_of(classify.CLASS_WEIGHTS)
    rows = []
    for layers, activation in ((1, "ReLU"), (5, "Mish")):
        shape = HeadShape(48, layers, 24, activation=activation, smoothing=0.2, class_weights=weights)
        model = NetworkHead(shape, epochs=12, batch=max(32, df.count() // 3)).fit(train)
        hit = classify.accuracy(F.col("label"), F.col("prediction"))
        rows.append(
            model.transform(test).agg(
                F.lit(layers).alias("layers"),
                F.lit(float(model.losses[-1])).alias("train_loss"),
                F.count(F.lit(1)).alias("rows"),
                hit.alias("accuracy"),
            )
        )
    return rows[0].unionByName(rows[1])


#: The parameters that are searched, and their ranges.
HEAD_SPACE = {
    "learning_rate": Real(1e-6, 1e-3, log=True),
    "batch_size": Choice((32, 64, 128)),
    "hidden_size": Real(10, 3000, log=True, whole=True),
    "num_layers": Real(1, 5, whole=True),
    "use_bias": Choice((True, False)),
    "use_weighted_loss": Choice((True, False)),
    "label_smoothing": Real(0.0, 0.3, step=0.1),
    "activation": Choice(tuple(ACTIVATIONS)),
}


def search_heads(train: DataFrame, held: DataFrame, inputs: int, trials: int, epochs: int, parallel: int = 4):
    """Trials of heads on two stored parts: the largest accuracy on ``held`` is looked for."""

    def objective(params: dict, report) -> float:
        weights = weights_of(classify.CLASS_WEIGHTS) if params["use_weighted_loss"] else None
        shape = HeadShape(
            inputs, params["num_layers"], params["hidden_size"], bias=params["use_bias"],
            activation=params["activation"], smoothing=params["label_smoothing"], class_weights=weights,
        )
        seen: list[float] = []

        def watch(epoch: int, model) -> None:
            seen.append(predicted_accuracy(model, held) or 0.0)
            report(epoch, seen[-1])

        NetworkHead(
            shape, epochs=epochs, batch=params["batch_size"], rate=params["learning_rate"], watch=watch
        ).fit(train).remove()
        return seen[-1]

    return search(objective, HEAD_SPACE, trials, parallel=parallel, startup=6)


@query("head_search")
def head_search(spark: SparkSession, folder: str) -> DataFrame:
    """Twelve trials over the eight parameters of a head, with their accuracy."""
    df = features(spark, folder).select("doc_id", "label", "x")
    parts = materialise(classify.split(df, F.col("doc_id"), df.count()), "features")
    train, held = (parts.where(F.col("split") == s) for s in ("train", "eval"))
    found = search_heads(train, held, 48, trials=12, epochs=2)
    rows = [
        (t.number, *(str(t.params[p]) if p in ("activation",) else float(t.params[p]) for p in HEAD_SPACE), t.value, t.stopped)
        for t in found
    ]
    kinds = ", ".join(f"{p} {'string' if p == 'activation' else 'double'}" for p in HEAD_SPACE)
    return spark.createDataFrame(rows, f"trial int, {kinds}, accuracy double, stopped boolean")
