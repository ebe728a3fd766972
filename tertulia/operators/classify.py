"""Splits, folds, baselines, metrics and trainable heads for the label classifier."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tertulia.operators.columns import listed
from tertulia.operators.ordering import before, digests_at, hash_number, shuffle_key

# Class weights of the weighted loss, by class code.
CLASS_WEIGHTS = {0: 1.6, 1: 1.0, 2: 1.6}


def split_sizes(rows: int) -> tuple[int, int, int]:
    """Train, test and evaluation sizes: 80 %, the remainder, 10 %, cut to integers."""
    train, held = int(0.8 * rows), int(0.1 * rows)
    return train, rows - train - held, held


def split(df: DataFrame, key: Column, rows: int, seed: int = 42) -> DataFrame:
    """Add ``split`` (train, test, eval): the parts of the shuffled order of ``rows`` rows.

    The digests at both borders are found when this is called, from the key column alone; a
    row's part follows from comparing its digest with them, so no row is moved. ``key`` must
    identify a row; rows that share a key get the same part.
    """
    train, test, _ = split_sizes(rows)
    digest = shuffle_key(key, seed)
    first, second = digests_at(df, key, [train, train + test], seed)
    part = F.when(before(digest, first), "train").when(before(digest, second), "test")
    return df.withColumn("split", part.otherwise("eval"))


def folds(df: DataFrame, key: Column, rows: int, k: int = 10, seed: int = 42) -> DataFrame:
    """Add ``fold`` to the first train and test rows: ``k`` stretches of the shuffled order.

    Of ``rows`` rows the first int(0.8 n) + int(0.1 n) are used; none of the evaluation
    part is among them. Fold sizes differ by at most one, the first are the larger. As in
    ``split``, rows are compared with the digests at the borders and not moved.
    """
    used = int(0.8 * rows) + int(0.1 * rows)
    ends = [(i + 1) * (used // k) + min(i + 1, used % k) for i in range(k)]
    bounds = digests_at(df, key, ends, seed)
    digest = shuffle_key(key, seed)
    earlier = [(~before(digest, bound)).cast("int") for bound in bounds[:-1]]
    return df.where(before(digest, bounds[-1])).withColumn("fold", reduce(Column.__add__, earlier, F.lit(0)))


def fold_label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per (fold, label): all the baselines need."""
    return df.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n"))


def majority_baseline(df: DataFrame, label: str = "label", k: int = 10) -> DataFrame:
    """Per fold, accuracy of predicting the commonest label of the other folds.

    Counts outside a fold are totals minus its own, all from one small count table;
    the smallest label wins a tie. Folds without rows are left out.
    """
    counts = fold_label_counts(df, label)
    totals = counts.groupBy(label).agg(F.sum("n").alias("total"))
    grid = totals.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).join(
        counts, ["fold", label], "left"
    )
    n = F.coalesce(F.col("n"), F.lit(0))
    rest = F.struct((n - F.col("total")).alias("order"), F.col(label).alias("label"))
    return (
        grid.groupBy("fold")
        .agg(
            F.min_by(label, rest).alias("prediction"),
            F.sum(n).alias("rows"),
            F.min_by(n, rest).alias("hits"),
        )
        .where(F.col("rows") > 0)
        .select("fold", "prediction", "rows", (F.col("hits") / F.col("rows")).alias("accuracy"))
    )


def random_baseline(
    df: DataFrame, key: Column, label: str = "label", classes: int = 3, seed: int = 42
) -> DataFrame:
    """Per fold, accuracy of a uniformly drawn label (drawn by hash of the row key)."""
    guess = (hash_number(key, seed, digits=12) % classes).cast("int")
    return df.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), accuracy(F.col(label), guess).alias("accuracy")
    )


def mean_and_spread(per_fold: DataFrame, metric: str = "accuracy") -> DataFrame:
    """Mean and population deviation of a metric over folds."""
    return per_fold.agg(
        F.avg(metric).alias(f"mean_{metric}"), F.stddev_pop(metric).alias(f"std_{metric}")
    )


def accuracy(label: Column, prediction: Column) -> Column:
    """Aggregate: share of rows whose prediction equals the label."""
    return F.avg((label == prediction).cast("double"))


def confusion_matrix(
    df: DataFrame, label: str, prediction: str, classes: Sequence[int] = (0, 1, 2)
) -> DataFrame:
    """One row per actual class, one ``predicted_<class>`` column per predicted class; a
    predicted class that is not listed stops the job."""
    checked = df.select(F.col(label), listed(F.col(prediction), classes, "class").alias(prediction))
    wide = checked.groupBy(label).pivot(prediction, list(classes)).count().na.fill(0)
    return wide.select(label, *[F.col(f"`{c}`").alias(f"predicted_{c}") for c in classes])


def head(
    layers: int = 1,
    inputs: int | None = None,
    hidden: int = 16,
    classes: int = 3,
    bias: bool = True,
    weighted: bool = False,
    seed: int = 42,
    max_iter: int = 30,
):
    """A classification head: logistic regression for one layer, else a perceptron.

    Label smoothing and the choice of activation have no counterpart in Spark ML.
    """
    if layers < 1:
        raise ValueError("layers must be at least 1")
    if layers == 1:
        model = LogisticRegression(
            family="multinomial", fitIntercept=bias, maxIter=max_iter
        )
        return model.setWeightCol("weight") if weighted else model
    if inputs is None:
        raise ValueError("a head of several layers needs the number of inputs")
    if weighted:
        raise ValueError("class weights are supported for one layer only")
    sizes = [inputs, *[hidden] * (layers - 1), classes]
    return MultilayerPerceptronClassifier(layers=sizes, seed=seed, maxIter=max_iter)


def ready(df: DataFrame, features: str, label: str = "label") -> DataFrame:
    """Feature array as a vector, label as double, class weight."""
    pairs = [F.lit(x) for pair in CLASS_WEIGHTS.items() for x in pair]
    weight = F.try_element_at(F.create_map(*pairs), F.col(label).cast("int"))
    return df.withColumns(
        {
            "weight": F.coalesce(weight, F.lit(1.0)),
            "features": array_to_vector(F.col(features)),
        }
    ).withColumn("label", F.col(label).cast("double"))


def cross_validate(
    df: DataFrame,
    estimator,
    grid: Sequence[dict] = ({},),
    k: int = 10,
    parallelism: int = 8,
) -> DataFrame:
    """Accuracy per parameter combination and fold: (params, fold, rows, accuracy).

    Each fold is fitted on the rows of the others; ``fold`` is an ordinary column, so
    the parts are plain filters. Fits run side by side as separate Spark jobs.
    """

    def run(task: tuple[dict, int]) -> DataFrame:
        params, fold = task
        model = estimator.fit(df.where(F.col("fold") != fold), params)
        name = ", ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda i: i[0].name))
        return model.transform(df.where(F.col("fold") == fold)).agg(
            F.lit(name).alias("params"),
            F.lit(fold).alias("fold"),
            F.count(F.lit(1)).alias("rows"),
            accuracy(F.col("label"), F.col("prediction")).alias("accuracy"),
        )

    tasks = [(params, fold) for params in grid for fold in range(k)]
    with ThreadPool(parallelism) as pool:
        results = pool.map(run, tasks)
    return reduce(DataFrame.unionByName, results)


def project_2d(df: DataFrame, vector: str) -> DataFrame:
    """First two principal components as columns x and y.

    A linear stand-in for a neighbourhood embedding. Only the covariance matrix,
    whose size is the vector width squared, reaches the driver.
    """
    vectors = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = Pipeline(stages=[PCA(k=2, inputCol="_v", outputCol="_p")]).fit(vectors)
    xy = vector_to_array("_p")
    return (
        model.transform(vectors)
        .withColumns({"x": F.get(xy, F.lit(0)), "y": F.get(xy, F.lit(1))})
        .drop("_v", "_p")
    )
