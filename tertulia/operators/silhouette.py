"""Exact per-row silhouettes over Euclidean distances, in blocks."""

from __future__ import annotations

import math

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

BLOCK_ROWS, LEAST_ROWS, TILE = 16_384, 256, 1024


def pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; pairs too close for the product formula are redone exactly."""
    aa = np.einsum("ij,ij->i", a, a)
    bb = np.einsum("ij,ij->i", b, b)
    squared = aa[:, None] + bb[None, :] - 2.0 * (a @ b.T)
    scale = aa[:, None] + bb[None, :]
    rows, cols = np.nonzero(squared < 1e-4 * scale)
    for start in range(0, len(rows), 65536):
        i, j = rows[start : start + 65536], cols[start : start + 65536]
        gap = a[i] - b[j]
        squared[i, j] = np.einsum("ij,ij->i", gap, gap)
    return np.sqrt(np.maximum(squared, 0.0))


def _members(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct labels and a 0/1 matrix of rows by label."""
    distinct, codes = np.unique(labels, return_inverse=True)
    member = np.zeros((len(labels), len(distinct)))
    member[np.arange(len(labels)), codes] = 1.0
    return distinct, member


def _partial_sums(pdf: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """Distance sums of one block pair: per row and label of the opposite block."""
    same = pdf["block_a"].iat[0] == pdf["block_b"].iat[0]
    parts = [pdf, pdf] if same else [pdf[pdf["in_a"]], pdf[~pdf["in_a"]]]
    frames = []
    if len(parts[0]) and len(parts[1]):
        vectors = [np.stack(p["vector"].to_numpy()).astype(np.float64) for p in parts]
        labels, members = zip(*(_members(p["label"].to_numpy()) for p in parts), strict=True)
        sums = [np.zeros((len(parts[i]), len(labels[1 - i]))) for i in (0, 1)]
        for i in range(0, len(vectors[0]), TILE):
            for j in range(0, len(vectors[1]), TILE):
                here, there = slice(i, i + TILE), slice(j, j + TILE)
                distance = pair_distances(vectors[0][here], vectors[1][there])
                sums[0][here] += distance @ members[1][there]
                if not same:
                    sums[1][there] += distance.T @ members[0][here]
        for turn in (0,) if same else (0, 1):
            rows, others = parts[turn], labels[1 - turn]
            frames.append(
                pd.DataFrame(
                    {
                        **{c: np.repeat(rows[c].to_numpy(), len(others)) for c in by},
                        "id": np.repeat(rows["id"].to_numpy(), len(others)),
                        "label": np.repeat(rows["label"].to_numpy(), len(others)),
                        "other": np.tile(others, len(rows)),
                        "distance": sums[turn].ravel(),
                        "members": np.tile(
                            members[1 - turn].sum(axis=0).astype(np.int64), len(rows)
                        ),
                    }
                )
            )
    columns = [*by, "id", "label", "other", "distance", "members"]
    return pd.concat(frames)[columns] if frames else pd.DataFrame(columns=columns)


def silhouettes(
    df: DataFrame,
    id: str,
    vector: str,
    label: str,
    by: Sequence[str] = (),
    rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Silhouette of every row within its ``by`` subset: (by, id, label, silhouette).

    Rows are hashed into B blocks per subset and sent once to each of the B block
    pairs they belong to. One task holds two blocks and returns per row and label
    a distance sum, so row pairs exist only inside a matrix product. ``rows`` is the
    size of the largest subset (counted here when it is not given); ``id`` must be
    unique within a subset. The work is quadratic in ``rows``: sample large corpora.
    Blocks hold up to BLOCK_ROWS rows, or fewer while that gives the shuffle partitions
    something to do each, so a vector is sent rows / BLOCK_ROWS times or about the
    square root of twice the partitions.
    """
    by = list(by)
    if rows is None:
        counted = df.groupBy(*by).count() if by else df.agg(F.count(F.lit(1)).alias("count"))
        rows = counted.agg(F.max("count")).first()[0] or 0
    if block_rows:
        blocks = max(1, -(-rows // block_rows))
    else:
        busy = math.isqrt(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
        blocks = max(1, -(-rows // BLOCK_ROWS), min(-(-rows // LEAST_ROWS), busy))
    narrow = df.select(
        *by,
        F.col(id).alias("id"),
        F.col(label).alias("label"),
        F.col(vector).alias("vector"),
        F.pmod(F.xxhash64(id), F.lit(blocks)).cast("int").alias("_block"),
    )
    placed = (
        narrow.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("block_a", F.least("_block", "_other"))
        .withColumn("block_b", F.greatest("_block", "_other"))
        .withColumn("in_a", F.col("_block") == F.col("block_a"))
        .drop("_block", "_other")
    )
    types = {f.name: f.dataType.simpleString() for f in narrow.schema.fields}
    schema = ", ".join(
        [f"`{c}` {types[c]}" for c in by]
        + [
            f"id {types['id']}",
            f"label {types['label']}",
            f"other {types['label']}",
            "distance double",
            "members long",
        ]
    )
    partial = placed.groupBy(*by, "block_a", "block_b").applyInPandas(
        lambda pdf: _partial_sums(pdf, by), schema
    )
    # placed by row, so that both aggregations below run without another shuffle
    per_label = (
        partial.repartition(*by, "id")
        .groupBy(*by, "id", "label", "other")
        .agg(F.sum("distance").alias("distance"), F.sum("members").alias("members"))
    )
    own = F.col("other") == F.col("label")
    per_row = per_label.groupBy(*by, "id", "label").agg(
        F.max(F.when(own, F.col("members"))).alias("own"),
        F.max(F.when(own, F.try_divide(F.col("distance"), F.col("members") - 1))).alias("a"),
        F.min(F.when(~own, F.col("distance") / F.col("members"))).alias("b"),
    )
    return per_row.select(*by, "id", "label", silhouette_of().alias("silhouette"))


def silhouette_of() -> Column:
    """(b - a) / max(a, b): 0 for a row alone in its label or all on one point,
    null when no other label exists."""
    a, b = F.col("a"), F.col("b")
    return (
        F.when(b.isNull(), F.lit(None).cast("double"))
        .when(F.col("own") == 1, F.lit(0.0))
        .otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    )


def by_label(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation per label (and subset)."""
    return scores.groupBy(*by, "label").agg(
        F.avg("silhouette").alias("avg_silhouette_score"),
        F.stddev_pop("silhouette").alias("std_silhouette_score"),
        F.count("silhouette").alias("rows"),
    )


def over_subsets(per_subset: DataFrame) -> DataFrame:
    """Unweighted mean over the subsets in which a label occurs."""
    return per_subset.groupBy("label").agg(
        F.avg("avg_silhouette_score").alias("avg_silhouette_score"),
        F.avg("std_silhouette_score").alias("std_silhouette_score"),
        F.count(F.lit(1)).alias("subsets"),
    )


def overall(scores: DataFrame, subset: str = "subset") -> DataFrame:
    """Two rows: the mean of the per-subset figures, and those of the last subset."""
    per_subset = scores.groupBy(subset).agg(
        F.avg("silhouette").alias("avg"), F.stddev_pop("silhouette").alias("std")
    )
    both = per_subset.agg(
        F.avg("avg").alias("mean_avg"),
        F.avg("std").alias("mean_std"),
        F.max_by("avg", subset).alias("last_avg"),
        F.max_by("std", subset).alias("last_std"),
    )
    return both.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("mean over subsets").alias("figure"),
                    F.col("mean_avg").alias("avg_silhouette_score"),
                    F.col("mean_std").alias("std_silhouette_score"),
                ),
                F.struct(
                    F.lit("last subset").alias("figure"),
                    F.col("last_avg").alias("avg_silhouette_score"),
                    F.col("last_std").alias("std_silhouette_score"),
                ),
            )
        )
    )
