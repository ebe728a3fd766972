"""Exact silhouettes that leave out labels too far away to matter.

A row's mean distance to a label's rows is at least its distance to their centroid, as the
norm is convex. So a row is first compared with its own label and with the other label of the
nearest centroid; what that gives is an upper bound, and a label whose centroid is farther
needs no comparison. On clustered data most labels fall away, on mixed data none do.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tertulia.operators.silhouette import BLOCK_ROWS, LEAST_ROWS, TILE, pair_distances, silhouette_of, silhouettes
from tertulia.sources.corpus import materialise

LABELS = 256  # centroids sent to every task
SLACK = 1e-9  # relative rounding of a distance


def centroids(rows: DataFrame) -> DataFrame:
    """Per label: centre (array<double>) and n, of rows with label and vector."""
    at = rows.select("label", F.posexplode("vector").alias("_at", "_v"))
    means = at.groupBy("label", "_at").agg(F.avg("_v").alias("_v"), F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_v")))  # as long as a vector
    return means.groupBy("label").agg(
        F.transform(ordered, lambda x: x["_v"]).alias("centre"), F.max("n").alias("n")
    )


def near_label_silhouettes(
    df: DataFrame, id: str, vector: str, label: str, block_rows: int | None = None
) -> DataFrame:
    """Silhouette of every row: (id, label, silhouette, compared).

    The figures are those of ``silhouettes``; ``compared`` is the number of rows a row was
    compared with. Rows without a label or vector take no part; ``id`` must be unique. Rows of
    a label are hashed into blocks, and so are the rows compared with it; a task holds one of
    each, so a label with a third of all rows is many tasks. With more than LABELS labels
    every row is compared with all, as ``silhouettes`` does. Jobs run when this is called.
    """
    rows = materialise(
        df.select(
            F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector")
        ).where("label is not null and vector is not null"),
        "silhouette-rows",
    )
    found = centroids(rows).orderBy("label").limit(LABELS + 1).collect()
    total = sum(r["n"] for r in found)
    if not found or len(found) > LABELS:
        whole = silhouettes(rows, "id", "vector", "label")
        return whole.withColumn("compared", F.lit(rows.count() if found else 0))
    sizes = [r["n"] for r in found]
    centres = np.array([r["centre"] for r in found])
    codes = {r["label"]: i for i, r in enumerate(found)}

    def bounds(batches):
        for pdf in batches:
            if len(pdf):
                code = pdf["label"].map(codes).to_numpy(dtype=np.int64)
                far = pair_distances(np.stack(pdf["vector"].to_numpy()).astype(np.float64), centres)
                far[np.arange(len(code)), code] = np.inf
                nearest = far.argmin(axis=1) if len(codes) > 1 else np.full(len(code), -1)
                yield pdf.assign(code=code.astype(np.int32), nearest=nearest.astype(np.int32), lower=list(far))

    types = rows.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    placed = materialise(
        rows.mapInPandas(bounds, f"{types}, code int, nearest int, lower array<double>"), "silhouette-bounds"
    )
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fair = math.isqrt(2 * total * total // (len(sizes) * tasks))
    block = block_rows or min(BLOCK_ROWS, max(LEAST_ROWS, fair))
    first = F.array_remove(F.array("code", "nearest"), -1)
    near = materialise(_sums(placed, first, sizes, block), "silhouette-near")
    mean = F.col("distance") / _of(sizes, F.col("target"))
    best = near.where("target <> code").select("id", mean.alias("best"))
    numbers = F.sequence(F.lit(0), F.lit(len(sizes) - 1))
    open_labels = F.filter(
        numbers,
        lambda t: (t != F.col("code"))
        & (t != F.col("nearest"))
        & (F.get(F.col("lower"), t) * (1 - SLACK) <= F.col("best")),
    )
    left = placed.join(best, "id").withColumn("open", open_labels).where(F.size("open") > 0)
    rest = _sums(placed, F.col("open"), sizes, block, materialise(left.drop("best"), "silhouette-open"))
    own = F.col("target") == F.col("code")
    n = _of(sizes, F.col("target"))
    figures = (
        near.unionByName(rest)
        .groupBy("id", "code")
        .agg(
            F.max(F.when(own, n)).alias("own"),
            F.max(F.when(own, F.try_divide(F.col("distance"), n - 1))).alias("a"),
            F.min(F.when(~own, mean)).alias("b"),
            F.sum(n).alias("compared"),
        )
    )
    names = rows.sparkSession.createDataFrame(
        [(i, k) for k, i in codes.items()], f"code int, label {dict(rows.dtypes)['label']}"
    )
    return figures.join(F.broadcast(names), "code").select(
        "id", "label", silhouette_of().alias("silhouette"), "compared"
    )


def _of(values: list[int], place: Column) -> Column:
    return F.get(F.array(*(F.lit(int(v)).cast("long") for v in values)), place)


def _sums(
    members: DataFrame, targets: Column, sizes: list[int], block: int, asking: DataFrame | None = None
) -> DataFrame:
    """(id, code, target, distance): summed distances of rows to all rows of their ``targets``."""
    asked = (members if asking is None else asking).select("id", "code", "vector", F.explode(targets).alias("target"))
    asks = dict.fromkeys(range(len(sizes)), 0)
    asks |= {r["target"]: r["count"] for r in asked.groupBy("target").count().collect()}
    rows_in = [-(-n // block) for n in sizes]  # blocks of a label's rows, and of rows that ask for it
    asks_in = [-(-asks[t] // block) for t in range(len(sizes))]

    def blocks(counts: list[int], t: Column) -> Column:
        return F.sequence(F.lit(0).cast("long"), _of(counts, t) - 1)

    def part(counts: list[int], t: Column) -> Column:
        return F.pmod(F.xxhash64("id"), _of(counts, t))

    t = F.col("target")
    left = asked.withColumn("i", part(asks_in, t)).withColumn("j", F.explode(blocks(rows_in, t)))
    right = (
        members.select("id", "code", "vector", F.col("code").alias("target"))
        .where(_of(asks_in, t) > 0)
        .withColumn("j", part(rows_in, t))
        .withColumn("i", F.explode(blocks(asks_in, t)))
    )
    both = left.withColumn("asks", F.lit(True)).unionByName(right.withColumn("asks", F.lit(False)))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        here, there = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        total = np.zeros(len(here))
        if len(here) and len(there):
            a, b = (np.stack(x["vector"].to_numpy()).astype(np.float64) for x in (here, there))
            for i in range(0, len(a), TILE):
                for j in range(0, len(b), TILE):
                    total[i : i + TILE] += pair_distances(a[i : i + TILE], b[j : j + TILE]).sum(axis=1)
        return here[["id", "code", "target"]].assign(distance=total)

    kind = dict(members.dtypes)["id"]
    partial = both.groupBy("target", "i", "j").applyInPandas(work, f"id {kind}, code int, target int, distance double")
    return partial.groupBy("id", "code", "target").agg(F.sum("distance").alias("distance"))
