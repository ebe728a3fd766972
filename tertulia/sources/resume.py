"""Scoring of a stored table that goes on where a stopped run ended."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, types as T

MANIFEST = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("result", T.StringType())]
)


def finished(spark: SparkSession, path: str) -> dict[str, str]:
    """The source files that are done, each with the folder of its result."""
    manifest = f"{path}/manifest"
    spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(manifest)
    return {r["file"]: r["result"] for r in spark.read.schema(MANIFEST).parquet(manifest).collect()}


def scored_in_parts(
    spark: SparkSession,
    source: str,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    files_a_part: int = 64,
    most_parts: int | None = None,
) -> DataFrame:
    """``score`` of the Parquet table at ``source``, kept under ``path``.

    A part is some files of the source: it is read once and nothing is shuffled to form it.
    Its rows are written to a folder of their own, and only then named in the manifest, by one
    file that appears whole. A restarted call with the same ``path`` scores the files that the
    manifest lacks; a half-written part is never named, so never read. ``most_parts`` ends
    a call early, and what is done so far is returned.

    ``score`` maps rows each by themselves, to the same columns in every call. Source files must
    not change; new ones are scored by the next call, and results of removed ones stay. One call
    works on a ``path`` at a time. The driver holds file names only. An empty source gives an
    empty result.
    """
    table = spark.read.parquet(source)
    files = sorted(unquote(f) for f in table.inputFiles())
    reader = spark.read.schema(table.schema)
    if not any(f.endswith(source.rstrip("/")) for f in files):
        reader = reader.option("basePath", source)  # keeps the columns of a partitioned table
    results = finished(spark, path)
    todo = [f for f in files if f not in results]
    parts = [todo[i : i + files_a_part] for i in range(0, len(todo), files_a_part)]
    for part in parts[:most_parts]:
        result = f"{path}/results/{uuid.uuid4().hex}"
        score(reader.parquet(*part)).write.parquet(result)
        done = [(f, result) for f in part]
        spark.createDataFrame(done, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
        results.update(done)
    schema = score(table).schema
    if not results:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*sorted(set(results.values())))
