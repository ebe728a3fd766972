"""Corpora and intermediates as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from tertulia.schema import ANNOTATED_TRIPLES, CORPUS
from tertulia.session import new_path


def read_corpus(spark: SparkSession, path: str, schema: T.StructType = CORPUS) -> DataFrame:
    """Read a corpus with its declared schema, so nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def write_corpus(df: DataFrame, path: str) -> str:
    """Write a corpus to a path of its own; an existing one is an error.

    A new version goes to a new path, because the old one may still be the input.
    """
    df.write.mode("errorifexists").parquet(path)
    return path


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANNOTATED_TRIPLES).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write an expensive intermediate to the shared folder and read it back.

    Later steps then restart from the files when an executor is lost.
    """
    path = write_corpus(df, new_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)
