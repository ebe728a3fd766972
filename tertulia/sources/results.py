"""Result tables: CSV with a header, labelled matrices, one-row reports.

All of them are aggregates of at most a few thousand rows, hence one output file. Only the
finished rows are brought together; what makes them runs on all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tertulia.operators.ranktests import matrix, square


def write_table(df: DataFrame, path: str, order: Sequence = ()) -> str:
    out = df.repartition(1)
    out = out.sortWithinPartitions(*order) if order else out
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_matrix(
    pairs: DataFrame,
    measure: str,
    columns: Sequence[str] | None,
    folder: str,
    group: str = "lang",
) -> str:
    """Square p-value table of one measure; a slash in its name becomes an underscore."""
    long = square(pairs.where(F.col("measure") == measure), group)
    path = f"{folder.rstrip('/')}/{measure.replace('/', '_')}"
    return write_table(matrix(long, columns, group), path, [group])


def write_report(df: DataFrame, path: str) -> str:
    """A one-row statistic as JSON lines."""
    df.repartition(1).write.mode("overwrite").json(path)
    return path
