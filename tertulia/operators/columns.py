"""Projection helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tertulia.schema import LANGUAGE_REGIONS


def without(df: DataFrame, *names: str) -> DataFrame:
    """All columns except ``names``; names that do not exist are ignored."""
    return df.select([F.col(f"`{c}`") for c in df.columns if c not in names])


def ensure_column(df: DataFrame, name: str, dtype: T.DataType | str, value=None) -> DataFrame:
    """Add a constant (by default null) column unless the frame already has it."""
    if name in df.columns:
        return df
    return df.withColumn(name, F.lit(value).cast(dtype))


def augment(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` as a column, or fill only its nulls where the column exists.

    Re-running an interrupted job therefore leaves the rows already done alone.
    """
    if name not in df.columns:
        return df.withColumn(name, value)
    return df.withColumn(name, F.coalesce(F.col(name), value))


def analysis_names(df: DataFrame) -> DataFrame:
    """Rename ``language`` to the ``lang`` every analysis table uses."""
    return df.withColumnRenamed("language", "lang")


def region(language: Column) -> Column:
    """Region of a language as a literal map lookup, null for other languages."""
    return decode(language, LANGUAGE_REGIONS)


def decode(value: Column, mapping: dict) -> Column:
    """Dictionary lookup as a literal map, null for unknown values."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), value)


def listed(column: Column, values: Sequence, what: str) -> Column:
    """The column; a value that is neither null nor one of ``values`` stops the job."""
    message = F.concat(F.lit(f"unlisted {what}: "), column.cast("string"))
    return F.when(column.isNull() | column.isin(*values), column).otherwise(F.raise_error(message))
