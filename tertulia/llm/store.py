"""Written intermediates and column helpers of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tertulia.session import new_path


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, stored in the shared folder and read again.

    The lineage ends here: a lost executor costs a read, not the work before it.
    """
    path = new_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def others(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Columns not named (in any case) in ``names``."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def free(df: DataFrame, name: str) -> str:
    """A column name, near ``name``, that the frame does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def replaced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The frame with ``columns`` at its end; columns of the same name, in any case, go."""
    return df.select(
        *(F.col(f"`{c}`") for c in others(df, columns)), *(v.alias(k) for k, v in columns.items())
    )


Compute = Callable[[pa.Array], Iterator[list[pa.Array]]]


def with_computed(
    df: DataFrame,
    source: str,
    fields: list[T.StructField],
    make: Callable[[], Compute],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Adds columns that NumPy code computes from one column, batch by batch.

    ``make`` is called once per task. The function it returns turns an Arrow array into
    lists of new arrays that together cover its rows in order. A column of the input that
    has the name of a new one (in any case) is replaced.
    """
    kept = others(df, [*(f.name for f in fields), *drop])
    by_name = dict(zip(df.columns, df.schema, strict=True))
    schema = T.StructType([*(by_name[c] for c in kept), *fields])
    inner = F.col(f"`{source}`").alias(free(df, "__source"))
    frame = df.select(*(F.col(f"`{c}`") for c in kept), inner)
    names = schema.names

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            at = 0
            for arrays in compute(batch.column(len(kept))):
                n = len(arrays[0])
                left = [batch.column(i).slice(at, n) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*left, *arrays], names=names)
                at += n

    return frame.mapInArrow(work, schema)
