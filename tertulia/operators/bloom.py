"""A blocked Bloom filter as a small table, built by an aggregate and looked up by a broadcast.

A key belongs to one block of BLOCK_BITS bits, of which it sets PROBES. The table has one row
per block that holds a key and never more than MOST_BLOCKS (32 MB), whatever the number of
keys: beyond about 17 million keys the share of false positives grows, the result of an
anti-join does not change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BITS = 32_768  # what one bitmap of Spark holds
BITS_PER_KEY = 16
PROBES = 4
MOST_BLOCKS = 8_192


def blocks_for(keys: int) -> int:
    """Blocks that give each key BITS_PER_KEY bits, within the bound."""
    return min(MOST_BLOCKS, max(1, -(-keys * BITS_PER_KEY // BLOCK_BITS)))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(PROBES)), F.lit(blocks)).cast("int")


def _places(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK_BITS)) for i in range(PROBES)]


def bloom_table(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """Rows (block, bits) of the filter over the column ``key``; null keys are keys too."""
    places = keys.select(
        _block(F.col(key), blocks).alias("block"), F.explode(F.array(*_places(F.col(key)))).alias("place")
    )
    return places.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))


def with_possible(df: DataFrame, key: str, table: DataFrame, blocks: int, name: str) -> DataFrame:
    """Adds ``name``: false where ``key`` is surely not among the filter's keys."""
    filter_ = F.broadcast(table.select(F.col("block").alias("_block"), F.col("bits").alias("_bits")))
    set_ = None
    for place in _places(F.col(key)):
        byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        one = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1
        set_ = one if set_ is None else set_ & one
    joined = df.join(filter_, _block(F.col(key), blocks) == F.col("_block"), "left")
    return joined.withColumn(name, F.coalesce(set_, F.lit(False))).drop("_block", "_bits")
