"""Expressions over vectors and arrays of messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def message(conversation: Column, position: int) -> Column:
    """Message at a 0-based position, null when the conversation is shorter."""
    return F.get(conversation, F.lit(position))


def argmax(values: Column) -> Column:
    """0-based position of the largest entry, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def abs_difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def pair_features(first: Column, reply: Column, second: Column) -> Column:
    """Three vectors followed by their three pairwise absolute differences."""
    return F.concat(
        first,
        reply,
        second,
        abs_difference(reply, first),
        abs_difference(second, reply),
        abs_difference(second, first),
    )


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mask-weighted mean of token vectors; a mask of zeros gives the zero vector."""
    weights = F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m)
    width = F.size(F.get(tokens, F.lit(0)))
    total = F.aggregate(
        F.arrays_zip(tokens.alias("token"), mask.alias("weight")),
        F.array_repeat(F.lit(0.0), width),
        lambda acc, t: F.zip_with(acc, t["token"], lambda a, x: a + x * t["weight"]),
    )
    return F.transform(total, lambda x: x / F.greatest(weights, F.lit(1e-9)))


def doubles(values: Column) -> Column:
    """Float vector as doubles, so that differences are taken in double precision."""
    return values.cast("array<double>")
