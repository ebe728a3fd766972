"""Moderation scores by language and role, and rank tests on user messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tertulia.functions.numeric import round_half_away
from tertulia.operators.aggregate import mean_and_std_with_total
from tertulia.operators.distribution import AUTO, mid_rank, running_counts, value_histogram
from tertulia.operators.ranktests import dunn, kruskal_wallis, rank_sums
from tertulia.schema import MEASURES


def table(scored: DataFrame, digits: int | None = 5) -> DataFrame:
    """13 means and 13 deviations per language for user, assistant and all messages."""
    out = mean_and_std_with_total(scored, "lang", "role", MEASURES).orderBy("lang", "role")
    if digits is None:
        return out
    return out.selectExpr(
        "lang",
        "role",
        *[f"round(`{c}`, {digits}) AS `{c}`" for c in out.columns if c not in ("lang", "role")],
    )


def languages_with_messages(scored: DataFrame, min_messages: int = 5) -> DataFrame:
    """Languages with enough messages, where every message counts for its role and for
    ``all``, so that the default of 5 asks for three messages."""
    counts = scored.groupBy("lang").agg((F.count("lang") * 2).alias("num_messages"))
    return counts.where(F.col("num_messages") >= min_messages)


def ranked_scores(
    scored: DataFrame,
    role: str = "user",
    digits: int = 2,
    min_messages: int = 5,
    measures: Sequence[str] = tuple(MEASURES),
) -> DataFrame:
    """Rounded scores of one role as a ranked histogram over eligible languages.

    All roles are counted in the same pass: eligibility needs every message of a
    language, and a window over the counts spares a second scan. Scores rounded to at
    most three digits have about a thousand values per measure and are ranked without buckets.
    """
    quoted = [f"`{m}`" for m in measures]
    long = scored.select("lang", "role", *quoted).unpivot(
        ["lang", "role"], quoted, "measure", "value"
    )
    long = long.withColumn("value", round_half_away(F.col("value"), digits))
    hist = value_histogram(long, ["measure", "lang", "role"])
    language = Window.partitionBy("measure", "lang")
    eligible = (
        hist.withColumn("_messages", F.sum("n").over(language) * 2)
        .where((F.col("_messages") >= min_messages) & F.col("lang").isNotNull())
        .where(F.col("role") == role)
        .drop("_messages", "role")
    )
    few = None if digits <= 3 else AUTO
    return running_counts(eligible, ["measure"], buckets=few).withColumn("mid_rank", mid_rank())


def value_ranks(ranked: DataFrame) -> DataFrame:
    """One row per measure and value: rows with it and their mid-rank."""
    return ranked.groupBy("measure", "value").agg(
        F.first("ties").alias("ties"), F.first("mid_rank").alias("mid_rank")
    )


def kruskal_table(ranked: DataFrame) -> DataFrame:
    return kruskal_wallis(rank_sums(ranked, "lang"), "lang")


def dunn_table(ranked: DataFrame, alpha: float = 0.05) -> DataFrame:
    return dunn(rank_sums(ranked, "lang"), "lang", alpha)


def significant_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs and significant pairs per measure."""
    return pairs.groupBy("measure").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col("significant")).alias("significant_pairs"),
    )
