"""Queries: satisfaction labels and the test of independence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tertulia.catalog.length import rounded
from tertulia.catalog.registry import query
from tertulia.catalog.tables import (
    LABELLED_SQL,
    chi2_sf_sql,
    documents_corpus,
    labelled_documents,
    satisfaction as satisfaction_labels,

)
from tertulia.functions.scoring import letter_sentiment_scores
from tertulia.operators.annotate import label_missing
from tertulia.operators.contingency import transposed
from tertulia.plans import satisfaction

_COUNTS_SQL = f"""{LABELLED_SQL},
counts AS (
  SELECT lang, count(*) FILTER (satisfaction_label = 'YES') AS count_yes,
         count(*) FILTER (satisfaction_label = 'NO') AS count_no,
         count(*) FILTER (satisfaction_label = 'NA') AS count_na, count(*) AS total
  FROM labelled WHERE satisfaction_label IS NOT NULL GROUP BY lang
)"""

def counts(spark: SparkSession, folder: str) -> DataFrame:
    return satisfaction.table(labelled_documents(spark, folder))

_TABLE_SQL = f"""WITH {_COUNTS_SQL}
SELECT *, {", ".join(
    f"round(CAST(count_{n} AS DOUBLE) / total, 9) AS percentage_{n}" for n in satisfaction.NAMES
)} FROM counts"""

@query("satisfaction_pivot", _TABLE_SQL)
def satisfaction_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(counts(spark, folder), 9)

@query("satisfaction_bars", _TABLE_SQL)
def satisfaction_bars(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(satisfaction.bars(counts(spark, folder)), 9)

def _expected_sql(source: str, name: str) -> str:
    return f"""{name} AS (
  SELECT *, {", ".join(
      f"CAST(total AS DOUBLE) * sum(count_{n}) OVER () / sum(total) OVER () AS expected_{n}"
      for n in satisfaction.NAMES
  )} FROM {source}
)"""

@query(
    "expected_counts",
    f"""WITH {_COUNTS_SQL}, {_expected_sql("counts", "expected")}
SELECT lang, {", ".join(f"round(expected_{n}, 6) AS expected_{n}" for n in satisfaction.NAMES)}
FROM expected""",
)
def expected_counts(spark: SparkSession, folder: str) -> DataFrame:
    df = satisfaction.expected(counts(spark, folder))
    return rounded(df.select("lang", *[f"expected_{n}" for n in satisfaction.NAMES]))

def _tested_sql(min_expected: int) -> str:
    """Expected counts before dropping small groups, then again after."""
    small = " AND ".join(f"expected_{n} > {min_expected}" for n in satisfaction.NAMES)
    columns = "lang, count_yes, count_no, count_na, total"
    return f"""{_COUNTS_SQL}, {_expected_sql("counts", "before")},
kept AS (SELECT {columns} FROM before WHERE {small}),
{_expected_sql("kept", "after")},
test AS (
  SELECT sum({" + ".join(
      f"(count_{n} - expected_{n}) * (count_{n} - expected_{n}) / expected_{n}"
      for n in satisfaction.NAMES
  )}) AS statistic, count(*) AS groups, CAST(sum(total) AS BIGINT) AS observations
  FROM after
)"""

def _chi2_sql(min_expected: int) -> str:
    dof = "greatest((groups - 1) * 2, 0)"
    return f"""WITH {_tested_sql(min_expected)}
SELECT round(statistic, 6) AS statistic, CAST({dof} AS BIGINT) AS dof,
       CASE WHEN groups > 0 THEN round({chi2_sf_sql("statistic", dof)}, 9) END AS p_value,
       CASE WHEN groups > 1 THEN round(sqrt(statistic / observations / least(groups - 1, 2)), 6) END AS cramers_v,
       groups, observations
FROM test"""

def _test_row(table: DataFrame, min_expected: float = 10) -> DataFrame:
    df = satisfaction.independence(table, min_expected)
    return df.select(
        F.round("statistic", 6).alias("statistic"),
        "dof",
        F.round("p_value", 9).alias("p_value"),
        F.round("cramers_v", 6).alias("cramers_v"),
        "groups",
        "observations",
    )


@query("chi2_independence", _chi2_sql(4))
def chi2_independence(spark: SparkSession, folder: str) -> DataFrame:
    """Statistic, degrees, p-value and Cramér's V over the languages with enough labels."""
    return _test_row(counts(spark, folder), 4)

@query("chi2_two_languages", _chi2_sql(5))
def chi2_two_languages(spark: SparkSession, folder: str) -> DataFrame:
    return _test_row(counts(spark, folder), 5)

@query("chi2_default_threshold", _chi2_sql(10))
def chi2_default_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return _test_row(counts(spark, folder))

@query(
    "chi2_residuals",
    f"""WITH {_tested_sql(4)}
SELECT * FROM ({" UNION ALL ".join(
    f"SELECT lang, '{n.upper()}' AS label, count_{n} AS observed, round(expected_{n}, 6) AS expected, "
    f"round((count_{n} - expected_{n}) / sqrt(expected_{n}), 6) AS residual FROM after"
    for n in satisfaction.NAMES
)})""",
)
def chi2_residuals(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(satisfaction.residual_table(counts(spark, folder), 4))

_LANGS = ["English", "French", "German", "Spanish"]

@query(
    "residual_heatmap",
    f"""WITH {_tested_sql(4)}, long AS ({" UNION ALL ".join(
        f"SELECT lang, '{n.upper()}' AS label, (count_{n} - expected_{n}) / sqrt(expected_{n}) AS residual FROM after"
        for n in satisfaction.NAMES
    )})
SELECT label, {", ".join(f"round(max(residual) FILTER (lang = '{x}'), 6) AS {x}" for x in _LANGS)}
FROM long GROUP BY label""",
)
def residual_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    """One row per label, one column per language with labels, kept by the test or not."""
    table = counts(spark, folder)
    languages = [r["lang"] for r in table.select("lang").orderBy("lang").collect()]  # few
    return rounded(transposed(satisfaction.residual_table(table, 4), "lang", languages))

_TEXT = "array_to_string(lines[1:3], ' ')"
_HIT = "(length(t) - length(replace(t, '{c}', '')) + 1)"

@query(
    "label_if_missing",
    f"""WITH {LABELLED_SQL},
docs AS (
  SELECT d.doc_id, x.lang, string_split(text, chr(10)) AS lines, x.satisfaction_label
  FROM documents d JOIN labelled x ON d.doc_id = x.doc_id
),
shares AS (
  SELECT *, [{", ".join(_HIT.format(c=c) for c in "ean")}] AS s FROM (SELECT *, {_TEXT} AS t FROM docs)
)
SELECT doc_id, lang, CASE WHEN satisfaction_label IS NOT NULL OR len(lines) < 3 THEN satisfaction_label
       ELSE ['NO', 'YES', 'NA'][list_position(s, list_max(s))] END AS satisfaction_label
FROM shares""",
)
def label_if_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Labels kept where known, scored where a conversation has three messages, else null."""
    corpus = documents_corpus(spark, folder).drop("openai_moderation")
    df = corpus.join(satisfaction_labels(spark, folder), "doc_id", "left")
    text = F.array_join(F.slice("conversation", 1, 3)["content"], " ")
    return label_missing(df, letter_sentiment_scores(text)).select(
        "doc_id", F.col("language").alias("lang"), "satisfaction_label"
    )
