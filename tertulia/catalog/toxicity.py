"""Queries: moderation scores, rank tests, score distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tertulia.catalog.length import rounded
from tertulia.catalog.registry import query
from tertulia.catalog.tables import (
    LANG_SQL,
    LETTERS,
    MESSAGES_SQL,
    SCORED_SQL,
    chi2_sf_sql,
    documents_corpus,
    share_sql,
    table,
)
from tertulia.functions.numeric import round_half_away
from tertulia.operators.charts import density, density_binned, score_histogram, violin
from tertulia.operators.classify import project_2d
from tertulia.operators.columns import analysis_names
from tertulia.operators.distribution import AUTO
from tertulia.operators.embedding import neighbourhood_map
from tertulia.operators.messages import message_scores, message_vectors, vectors_of_role
from tertulia.operators.ranktests import (
    dunn,
    kruskal_wallis,
    long_measures,
    matrix,
    rank_sums,
    ranked_histogram,
    square,
)
from tertulia.plans import toxicity
from tertulia.schema import CATEGORIES, MEASURES


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return analysis_names(documents_corpus(spark, folder))


def scored(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    return message_scores(corpus(spark, folder), "lang", *keep)


_ROUND_2 = "sign(value) * floor(abs(value) * 100 + 0.5) / 100"


@query(
    "message_scores",
    f"""WITH {SCORED_SQL}
SELECT conversation_hash, lang, CAST(position AS INTEGER) AS position, role,
       CAST(length(content) AS INTEGER) AS chars, {", ".join(
    f'round("{m}", 9) AS "{m}"' for m in MEASURES
)} FROM scored""",
)
def message_scores_query(spark: SparkSession, folder: str) -> DataFrame:
    df = scored(spark, folder, "conversation_hash").withColumn("chars", F.length("message"))
    return rounded(df.drop("message"), 9)


_DOUBLED_SQL = """doubled AS (
  SELECT * FROM scored UNION ALL
  SELECT * REPLACE ('all' AS role) FROM scored
)"""


@query(
    "toxicity_by_lang_role",
    f"""WITH {SCORED_SQL}, {_DOUBLED_SQL}
SELECT lang, role, {", ".join(
    f'round(avg("{m}"), 7) AS "avg_{m}", round(stddev_samp("{m}"), 7) AS "std_{m}"' for m in MEASURES
)} FROM doubled GROUP BY lang, role""",
)
def toxicity_by_lang_role(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(toxicity.table(scored(spark, folder), digits=None), 7)


@query(
    "toxicity_table",
    f"""WITH {SCORED_SQL}, {_DOUBLED_SQL}
SELECT lang, role, {", ".join(
    f'round(avg("{m}"), 5) AS "avg_{m}", round(stddev_samp("{m}"), 5) AS "std_{m}"' for m in MEASURES
)} FROM doubled GROUP BY lang, role""",
)
def toxicity_table(spark: SparkSession, folder: str) -> DataFrame:
    """The published form: five decimals."""
    return toxicity.table(scored(spark, folder))


@query(
    "toxicity_vectors",
    f"""WITH {MESSAGES_SQL}
SELECT lang, role, count(*) AS vectors, {", ".join(
    f'round(sum({share_sql(x)}), 6) AS "{c}"' for x, c in zip(LETTERS, CATEGORIES)
)} FROM msg GROUP BY lang, role""",
)
def toxicity_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Score vectors split by role, counted and summed per language."""
    df = corpus(spark, folder).withColumn("vectors", message_vectors(F.col("openai_moderation")))
    parts = [
        F.struct(
            F.lit(role).alias("role"),
            vectors_of_role(F.col("conversation"), F.col("vectors"), role).alias("vectors"),
        )
        for role in ("user", "assistant")
    ]
    rows = df.select("lang", F.inline(F.array(*parts))).select(
        "lang", "role", F.explode("vectors").alias("v")
    )
    sums = [F.sum(F.get("v", F.lit(i))).alias(c) for i, c in enumerate(CATEGORIES)]
    return rounded(rows.groupBy("lang", "role").agg(F.count(F.lit(1)).alias("vectors"), *sums))


@query(
    "eligible_languages",
    f"""WITH {MESSAGES_SQL}
SELECT lang, 2 * count(*) AS num_messages FROM msg GROUP BY lang HAVING 2 * count(*) >= 2000""",
)
def eligible_languages(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.languages_with_messages(scored(spark, folder), 2000)


_RANKED_SQL = f"""{SCORED_SQL},
eligible AS (SELECT lang FROM scored GROUP BY lang HAVING 2 * count(*) >= 5),
long AS (
  UNPIVOT (SELECT lang, {", ".join(f'"{m}"' for m in MEASURES)} FROM scored
           WHERE role = 'user' AND lang IN (SELECT lang FROM eligible))
  ON {", ".join(f'"{m}"' for m in MEASURES)} INTO NAME measure VALUE value
),
rounded AS (SELECT measure, lang AS grp, {_ROUND_2} AS value FROM long)"""

_TEST_SQL = """ranked AS (
  SELECT measure, grp, value,
         rank() OVER (PARTITION BY measure ORDER BY value)
           + (count(*) OVER (PARTITION BY measure, value) - 1) / 2.0 AS mid_rank,
         count(*) OVER (PARTITION BY measure, value) AS ties
  FROM rounded
),
tie AS (SELECT measure, sum(CAST(ties AS DOUBLE) * ties * ties - ties) AS t FROM (
          SELECT DISTINCT measure, value, ties FROM ranked) GROUP BY measure),
sums AS (SELECT measure, grp, count(*) AS n, sum(mid_rank) AS r FROM ranked GROUP BY measure, grp),
totals AS (
  SELECT s.measure, CAST(sum(n) AS DOUBLE) AS total, count(*) AS k, sum(r * r / n) AS q, any_value(t) AS t
  FROM sums s JOIN tie ON s.measure = tie.measure GROUP BY s.measure
),
h AS (
  SELECT measure, k - 1 AS df,
         CASE WHEN t < total * total * total - total THEN
           (12 / (total * (total + 1)) * q - 3 * (total + 1)) / (1 - t / (total * total * total - total))
         END AS h
  FROM totals
),
pairs AS (
  SELECT a.measure, a.grp AS grp_a, b.grp AS grp_b,
         abs(a.r / a.n - b.r / b.n) / sqrt((total * (total + 1) / 12 - t / (12 * (total - 1)))
           * (1.0 / a.n + 1.0 / b.n)) AS z, k
  FROM sums a JOIN sums b ON a.measure = b.measure AND a.grp < b.grp
  JOIN totals ON totals.measure = a.measure
)"""

_DUNN_P_SQL = f"least(1.0, k * (k - 1) / 2 * {chi2_sf_sql('z * z', '1')})"


@query(
    "score_value_ranks",
    f"""WITH {_RANKED_SQL}, {_TEST_SQL}
SELECT DISTINCT measure, value, ties, CAST(mid_rank AS DOUBLE) AS mid_rank FROM ranked""",
)
def score_value_ranks(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.value_ranks(toxicity.ranked_scores(scored(spark, folder)))


@query(
    "kruskal_wallis",
    f"""WITH {_RANKED_SQL}, {_TEST_SQL}
SELECT measure, round(h, 6) AS h_statistic, df, round({chi2_sf_sql("h", "df")}, 9) AS p_value FROM h""",
)
def kruskal_wallis_query(spark: SparkSession, folder: str) -> DataFrame:
    df = toxicity.kruskal_table(toxicity.ranked_scores(scored(spark, folder)))
    return df.select(
        "measure",
        F.round("h_statistic", 6).alias("h_statistic"),
        "df",
        F.round("p_value", 9).alias("p_value"),
    )


def _dunn_rows(df: DataFrame, group: str = "lang") -> DataFrame:
    return df.select(
        "measure",
        F.col(f"{group}_a").alias("grp_a"),
        F.col(f"{group}_b").alias("grp_b"),
        F.round("z", 6).alias("z"),
        F.round("p_value", 7).alias("p_value"),
        "significant",
    )


_DUNN_SELECT_SQL = f"""SELECT measure, grp_a, grp_b, round(z, 6) AS z, round({_DUNN_P_SQL}, 7) AS p_value,
       {_DUNN_P_SQL} < 0.05 AS significant FROM pairs"""


@query("dunn_pairs", f"WITH {_RANKED_SQL}, {_TEST_SQL} {_DUNN_SELECT_SQL}")
def dunn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _dunn_rows(toxicity.dunn_table(toxicity.ranked_scores(scored(spark, folder))))


_LANGS = ["English", "French", "German", "Spanish"]


@query(
    "dunn_matrix",
    f"""WITH {_RANKED_SQL}, {_TEST_SQL},
entry AS (
  SELECT grp_a AS lang, grp_b AS other, {_DUNN_P_SQL} AS p FROM pairs WHERE measure = 'max_toxicity_score'
  UNION ALL
  SELECT grp_b, grp_a, {_DUNN_P_SQL} FROM pairs WHERE measure = 'max_toxicity_score'
  UNION ALL
  SELECT grp, grp, 1.0 FROM sums WHERE measure = 'max_toxicity_score'
)
SELECT lang, {", ".join(f"round(max(p) FILTER (other = '{x}'), 7) AS {x}" for x in _LANGS)}
FROM entry GROUP BY lang""",
)
def dunn_matrix(spark: SparkSession, folder: str) -> DataFrame:
    pairs = toxicity.dunn_table(
        toxicity.ranked_scores(scored(spark, folder), measures=["max_toxicity_score"])
    )
    return rounded(matrix(square(pairs, "lang")), 7)


@query(
    "significant_pairs",
    f"""WITH {_RANKED_SQL}, {_TEST_SQL}
SELECT measure, count(*) AS pairs, count(*) FILTER ({_DUNN_P_SQL} < 0.05) AS significant_pairs
FROM pairs GROUP BY measure""",
)
def significant_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = toxicity.dunn_table(toxicity.ranked_scores(scored(spark, folder)))
    return toxicity.significant_pairs(pairs)


def _tests_of(source: str, group: str, value: str) -> str:
    return (
        f"rounded AS (SELECT '{value}' AS measure, {group} AS grp, CAST({value} AS DOUBLE) AS value "
        f"FROM {source}), {_TEST_SQL}"
    )


_EVENTS_SQL = _tests_of("events", "event_type", "value")


def _event_sums(spark: SparkSession, folder: str) -> DataFrame:
    long = long_measures(table(spark, folder, "events"), "event_type", ["value"])
    return rank_sums(ranked_histogram(long, "event_type"), "event_type")


@query(
    "kruskal_wallis_events",
    f"""WITH {_EVENTS_SQL}
SELECT measure, round(h, 6) AS h_statistic, df, round({chi2_sf_sql("h", "df")}, 9) AS p_value FROM h""",
)
def kruskal_wallis_events(spark: SparkSession, folder: str) -> DataFrame:
    """Unrounded values: ranks over ordered buckets."""
    df = kruskal_wallis(_event_sums(spark, folder), "event_type")
    return df.select(
        "measure",
        F.round("h_statistic", 6).alias("h_statistic"),
        "df",
        F.round("p_value", 9).alias("p_value"),
    )


@query("dunn_events", f"WITH {_EVENTS_SQL} {_DUNN_SELECT_SQL}")
def dunn_events(spark: SparkSession, folder: str) -> DataFrame:
    return _dunn_rows(dunn(_event_sums(spark, folder), "event_type"), "event_type")


@query(
    "kruskal_wallis_documents",
    f"""WITH docs AS (SELECT {LANG_SQL} AS lang, n_chars FROM documents),
{_tests_of("docs", "lang", "n_chars")}
SELECT measure, round(h, 6) AS h_statistic, df, round({chi2_sf_sql("h", "df")}, 9) AS p_value FROM h""",
)
def kruskal_wallis_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        F.col("lang"), F.col("n_chars").cast("double").alias("n_chars")
    )
    sums = rank_sums(ranked_histogram(long_measures(docs, "lang", ["n_chars"]), "lang"), "lang")
    df = kruskal_wallis(sums, "lang")
    return df.select(
        "measure",
        F.round("h_statistic", 6).alias("h_statistic"),
        "df",
        F.round("p_value", 9).alias("p_value"),
    )


@query(
    "score_histogram",
    f"""WITH {SCORED_SQL}
SELECT lang, role, CAST(floor(round(max_toxicity_score / 0.01, 9)) AS BIGINT) AS bin, count(*) AS n
FROM scored GROUP BY ALL""",
)
def score_histogram_query(spark: SparkSession, folder: str) -> DataFrame:
    return score_histogram(scored(spark, folder), ["lang", "role"], "max_toxicity_score")


def _violin_sql(role: str, measure: str) -> str:
    return f"""WITH {SCORED_SQL}
SELECT lang, round(median({measure}), 9) AS median, count(*) AS rows, round(min({measure}), 9) AS minimum,
       round(max({measure}), 9) AS maximum, round(avg({measure}), 9) AS mean
FROM scored WHERE role = '{role}' GROUP BY lang"""


def _violin(role: str, measure: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        messages = scored(spark, folder).where(F.col("role") == role)
        return rounded(violin(messages, "lang", measure, buckets=AUTO), 9)

    return run


for _role in ("user", "assistant"):
    for _measure in ("max_toxicity_score", "avg_toxicity_score"):
        query(f"violin_{_role}_{_measure}", _violin_sql(_role, _measure))(_violin(_role, _measure))


def _density_sql(role: str, measure: str) -> str:
    return f"""WITH {SCORED_SQL},
v AS (SELECT lang, round({measure}, 2) AS x FROM scored WHERE role = '{role}'),
s AS (SELECT lang, count(*) AS n, min(x) AS lo, max(x) AS hi,
             stddev_samp(x) * pow(count(*), -0.2) AS h FROM v GROUP BY lang),
g AS (SELECT *, lo + (hi - lo) * point / 99.0 AS spot
      FROM (SELECT *, CAST(unnest(range(0, 100)) AS INTEGER) AS point FROM s WHERE h > 0))
SELECT g.lang, point, round(any_value(spot), 6) AS x,
       round(sum(exp(-0.5 * ((spot - x) / h) * ((spot - x) / h)) / (n * h * sqrt(2 * pi()))), 5) AS density
FROM g JOIN v ON g.lang = v.lang GROUP BY g.lang, point"""


def _density(role: str, measure: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        """Scores are rounded first, so there are about a hundred values to spread."""
        messages = scored(spark, folder).where(F.col("role") == role)
        short = messages.withColumn(measure, round_half_away(F.col(measure), 2))
        return density(short, "lang", measure).select(
            "lang", "point", F.round("x", 6).alias("x"), F.round("density", 5).alias("density")
        )

    return run


for _role in ("user", "assistant"):
    for _measure in ("max_toxicity_score", "avg_toxicity_score"):
        _name = f"score_density_{_role}_{_measure}"
        query(_name, _density_sql(_role, _measure))(_density(_role, _measure))
query("score_density", _density_sql("user", "max_toxicity_score"))(_density("user", "max_toxicity_score"))


_BINNED_SQL = f"""WITH {SCORED_SQL},
v AS (SELECT lang, avg_toxicity_score AS x FROM scored WHERE role = 'user' AND avg_toxicity_score IS NOT NULL),
s AS (SELECT lang, count(*) AS n, min(x) AS lo, max(x) AS hi,
             stddev_samp(x) * pow(count(*), -0.2) AS h FROM v GROUP BY lang HAVING max(x) > min(x)),
p AS (SELECT lang, (x - lo) * 32 / h AS place FROM v JOIN s USING (lang)),
b AS (SELECT lang, bin, sum(weight) AS weight FROM (
        SELECT lang, floor(place) AS bin, 1 - (place - floor(place)) AS weight FROM p UNION ALL
        SELECT lang, floor(place) + 1, place - floor(place) FROM p)
      GROUP BY lang, bin),
g AS (SELECT *, CAST(unnest(range(0, 100)) AS INTEGER) AS point FROM s)
SELECT g.lang, point, round(any_value(lo + point * (hi - lo) / 99.0), 6) AS x,
       round(sum(weight / n / (h * sqrt(2 * pi()))
             * exp(-0.5 * pow(point * (hi - lo) / 99.0 / h - bin / 32.0, 2))), 5) AS density,
       round(any_value(1 / (h * sqrt(2 * pi())) / 8192.0), 9) AS error
FROM g JOIN b ON g.lang = b.lang GROUP BY g.lang, point"""


@query("score_density_binned", _BINNED_SQL)
def score_density_binned(spark: SparkSession, folder: str) -> DataFrame:
    """Density of unrounded scores, with the bound of its distance from the direct sum."""
    messages = scored(spark, folder).where(F.col("role") == "user")
    found = density_binned(messages, "lang", "avg_toxicity_score")
    return found.select(
        "lang", "point", F.round("x", 6).alias("x"), F.round("density", 5).alias("density"), F.round("error", 9).alias("error")
    )


def _role_vectors(spark: SparkSession, folder: str, role: str) -> DataFrame:
    df = corpus(spark, folder).withColumn("vectors", message_vectors(F.col("openai_moderation")))
    found = vectors_of_role(F.col("conversation"), F.col("vectors"), role)
    return df.select("conversation_hash", "lang", F.posexplode(found).alias("position", "vector"))


def _map(role: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        """Score vectors of one role's messages on a map that keeps neighbours together."""
        key = F.xxhash64("conversation_hash", "position")
        rows = _role_vectors(spark, folder, role).withColumn("id", key)
        places = neighbourhood_map(rows, "id", "vector", epochs=40)
        return rows.drop("vector").join(places, "id").drop("id")

    return run


def _projection(role: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        """Score vectors of one role's messages in two dimensions, with their language."""
        return project_2d(_role_vectors(spark, folder, role), "vector").drop("vector")

    return run


query("toxicity_projection")(_projection("user"))
query("toxicity_projection_assistant")(_projection("assistant"))
query("toxicity_map")(_map("user"))
query("toxicity_map_assistant")(_map("assistant"))
