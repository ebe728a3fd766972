"""Queries: embeddings and silhouettes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tertulia.catalog.length import rounded
from tertulia.catalog.registry import query
from tertulia.catalog.tables import PARTS_SQL, documents_corpus, hash_number_sql, shuffle_key_sql, table
from tertulia.functions.arrays import doubles
from tertulia.operators.classify import project_2d
from tertulia.operators.columns import analysis_names
from tertulia.operators.embedding import neighbourhood_map
from tertulia.operators.near_labels import near_label_silhouettes
from tertulia.operators.silhouette import by_label, silhouettes
from tertulia.plans import topics
from tertulia.sources.corpus import materialise

WIDTH = 16


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, label, embedding as doubles)."""
    return table(spark, folder, "embeddings").withColumn("embedding", doubles(F.col("embedding")))


@query(
    "sentence_embeddings",
    f"""WITH {PARTS_SQL},
words AS (
  SELECT doc_id, conversation_hash, lang, unnest(list_filter(regexp_split_to_array(lines[1], '\\s+'),
         lambda w: w <> '')) AS w FROM parts
),
slots AS (SELECT conversation_hash, CAST(concat('0x', left(md5(w), 4)) AS INTEGER) % {WIDTH} AS slot FROM words)
SELECT p.conversation_hash, {", ".join(
    f"round(count(slot) FILTER (slot = {i}) / greatest(CAST(count(slot) AS DOUBLE), 1), 9) AS e{i}"
    for i in range(WIDTH)
)} FROM parts p LEFT JOIN slots s ON p.conversation_hash = s.conversation_hash
GROUP BY p.conversation_hash""",
)
def sentence_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings of first messages, written once and read back."""
    corpus = analysis_names(documents_corpus(spark, folder)).drop("openai_moderation")
    embedded = topics.embed_first_message(corpus).select("conversation_hash", "sentence_embeddings")
    stored = materialise(embedded, "embeddings")
    return rounded(
        stored.selectExpr(
            "conversation_hash", *[f"sentence_embeddings[{i}] AS e{i}" for i in range(WIDTH)]
        ),
        9,
    )


_TOKENS_SQL = """tokens AS (
  SELECT vec_id, embedding, list_transform(range(0, 8), lambda t:
         CASE WHEN embedding[t * 8 + 1] > 0 THEN 1.0 ELSE 0.0 END) AS mask FROM embeddings
)"""


@query(
    "mean_pooling",
    f"""WITH {_TOKENS_SQL}
SELECT vec_id, {", ".join(
    "round((" + " + ".join(
        f"CAST(embedding[{t * 8 + d + 1}] AS DOUBLE) * mask[{t + 1}]" for t in range(8)
    ) + f") / greatest(list_sum(mask), 1e-9), 9) AS p{d}" for d in range(8)
)} FROM tokens""",
)
def mean_pooling(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector read as eight tokens of width eight, masked by their first entry."""
    tokens = vectors(spark, folder).selectExpr(
        "vec_id",
        "transform(sequence(0, 7), t -> slice(embedding, t * 8 + 1, 8)) AS token_embeddings",
        "transform(sequence(0, 7), t -> IF(embedding[t * 8] > 0, 1D, 0D)) AS attention_mask",
    )
    pooled = topics.pooled(tokens)
    return rounded(
        pooled.selectExpr("vec_id", *[f"sentence_embeddings[{i}] AS p{i}" for i in range(8)]), 9
    )


def _silhouette_sql(source: str, by: str = "") -> str:
    """CTE ``sil``: the textbook definition over all pairs of ``source`` (id, label, v)."""
    part = f"{by}, " if by else ""
    same = f"AND x.{by} = y.{by}" if by else ""
    px = f"x.{by}, " if by else ""
    return f"""pair AS (
  SELECT {px}x.id, x.label, y.label AS other, sum(list_distance(x.v, y.v)) AS d, count(*) AS m
  FROM {source} x JOIN {source} y ON true {same} GROUP BY ALL
),
ab AS (
  SELECT {part}id, label, max(m) FILTER (other = label) AS own,
         max(CASE WHEN other = label AND m > 1 THEN d / (m - 1) END) AS a,
         min(d / m) FILTER (other <> label) AS b
  FROM pair GROUP BY ALL
),
sil AS (
  SELECT {part}id, label, CASE WHEN b IS NULL THEN NULL WHEN own = 1 THEN 0.0
         WHEN greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s
  FROM ab
)"""


_VECTORS_SQL = "vec AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(
    "silhouette_per_row",
    f"""WITH {_VECTORS_SQL}, {_silhouette_sql("vec")}
SELECT id, label, round(s, 7) AS silhouette FROM sil""",
)
def silhouette_per_row(spark: SparkSession, folder: str) -> DataFrame:
    df = silhouettes(vectors(spark, folder), "vec_id", "embedding", "label")
    return rounded(df, 7)


@query(
    "silhouette_near_labels",
    f"""WITH {_VECTORS_SQL}, {_silhouette_sql("vec")}
SELECT id, label, round(s, 7) AS silhouette FROM sil""",
)
def silhouette_near_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The same figures, labels that are too far away left out."""
    df = near_label_silhouettes(vectors(spark, folder), "vec_id", "embedding", "label")
    return rounded(df.drop("compared"), 7)


@query(
    "silhouette_by_label",
    f"""WITH {_VECTORS_SQL}, {_silhouette_sql("vec")}
SELECT label, round(avg(s), 7) AS avg_silhouette_score, round(stddev_pop(s), 7) AS std_silhouette_score,
       count(s) AS rows
FROM sil GROUP BY label""",
)
def silhouette_by_label(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(
        by_label(silhouettes(vectors(spark, folder), "vec_id", "embedding", "label")), 7
    )


# 20 samples of 5 %, drawn with replacement by hash
_BOOTSTRAP_SQL = f"""size AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.05) AS BIGINT) AS m FROM embeddings),
placed AS (
  SELECT row_number() OVER (ORDER BY {shuffle_key_sql("vec_id")}) - 1 AS position, label,
         CAST(embedding AS DOUBLE[]) AS v FROM embeddings
),
draws AS (
  SELECT subset, draw AS id, {hash_number_sql("concat(subset, '/', draw)", 12)} % n AS position
  FROM (SELECT n, m, unnest(range(0, 20)) AS subset FROM size) AS a, LATERAL (SELECT unnest(range(0, m)) AS draw)
),
vec AS (SELECT subset, id, label, v FROM draws JOIN placed ON draws.position = placed.position)"""


def _bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    return topics.bootstrap_scores(
        vectors(spark, folder), F.col("vec_id"), "embedding", "label", fraction=0.05
    )


@query(
    "bootstrap_silhouette",
    f"""WITH {_BOOTSTRAP_SQL}, {_silhouette_sql("vec", "subset")},
each AS (SELECT subset, label, avg(s) AS a, stddev_pop(s) AS d FROM sil GROUP BY subset, label)
SELECT label, round(avg(a), 7) AS avg_silhouette_score, round(avg(d), 7) AS std_silhouette_score,
       count(*) AS subsets
FROM each GROUP BY label""",
)
def bootstrap_silhouette(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(topics.by_language(_bootstrap(spark, folder)), 7)


@query(
    "bootstrap_silhouette_overall",
    f"""WITH {_BOOTSTRAP_SQL}, {_silhouette_sql("vec", "subset")},
each AS (SELECT subset, avg(s) AS a, stddev_pop(s) AS d FROM sil GROUP BY subset)
SELECT 'mean over subsets' AS figure, round(avg(a), 7) AS avg_silhouette_score,
       round(avg(d), 7) AS std_silhouette_score FROM each
UNION ALL
SELECT 'last subset', round(a, 7), round(d, 7) FROM each WHERE subset = 19""",
)
def bootstrap_silhouette_overall(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(topics.summary(_bootstrap(spark, folder)), 7)


@query("embedding_projection")
def embedding_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors in two dimensions with their label."""
    return project_2d(vectors(spark, folder), "embedding").select("vec_id", "label", "x", "y")


@query("embedding_map")
def embedding_map(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's place on a map that keeps neighbours together, with its label."""
    rows = vectors(spark, folder)
    places = neighbourhood_map(rows, "vec_id", "embedding", epochs=40).withColumnRenamed("id", "vec_id")
    return rows.select("vec_id", "label").join(places, "vec_id")
