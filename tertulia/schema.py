"""Data model: table schemas and the fixed lookup values used by the analyses."""

from __future__ import annotations

from pyspark.sql import types as T

# Moderation categories, in published column order.
CATEGORIES = [
    "harassment",
    "harassment/threatening",
    "hate",
    "hate/threatening",
    "self-harm",
    "self-harm/instructions",
    "self-harm/intent",
    "sexual",
    "sexual/minors",
    "violence",
    "violence/graphic",
]

# Languages analysed and the region each is counted under.
LANGUAGE_REGIONS = {
    "Bulgarian": "Eastern",
    "Catalan": "Southern",
    "Croatian": "Central",
    "Czech": "Central",
    "Danish": "Northern",
    "Dutch": "Northern",
    "English": "Western",
    "Estonian": "Eastern",
    "Finnish": "Northern",
    "French": "Western",
    "Galician": "Southern",
    "German": "Western",
    "Greek": "Southern",
    "Hungarian": "Central",
    "Irish": "Western",
    "Italian": "Southern",
    "Latvian": "Eastern",
    "Lithuanian": "Eastern",
    "Maltese": "Southern",
    "Norwegian": "Northern",
    "Polish": "Central",
    "Portuguese": "Southern",
    "Romanian": "Eastern",
    "Slovak": "Central",
    "Slovenian": "Central",
    "Spanish": "Southern",
    "Swedish": "Northern",
    "Ukrainian": "Eastern",
}

# Label orders.
SENTIMENTS = ["negative", "neutral", "positive"]
SATISFACTION_LABELS = ["YES", "NO", "NA"]
SATISFACTION_CODES = {"YES": 1, "NO": 0, "NA": 2}

MESSAGE = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("role", T.StringType()),
    ]
)

# Category maps rather than an 11-field struct: a new category in a new drop of
# the source is then data for ``keep_known_categories``, not a schema change.
MODERATION = T.StructType(
    [
        T.StructField("categories", T.MapType(T.StringType(), T.BooleanType())),
        T.StructField("category_scores", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("flagged", T.BooleanType()),
    ]
)

CORPUS = T.StructType(
    [
        T.StructField("conversation_hash", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("turn", T.LongType()),
        T.StructField("redacted", T.BooleanType()),
        T.StructField("language", T.StringType()),
        T.StructField("conversation", T.ArrayType(MESSAGE)),
        T.StructField("openai_moderation", T.ArrayType(MODERATION)),
    ]
)

PREPARED_CORPUS = T.StructType(
    CORPUS.fields
    + [
        T.StructField("num_user_words", T.LongType()),
        T.StructField("num_assistant_words", T.LongType()),
        T.StructField("num_messages", T.LongType()),
    ]
)

ANNOTATED_TRIPLES = T.StructType(
    [
        T.StructField("chat_triples", T.ArrayType(MESSAGE)),
        T.StructField("language", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("response-satisfaction.responses", T.ArrayType(T.StringType())),
    ]
)

SATISFACTION_COUNTS = T.StructType(
    [T.StructField("lang", T.StringType())]
    + [
        T.StructField(name, T.LongType())
        for name in ("count_yes", "count_no", "count_na", "total")
    ]
    + [
        T.StructField(name, T.DoubleType())
        for name in ("percentage_yes", "percentage_no", "percentage_na")
    ]
)

# Measures of a scored message: one column per category, then their maximum and mean.
SCORE_COLUMNS = [f"{c}_score" for c in CATEGORIES]
MEASURES = SCORE_COLUMNS + ["max_toxicity_score", "avg_toxicity_score"]
