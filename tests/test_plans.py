"""Plan shapes that must hold for the jobs to scale."""

import re

import pytest
from compare import data_folder
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tertulia.operators.columns import analysis_names
from tertulia.operators.messages import conversation_lengths
from tertulia.operators.ordering import cap_per_group
from tertulia.operators.prepare import european, prepare
from tertulia.plans import length
from tertulia.schema import CATEGORIES, CORPUS
from tertulia.sources.corpus import read_corpus, write_corpus

FOLDER = data_folder("0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    scores = dict.fromkeys(CATEGORIES, 0.1)
    entry = {"categories": {}, "category_scores": scores, "flagged": False}
    text = {"content": "one two three four five", "role": "user"}
    rows = [(str(i), "m", 1, False, "Irish", [text], [entry]) for i in range(20)]
    path = str(tmp_path_factory.mktemp("plans") / "corpus")
    return read_corpus(spark, write_corpus(spark.createDataFrame(rows, CORPUS), path))


def test_preparation_never_shuffles(corpus):
    prepared = prepare(european(corpus))
    assert "Exchange" not in plan(prepared)
    assert prepared.count() == 20


def test_language_filter_reaches_the_scan(corpus):
    assert re.search(r"PushedFilters: \[.*In\(language", plan(european(corpus)))


def test_unused_columns_are_not_read(corpus):
    lengths = prepare(corpus).select("language", "num_user_words", "num_messages")
    schema = re.findall(r"ReadSchema: struct<(.*)", plan(lengths))[0]
    assert "conversation_hash" not in schema and "model" not in schema
    counts = length.conversations_per_language(analysis_names(corpus))
    assert "conversation:" not in plan(counts)


def test_cap_is_limited_before_each_shuffle(corpus):
    capped = plan(cap_per_group(corpus.select("language", "conversation_hash"), "language", F.col("conversation_hash"), 5))
    assert capped.count("WindowGroupLimit") >= 4
    assert "BroadcastHashJoin" in capped


def test_message_lengths_are_combined_before_the_shuffle(spark):
    messages = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    text = plan(conversation_lengths(messages))
    assert text.count("partial_sum") >= 2 and "collect_list" not in text
    # texts stay on the map side
    exchange = text[: text.index("Exchange hashpartitioning")]
    assert "text#" not in exchange


@pytest.mark.parametrize(
    "name",
    ["kruskal_wallis", "dunn_pairs", "toxicity_by_lang_role", "sentiment_by_language", "satisfaction_pivot"],
)
def test_one_scan_of_the_documents(spark, name):
    text = plan(entry_point.queries()[name](spark, FOLDER))
    assert text.count("documents.parquet") == (0 if name == "dunn_pairs" else 1)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
