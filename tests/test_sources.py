"""Round trips of corpora, result tables, matrices and reports."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tertulia.schema import ANNOTATED_TRIPLES, CORPUS, SATISFACTION_COUNTS
from tertulia import session
from tertulia.session import new_path, remove_written, shared_folder
from tertulia.sources.corpus import materialise, read_annotations, read_corpus, write_corpus
from tertulia.sources.results import read_table, write_matrix, write_report, write_table


def test_corpus_round_trip(spark, tmp_path):
    entry = {"categories": {"hate": True}, "category_scores": {"hate": 0.5}, "flagged": True}
    rows = [("h", "m", 1, False, "Irish", [{"content": "a", "role": "user"}], [entry])]
    path = write_corpus(spark.createDataFrame(rows, CORPUS), str(tmp_path / "corpus"))
    back = read_corpus(spark, path)
    assert back.schema == CORPUS
    assert back.first().openai_moderation[0].category_scores == {"hate": 0.5}
    with pytest.raises(Exception, match="exists"):
        write_corpus(back, path)


def test_annotations_round_trip(spark, tmp_path):
    rows = [([{"content": "a", "role": "user"}], "Irish", "completed", ["YES"])]
    path = write_corpus(spark.createDataFrame(rows, ANNOTATED_TRIPLES), str(tmp_path / "a"))
    assert read_annotations(spark, path).first()["response-satisfaction.responses"] == ["YES"]


def test_table_round_trip(spark, tmp_path):
    rows = [("a", 1, 2, 0, 3, 1 / 3, 2 / 3, 0.0), ("b", 0, 0, 1, 1, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, SATISFACTION_COUNTS)
    path = write_table(df, str(tmp_path / "t"), [F.desc("lang")])
    assert [tuple(r) for r in read_table(spark, path, SATISFACTION_COUNTS).collect()] == rows[::-1]
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 1


def test_matrix_and_report(spark, tmp_path):
    pairs = spark.createDataFrame(
        [("sexual/minors", "a", "b", 1.0, 0.25, False)],
        "measure string, lang_a string, lang_b string, z double, p_value double, significant boolean",
    )
    path = write_matrix(pairs, "sexual/minors", ["a", "b"], str(tmp_path))
    assert path.endswith("sexual_minors")
    back = spark.read.option("header", True).csv(path).orderBy("lang").collect()
    assert [tuple(r) for r in back] == [("a", "1.0", "0.25"), ("b", "0.25", "1.0")]
    report = write_report(pairs.select("z", "p_value"), str(tmp_path / "r"))
    line = next(f for f in os.listdir(report) if f.endswith(".json"))
    with open(os.path.join(report, line)) as f:
        assert json.loads(f.read()) == {"z": 1.0, "p_value": 0.25}


def test_intermediates_go_to_the_shared_folder(spark):
    folder = shared_folder(spark)
    assert new_path(spark, "x").startswith(folder)
    stored = materialise(spark.range(5), "numbers")
    assert stored.count() == 5
    assert all(folder in f for f in stored.inputFiles())


def test_what_a_run_has_written_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    path = write_corpus(spark.range(3), new_path(spark, "some"))
    assert spark.read.parquet(path).count() == 3
    assert remove_written(spark) and os.listdir(tmp_path) == []
    assert not remove_written(spark)
