import sys
from zlib import crc32

import corpus_pipeline
import pytest
from llm_rows import long_text
from pyspark.sql import functions as F
from test_neardup import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, FOLDER)
        assert found.columns == columns, name
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        kept = {r["doc_id"] for r in found.collect()}
        assert kept < set(before) or kept == set(before)
        if name == "near_duplicates":
            wanted = brute(list(before.items()))
            assert kept == {i for i, (_, home) in wanted.items() if i == home}
        path = corpus_pipeline.written(found, "test-stage")
        docs = path
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in docs.collect()}


def test_language_rejects_texts_with_letters(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["lang"]: r["text"] for r in docs.where("length(text) between 400 and 2000").collect()}
    names = sorted(texts)
    mixed = [f"{texts[a][:400]} {texts[b][:400]}" for a in names for b in names if a < b]
    strange = ["ข้อความภาษาไทย", "שלום עולם"]
    added = [(10**6 + i, t) for i, t in enumerate(strange + mixed)]
    more = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in added], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.union(more), FOLDER).collect()}
    lost = {t for i, t in added if i not in kept}
    assert lost == set(strange)
    assert kept >= {r["doc_id"] for r in docs.where(F.col("text").rlike(r"\p{L}")).collect()}


def test_least_language_score():
    for n in range(3, 200):
        assert 1 / n < corpus_pipeline.least_language(n) < 0.5
    assert corpus_pipeline.least_language(2) == 0.5 and corpus_pipeline.least_language(1) < 1


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "?! 123"), (4, long_text(30)), (5, long_text(30))]])
def test_edge_tables(spark, tmp_path, rows):
    docs = [(i, t, "en", "s", 0) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found <= {4} and (not rows or 4 in found or not any(crc32(str(i).encode()) % 4 != 2 for i, _ in rows))


def test_the_entry_lists_every_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_the_entry_works_without_the_operators(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = importlib.reload(entry).queries()
    monkeypatch.undo()
    assert names and not any(n.startswith("op") and n[2:3].isdigit() for n in names)
    importlib.reload(entry)
