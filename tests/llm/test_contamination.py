import re
import string

import duckdb
import pytest
from llm_rows import ROWS, documents, empty, long_text, pairs
from test_neardup import shingles

from tertulia.llm import contamination as C, sql

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(docs, tests, percent=80):
    out = []
    for d, t in docs:
        for i, x in tests:
            mine, theirs = shingles(t), shingles(x)
            n = len(words(x))
            if 0 < n < 5:  # a run of n words
                w = words(t)
                mine = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
                theirs = {tuple(words(x))}
            shared = len(mine & theirs)
            if theirs and 100 * shared >= percent * len(theirs):
                out.append((d, i, len(theirs), shared))
    return sorted(out, key=str)


def words(text):
    return [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0d]+", text or "")]


def found(marked):
    return sorted(
        ((r["doc_id"], *h) for r in marked.select("doc_id", "hits").collect() for h in r["hits"]), key=str
    )


def case():
    texts = [long_text(n, n).split() for n in (12, 15, 23, 31, 47, 64, 90)]
    tests = [(i, " ".join(w)) for i, w in enumerate(texts)]
    tests += [(50, None), (51, ""), (52, "two words"), (53, "two words"), (54, "Now then, HERE"), (55, "now"), (56, "a b c d"), (None, " ".join(texts[2]))]
    docs = [(0, long_text(3000, 77)), (1, None), (2, ""), (3, "Two WORDS"), (4, "some two words here now then"), (5, "x a b c d two words"), (6, "now then, here"), (7, "a b c"), (7, "NOW")]
    for i, w in enumerate(texts):
        body = long_text(500, 200 + i).split()
        for cut in range(0, 6):  # the start of the item is missing more and more
            docs.append((100 + 10 * i + cut, " ".join(body[:200] + w[cut:] + body[200:])))
        half = len(w) // 2  # the item in two places
        docs.append((100 + 10 * i + 6, " ".join(body[:100] + w[:half] + body[100:300] + w[half - 4 :] + body[300:])))
    return docs, tests


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_hits_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK_SHINGLES", block)
    docs, tests = case()
    marked = C.with_hits(pairs(spark, docs), items(spark, tests))
    assert found(marked) == brute(docs, tests)


def test_a_sketch_is_never_missed():
    for percent in (80, 90):
        for n in range(1, 300):
            k = C.sketch_size(n, percent)
            lacking = n - -(-percent * n // 100)
            assert k == n or k > lacking


def test_edge_rows(spark):
    docs = documents(spark)
    marked = C.with_hits(docs, items(spark, [(1, ROWS[0][1])]))
    assert [c for c in marked.columns if c != "hits"] == [c for c in docs.columns if c != "hits"]
    assert sorted(h[0] for h in found(marked)) == [1, 1, 2]
    clean = C.without_contaminated(docs, items(spark, [(1, ROWS[0][1])]))
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 3


def test_empty(spark):
    assert C.with_hits(empty(spark), items(spark, [(1, "a b c d e f")])).count() == 0
    docs = documents(spark)
    assert C.without_contaminated(docs, items(spark, [])).count() == len(ROWS)


def test_sql_of_short_items(spark):
    """The registered SQL, on rows with ids that are neither null nor repeated."""
    docs, tests = case()
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    tests = [(i, t) for i, (_, t) in enumerate(tests)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", tests)
    rows = con.execute(sql.CONTAMINATION).fetchall()
    assert sorted((r[:4] for r in rows), key=str) == brute(docs, tests)


@pytest.mark.parametrize("block", [1 << 20, 2])
def test_clashing_names_and_order_of_hits(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK_SHINGLES", block)
    docs = spark.createDataFrame([(1, "a b c d e f g", 7, 8, 9, "x")], "doc_id long, text string, __near int, __ROW int, __held int, HITS string")
    tests = items(spark, [(9, "a b c d e f"), (None, "b c d e f"), (3, "c d"), (3, "c d")])
    marked = C.with_hits(docs, tests)
    assert marked.columns == ["doc_id", "text", "__near", "__ROW", "__held", "hits"]
    row = marked.first()
    assert [h[0] for h in row["hits"]] == [None, 3, 3, 9] and tuple(row)[2:5] == (7, 8, 9)
