import random
import re

import pytest
from llm_rows import ROWS, documents, empty, long_text, pairs

from tertulia.llm import neardup as N
from tertulia.llm.stars import components


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    words = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows, percent=85):
    """component per doc_id by comparing every pair."""
    sets = {i: shingles(t) for i, t in rows}
    home = {i: i for i in sets}

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                home[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(words, draw, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**9)}"
    return " ".join(words)


def corpus(seed=1):
    """Groups of near copies with zero to six edits, exact copies, and single texts."""
    draw = random.Random(seed)
    texts = []
    for size in (60, 12, 12, 5, 3, 2):
        base = long_text(150, draw.randrange(10**6)).split()
        texts += [edited(base, draw, draw.randint(0, 6)) for _ in range(size)]
        texts += [" ".join(base)] * draw.randint(0, 8)
    texts += [long_text(40, s) for s in range(100, 130)] + ["short text"] * 4
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("small", [2, 16])
def test_components_of_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL", small)
    monkeypatch.setattr(N, "ROWS_OF_BLOCK", 16)
    rows = corpus()
    found = N.near_duplicates(pairs(spark, rows)).collect()
    wanted = brute(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == wanted
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_edge_rows(spark):
    found = N.near_duplicates(documents(spark)).collect()
    assert len(found) == len(ROWS)
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == [(6, 1, True)] * 2 and by[2] == [(6, 1, False)]
    assert by[3] == by[3] and by[3][0] == (0, 3, True) and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)]
    assert by[6] == [(1, 6, True)]
    assert sorted(by[None], key=str) == sorted([(1, 6, False), (0, None, True)], key=str)


def test_removal_keeps_columns_and_clean_rows(spark):
    docs = documents(spark)
    kept = N.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    # of the repeated row 1, its copy 2 and the copies of "word" one each stays
    wanted = [str(i) for i, t in ROWS if i not in (1, 2) and (i, t) != (None, "word")] + ["1"]
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == sorted(wanted)


def test_rows_of_one_id_are_judged_each(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    c = "some words that nothing else here has at all"
    rows = [(1, a), (2, a), (2, b), (3, b), (4, a), (4, c), (None, c), (None, "alone here"), (None, "alone here")]
    kept = N.without_near_duplicates(pairs(spark, rows)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (2, b), (4, c), (None, "alone here")], key=str)


def test_repeated_rows_are_one_node(spark):
    rows = [(5, "a b c d e f g h")] * 40 + [(6, "a b c d e f g h"), (7, "q r s t u v")]
    found = N.near_duplicates(pairs(spark, rows)).collect()
    assert sorted({(r["doc_id"], r["component_id"]) for r in found}) == [(5, 5), (6, 5), (7, 7)]
    assert len(found) == 42


def test_empty(spark):
    assert N.near_duplicates(empty(spark)).count() == 0


def test_stars(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)]
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3), (7, 7)]
    found = {r["a"]: r["b"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    home = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            home[max(x, y)] = min(x, y)
    assert {x: found.get(x, x) for x in home} == {x: root(x) for x in home}
