import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_rows import ROWS, documents, empty

from tertulia.llm import phrases as P

FIELDS = "lang", "rank", "phrase", "a", "l", "r", "n", "score"


def brute(rows, least, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            of = counts.setdefault(lang, Counter())
            for m in range(1, 6):
                of.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, of in counts.items():
        found = []
        for p, a in of.items():
            if len(p) < 2 or a < least:
                continue
            inside = any(
                b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in of.items()
                if b >= least
            )
            if not inside:
                score, k = min((1000 * a * totals[lang] // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus():
    draw = random.Random(5)
    words = ["a", "b", "C", "d\x00", "é", "ff", "g", "漢"]
    rows = []
    for i in range(120):
        lang = draw.choice(["x", "x", "x", "y", None, "und"])
        text = "".join(
            draw.choices(words, [9, 5, 3, 2, 1, 1, 1, 1])[0] + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"])
            for _ in range(draw.randint(0, 60))
        )
        rows.append((lang, text))
    return rows + [("x", "hot hot hot hot hot hot")] * 30 + [("x", "hot " + w) for w in words] * 3 + [("z", None)]


def found(spark, rows, least, top):
    df = spark.createDataFrame(rows, "lang string, text string")
    return sorted(tuple(r[c] for c in FIELDS) for r in P.collocations(df, least=least, top=top).collect())


@pytest.mark.parametrize("stretch", [40, 1 << 20])
def test_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(P, "STRETCH", stretch)
    rows = corpus()
    assert found(spark, rows, 4, 30) == brute(rows, 4, 30)


def test_hot_words_are_routed_deeper(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, text string")
    keys = P.key_counts(df.fillna("und", "lang").fillna("", "text")).where("n >= 3").select("key")
    suffixes = P.suffixes(df.fillna("und", "lang").fillna("", "text"), P.filter_of(keys)).where("phrase != ''")
    exact = {}
    for limit in (1, 3, 10_000):
        dealt = P.routed(suffixes, 4, limit)
        depths = {r["depth"] for r in dealt.select("depth").distinct().collect()}
        assert (max(depths) > 1) == (limit < 10_000)
        assert dealt.count() == suffixes.count()
        exact[limit] = sorted(map(tuple, P.phrase_counts(dealt, 3).collect()))
    assert exact[1] == exact[3] == exact[10_000]


def test_quicksort_counts():
    draw = np.random.default_rng(1)
    words = draw.integers(0, 3, (300, 5)).astype(np.int32)
    words[draw.random(300) < 0.4, 3:] = -1
    weight, depth = draw.integers(1, 4, 300), np.ones(300, int)
    wanted = Counter()
    for row, n in zip(words.tolist(), weight.tolist(), strict=True):
        for k in range(1, 6):
            if row[k - 1] >= 0:
                wanted[tuple(row[:k])] += n
    got = {tuple(words[i, :k].tolist()): n for i, k, n in P.sorted_counts(words, weight, depth, 9)}
    assert got == {p: n for p, n in wanted.items() if n >= 9}


def test_edge_rows(spark):
    docs = documents(spark)
    rows = [(None, t) for _, t in ROWS] * 2
    got = P.collocations(docs.union(docs).withColumn("lang", docs["score"]).drop("score"), least=4, top=50)
    wanted = [("old score", *r[1:]) for r in brute(rows, 4, 50)]
    assert sorted(tuple(r[c] for c in FIELDS) for r in got.collect()) == wanted and wanted
    assert P.collocations(empty(spark).withColumnRenamed("score", "lang"), least=2).count() == 0


def test_exact_beyond_64_bits(spark):
    rows = [("e", "p q r", 3, 4 * 10**12), ("e", "p q", 2, 5 * 10**12), ("e", "q r", 2, 5 * 10**12)]
    rows += [("e", w, 1, 6 * 10**12) for w in "pqr"]
    counts = spark.createDataFrame([(a, b, c, d) for a, b, c, d in rows], "lang string, phrase string, size long, n long")
    totals = spark.createDataFrame([("e", 9 * 10**14)], "lang string, n long")
    by = {r["phrase"]: r["score"] for r in P.cut_scores(counts, totals).collect()}
    assert by["p q r"] == 1000 * 4 * 10**12 * 9 * 10**14 // (5 * 10**12 * 6 * 10**12)
