import math

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import CLASHING, ROWS, documents, empty, long_text, pairs

from tertulia.llm import classify as K, conv, toxicity as X

ENGLISH = "the and of with that this from here there when which would thing other about".split()
GERMAN = "der und die mit dass dies von hier dort wenn welche würde ding andere über".split()


def sentences(words, n, seed):
    draw = np.random.default_rng(seed)
    return [" ".join(draw.choice(words, 12)) for _ in range(n)]


def bilingual(spark, n=120):
    rows = [(i, t, "en") for i, t in enumerate(sentences(ENGLISH, n, 1))]
    rows += [(1000 + i, t, "de") for i, t in enumerate(sentences(GERMAN, n, 2))]
    rows += [(5000, "the and of", None), (5001, None, "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_windows_hold_every_run_of_bytes():
    shape = conv.Shape(2, widths=(4,), window=32)
    data = np.frombuffer(long_text(60).encode(), np.uint8)
    offsets = np.array([0, 0, 31, 32, 65, len(data)])
    found, _, left, first = conv.windows(data, offsets, shape)
    assert left[first].tolist() == [min(32, b - a) for a, b in zip(offsets, offsets[1:], strict=False)]
    for k, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
        stop = first[k + 1] if k + 1 < len(first) else len(found)
        mine = {bytes(w[i : i + 4]) for w, n in zip(found[first[k] : stop], left[first[k] : stop], strict=True) for i in range(n - 3)}
        assert mine == {bytes(data[i : i + 4]) for i in range(a, b - 3)}


def test_a_long_text_in_parts_scores_as_in_one(monkeypatch):
    model = conv.trained(sentences(ENGLISH, 20, 1) + sentences(GERMAN, 20, 2), np.repeat([0, 1], 20), conv.Shape(2, window=64), 1)
    text = pa.array([" ".join(sentences(GERMAN, 4000, 5))])
    whole = np.concatenate(list(conv.scores(model, text)))
    monkeypatch.setattr(conv, "PIECE", 5000)
    assert np.allclose(whole, np.concatenate(list(conv.scores(model, text))), atol=1e-4)


def test_language(spark):
    fitted = K.fit_language(bilingual(spark), sample=200, epochs=6)
    assert fitted[0] == ["de", "en"]
    held = [(i, t) for i, t in enumerate(sentences(ENGLISH, 40, 8) + sentences(GERMAN, 40, 9))]
    found = {r[0]: r[1] for r in K.with_language(pairs(spark, held), fitted).select("doc_id", "lang_pred").collect()}
    assert np.mean([found[i] == ("en" if i < 40 else "de") for i, _ in held]) > 0.95
    docs = documents(spark)
    out = K.with_language(docs, fitted)
    rows = out.select("doc_id", "text", "lang_pred", "score").collect()
    assert len(rows) == len(ROWS) and set(CLASHING) - {"Score"} <= set(out.columns)
    for _, text, language, score in rows:
        assert 0 <= score <= 1
        assert (language == "und") == (not any(c.isalpha() for c in text or ""))
    assert K.with_language(empty(spark), fitted).count() == 0


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert K.fit_language(none) is None
    assert {r[0] for r in K.with_language(documents(spark), None).select("lang_pred").collect()} == {"und"}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert K.fit_quality(documents(spark), labels) is None
    assert {r[0] for r in K.with_quality(documents(spark), None).select("score").collect()} == {0.5}
    assert X.fit_toxicity(documents(spark), labels) is None
    assert {r[0] for r in X.with_toxicity(documents(spark), None).select("score").collect()} == {0.0}


def labelled(spark, column, good, bad):
    rows = list(enumerate(good + bad))
    labels = [(i, int(i < len(good))) for i, _ in rows] + [(None, 1), (10**6, None), (10**7, 1)]
    other = "toxic" if column == "quality" else "quality"
    return pairs(spark, rows), spark.createDataFrame(labels, f"doc_id long, {column} int").selectExpr(
        "doc_id", column, f"0 as {other}"
    )


def test_quality(spark):
    good = sentences(ENGLISH, 150, 3)
    bad = [" ".join(w + "###" for w in t.split()) for t in sentences(ENGLISH, 60, 4)]
    bad += [(w + " ") * 20 for w in ENGLISH * 4]
    docs, labels = labelled(spark, "quality", good, bad)
    model = K.fit_quality(docs, labels, epochs=10)
    fresh = sentences(ENGLISH, 30, 5) + [" ".join(w + "###" for w in t.split()) for t in sentences(GERMAN, 30, 6)]
    found = {r[0]: r[1] for r in K.with_quality(pairs(spark, list(enumerate(fresh))), model).select("doc_id", "score").collect()}
    assert np.mean([(found[i] >= 0.3) == (i < 30) for i in found]) > 0.95
    rows = K.with_quality(documents(spark), model).select("score").collect()
    assert len(rows) == len(ROWS) and all(0 <= r[0] <= 1 for r in rows)
    assert K.with_quality(empty(spark), model).count() == 0


def test_toxicity(spark):
    draw = np.random.default_rng(1)

    def rude(texts):
        out = []
        for t in texts:
            words = t.split()
            words[draw.integers(len(words))] = draw.choice(["moron", "zorkling", "zorkest", "zorkian"])
            out.append(" ".join(words))
        return out

    docs, labels = labelled(spark, "toxic", rude(sentences(ENGLISH, 200, 3)), sentences(ENGLISH, 200, 4))
    fitted = X.fit_toxicity(docs, labels)
    fresh = rude(sentences(ENGLISH, 40, 5)) + sentences(ENGLISH, 40, 6)
    found = {r[0]: r[1] for r in X.with_toxicity(pairs(spark, list(enumerate(fresh))), fitted).select("doc_id", "score").collect()}
    assert np.mean([(found[i] >= 0.5) == (i < 40) for i in found]) > 0.95
    rows = X.with_toxicity(documents(spark), fitted).select("score").collect()
    assert len(rows) == len(ROWS) and all(0 <= r[0] <= 1 for r in rows)
    assert X.with_toxicity(empty(spark), fitted).count() == 0


def test_counts_add_up_over_parts(monkeypatch):
    counter = X.Counter(np.sort(X.splitter().of(np.frombuffer(b"abc", np.uint8))[2]))
    text = "You ABC!! a1b abc... loooong SHOUT x-y " * 500
    whole = next(counter.counts(pa.array([text])))
    one = dict(zip(X.COUNTS, (whole[0] / 500).tolist(), strict=True))
    assert one["hits"] == 2 and one["near"] == 2 and one["capital_words"] == 2
    assert one["points"] == 5 and one["signs"] == 1 and one["joints"] == 1 and one["runs"] == 2
    rows = np.concatenate(list(counter.counts(pa.array(["abc", None, "", "You abc"]))))
    assert rows[:, X.COUNTS.index("hits")].tolist() == [1, 0, 0, 1]
    assert rows[:, X.COUNTS.index("near")].tolist() == [0, 0, 0, 1]


def test_isotonic_is_the_least_squares_fit():
    z = np.array([1.0, 2, 3, 4, 5, 5])
    xs, ys = X.isotonic(z, np.array([0, 1, 0, 1, 1, 0.0]), np.ones(6))
    assert np.all(np.diff(ys) >= 0)
    assert np.allclose(np.interp(z, xs, ys), [0, 0.5, 0.5, 2 / 3, 2 / 3, 2 / 3])


@pytest.mark.parametrize("n", [2, 4, 16])
def test_chi_square(n):
    from tertulia.llm.neighbours import chi_square_quantile

    x = chi_square_quantile(0.9, n)
    below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(n // 2))
    assert abs(below - 0.9) < 1e-9


def mixed_texts():
    draw = np.random.default_rng(6)
    texts = ["", "abc!", "you aa", "aa b", "aaaaaaaa", "hello wide world", None, "ab" * 300, "!!!", "a"]
    texts += ["".join(draw.choice(list("abcdefg you!*.AB "), int(n))) for n in draw.integers(1, 1500, 60)]
    return texts + texts[:20]


def all_scores(of, texts):
    return np.concatenate(list(of(pa.array(texts, pa.string()))))


def networks():
    draw, texts = np.random.default_rng(1), sentences(ENGLISH, 20, 1) + sentences(GERMAN, 20, 2)
    shape = conv.Shape(2, widths=(4, 6), filters=4, window=64, with_max=True, repeats=True)
    model = conv.trained(texts, draw.integers(0, 2, 40), shape, 1)
    return model, lambda column: conv.scores(model, column)


def test_network_scores_depend_on_the_row_alone(monkeypatch):
    _, of = networks()
    texts = mixed_texts()
    alone = np.concatenate([all_scores(of, [t]) for t in texts])
    assert (all_scores(of, texts) == alone).all()
    assert (all_scores(of, texts[::-1])[::-1] == alone).all()
    long = [" ".join(sentences(GERMAN, 300, 5)) + "xy" * 500 + " ".join(sentences(ENGLISH, 300, 6))]
    whole = all_scores(of, long)
    monkeypatch.setattr(conv, "PIECE", 5000)
    assert (all_scores(of, texts) == alone).all()
    assert np.allclose(all_scores(of, long), whole, atol=1e-12)


def naive_scores(model, text):
    """The network's forward pass, one byte at a time."""
    raw, shape = text.encode(), model.shape
    code = [raw[i : i + 4] if i + 4 <= len(raw) else None for i in range(len(raw))]
    seen = [c is not None and any(i >= lag and code[i - lag] == c for lag in range(2, conv.LAGS + 1)) for i, c in enumerate(code)]
    level = [sum(seen[max(0, i - conv.NEAR + 1) : i + 1]) * (conv.LEVELS - 1) // conv.NEAR for i in range(len(raw))]
    total, most, size, at = 0, 0, 0, 0
    while True:
        part = raw[at : at + shape.window]
        n = max(1, len(part))
        window = part + bytes(shape.window - len(part))
        marks = level[at : at + len(part)] + [0] * (shape.window - len(part))
        h = []
        for k, width in enumerate(shape.widths):
            table = model.tables[k].astype(float)
            h.append(np.maximum(0, np.max([
                sum(table[j, window[i + j]] for j in range(width)) + model.levels[k][marks[i + width - 1]]
                for i in range(shape.window - width + 1)
            ], axis=0)))
        h = np.concatenate(h)
        total, most, size = total + n * h, np.maximum(most, h), size + n
        if at + shape.window >= len(raw):
            break
        at += shape.step
    z = np.concatenate([total / size, most]) @ model.dense + model.bias
    return np.exp(z) / np.exp(z).sum()


def test_forward_pass_of_brute_force():
    model, of = networks()
    texts = ["", "a", "hello wide world", "abab" * 40, sentences(GERMAN, 3, 5)[0] * 3]
    assert np.allclose(all_scores(of, texts), [naive_scores(model, t) for t in texts], atol=1e-4)


def naive_counts(text, words):
    counter, raw = X.Counter(words), text.encode()
    is_letter = [bool(X.LETTER[b]) for b in raw]
    spans, i = [], 0
    while i < len(raw):
        j = i
        while j < len(raw) and is_letter[j]:
            j += 1
        if j > i:
            spans.append((i, j))
        i = max(j, i + 1)
    low = raw.lower()
    split = X.splitter()
    key = lambda b: int(split.of(np.frombuffer(b, np.uint8))[2][0])
    known = set(words.tolist())
    hit = [
        key(low[a:b]) in known or any(b - a > n and (key(low[a : a + n]) + n) % 2**64 in known for n in X.BEGINNINGS)
        for a, b in spans
    ]
    second = {key(w.encode()) for w in X.SECOND_PERSON}
    person = [key(low[a:b]) in second for a, b in spans]
    near = [h and any(person[max(0, i - X.NEAR) : i + X.NEAR + 1]) for i, h in enumerate(hit)]
    inner = [i for i in range(1, len(raw) - 1) if is_letter[i - 1] and is_letter[i + 1]]
    del counter
    return [
        len(raw), sum(is_letter), len(spans), sum(hit), sum(near), sum(bool(X.CAPITAL[b]) for b in raw),
        sum(b - a > 2 and all(X.CAPITAL[x] for x in raw[a:b]) for a, b in spans),
        sum(bool(X.POINT[b]) for b in raw), raw.count(b"!"), sum(bool(X.SIGN[raw[i]]) for i in inner),
        sum(bool(X.JOINT[raw[i]]) for i in inner), sum(low[i - 1] == low[i] == low[i + 1] for i in inner),
    ]


def test_toxicity_counts_of_brute_force(monkeypatch):
    texts = [t or "" for t in mixed_texts()] + ["YOU ARE b*d, yoou! aaab", "you " + "b " * 40 + "you bad"]
    words = np.unique(X.splitter().of(np.frombuffer(b"abc bad aa b ab", np.uint8))[2])
    of = X.Counter(words).counts
    wanted = np.array([naive_counts(t, words) for t in texts])
    assert (all_scores(of, texts) == wanted).all()
    assert (all_scores(of, texts[::-1])[::-1] == wanted).all()
    from tertulia.llm import words as W

    monkeypatch.setattr(X, "PIECE", 200)
    monkeypatch.setattr(W, "PIECE", 200)
    assert (all_scores(of, texts) == wanted).all()


def test_label_samples_are_bounded(spark):
    rows = [(None, f"text {i}", "en") for i in range(3000)] + [(7, f"again {i}", "en") for i in range(3000)]
    rows += [(i, f"other {i}", "de" if i % 2 else "en") for i in range(100, 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    picked = K.balanced(df, "lang", "doc_id", 100).collect()
    assert all(r["doc_id"] is not None for r in picked)
    assert len({(r["doc_id"], r["lang"]) for r in picked}) == len(picked) and 40 < len(picked) <= 100
    again = K.balanced(df.repartition(7), "lang", "doc_id", 100).collect()
    assert sorted(map(tuple, picked)) == sorted(map(tuple, again))
