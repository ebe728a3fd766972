"""Edge rows: empty, null, tied, skewed and unusual inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tertulia.functions.arrays import argmax, mean_pool
from tertulia.functions.numeric import round_half_away
from tertulia.functions.scoring import batch_scores, labelled, letter_sentiment, letter_sentiment_scores
from tertulia.functions.text import after_last_marker, translation_prompt, word_count
from tertulia.operators import annotate, classify
from tertulia.operators.aggregate import category_codes, mean_and_std, mean_and_std_with_total, mode
from tertulia.operators.columns import augment, ensure_column, region, without
from tertulia.operators.contingency import label_counts
from tertulia.operators.distribution import quantiles, running_counts, value_histogram
from tertulia.operators.messages import (
    conversation_lengths,
    explode_messages,
    first_messages,
    message_scores,
    message_vectors,
    opened_by_user,
    triples,
    vectors_of_role,
)
from tertulia.operators.ordering import bootstrap, cap_per_group, keys_at, positions
from tertulia.operators.prepare import (
    add_lengths,
    clean_moderation,
    european,
    harmonise,
    keep_known_categories,
    moderation_state,
    opens_with_user,
    prepare,
)
from tertulia.operators.ranktests import (
    dunn,
    kruskal_wallis,
    long_measures,
    rank_sums,
    ranked_histogram,
    square,
)
from tertulia.operators.near_labels import near_label_silhouettes
from tertulia.operators.silhouette import silhouettes
from tertulia.plans import sentiment, toxicity
from tertulia.plans.preparation import sample_per_language
from tertulia.schema import CATEGORIES, CORPUS, MEASURES

TEXTS = ["", "  ", "one", " a b　c\u001cd ", "x\ty\nz", " lead", None, "é ü\u0085ö"]


def test_word_count_equals_python_split(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", word_count(F.col("t")).alias("n")).collect():
        assert r.n == (0 if r.t is None else len(r.t.split()))


def test_text_functions(spark):
    df = spark.createDataFrame(
        [("a English: b English:  \n c  ",), ("no marker ",)], "t string"
    )
    assert [r[0] for r in df.select(after_last_marker(F.col("t"))).collect()] == ["c", "no marker"]
    long = spark.createDataFrame([("é" * 300,)], "t string")
    prompt = long.select(translation_prompt(F.lit("Irish"), F.col("t"))).first()[0]
    assert prompt == "Irish: " + "é" * 200 + " English:"


def test_rounding_follows_the_arithmetic_rule(spark):
    values = [0.145, 0.125, 0.005, 1.005, -0.125, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ours = [r[0] for r in df.select(round_half_away(F.col("x"), 2)).collect()]
    want = [math.copysign(math.floor(abs(v) * 100 + 0.5) / 100, v) for v in values]
    assert ours == want


def _message(content, role="user"):
    return {"content": content, "role": role}


def _entry(scores, flagged=False):
    full = {c: scores for c in CATEGORIES} if not isinstance(scores, dict) else scores
    return {
        "categories": {c: False for c in full} if full is not None else None,
        "category_scores": full,
        "flagged": flagged,
    }


def _corpus(spark, rows):
    """rows: (hash, language, conversation, moderation)"""
    data = [(h, "m", 1, False, lang, conv, mod) for h, lang, conv, mod in rows]
    return spark.createDataFrame(data, CORPUS)


def test_preparation_rules(spark):
    five = "one two three four five"
    null_score = dict.fromkeys(CATEGORIES, 0.1) | {"hate": None}
    extra = dict.fromkeys(CATEGORIES, 0.1) | {"harassment/other": None}
    missing = {"categories": None, "category_scores": None, "flagged": True}
    df = _corpus(
        spark,
        [
            ("ok", "Irish", [_message(five)], [_entry(extra)]),
            ("short", "Irish", [_message("too short")], [_entry(0.1)]),
            ("assistant", "Irish", [_message(five, "assistant")], [_entry(0.1)]),
            ("empty", "Irish", [], []),
            ("null score", "Irish", [_message(five)], [_entry(null_score)]),
            ("missing", "Irish", [_message(five)], [missing]),
            ("foreign", "Chinese", [_message(five)], [_entry(0.1)]),
            ("no language", None, [_message(five)], [_entry(0.1)]),
        ],
    )
    assert {r[0] for r in prepare(df).select("conversation_hash").collect()} == {
        "ok",
        "foreign",
        "no language",
    }
    assert [r[0] for r in european(prepare(df)).select("conversation_hash").collect()] == ["ok"]
    states = {
        r[0]: r[1]
        for r in df.select(
            "conversation_hash", moderation_state(F.col("openai_moderation"))
        ).collect()
    }
    assert states["missing"] == "invalid" and states["null score"] == "null_score"
    assert states["empty"] == "ok" and states["ok"] == "ok"
    kept = clean_moderation(df).where("conversation_hash = 'ok'").first()
    assert set(kept.openai_moderation[0].category_scores) == set(CATEGORIES)
    emptied = (
        df.where("conversation_hash = 'missing'")
        .select(keep_known_categories(F.col("openai_moderation")).alias("m"))
        .first()
    )
    assert emptied.m[0].category_scores == {} and emptied.m[0].flagged is True
    row = add_lengths(df).where("conversation_hash = 'ok'").first()
    assert (row.num_user_words, row.num_assistant_words, row.num_messages) == (5, 0, 1)
    opened = df.where("conversation_hash = 'empty'").select(opens_with_user(F.col("conversation")))
    assert not opened.first()[0]


def test_harmonise_drops_and_renames(spark):
    df = _corpus(spark, [("x", "Irish", [_message("a")], [_entry(0.1)])])
    raw = df.withColumnRenamed("conversation_hash", "conversation_id").withColumn("country", F.lit("c"))
    out = harmonise(raw, {"conversation_id": "conversation_hash"})
    assert out.columns == [f.name for f in CORPUS.fields]


def test_message_tables(spark):
    conv = [_message("a b"), _message("c", "assistant"), _message("d")]
    df = _corpus(
        spark, [("x", "Irish", conv, [_entry(0.1), _entry(0.4), _entry({**dict.fromkeys(CATEGORIES, 0.2), "hate": None})])]
    )
    scored = message_scores(df, "language").orderBy("position").collect()
    assert [r.position for r in scored] == [0, 1]  # the message with a null score is dropped
    assert scored[1].max_toxicity_score == pytest.approx(0.4)
    vectors = df.select(message_vectors(F.col("openai_moderation")).alias("v"), "conversation")
    assert vectors.first().v[2][2] == 0.0
    users = vectors.select(vectors_of_role(F.col("conversation"), F.col("v"), "user")).first()[0]
    assert len(users) == 2
    assert len(triples(df).first().chat_triples) == 3
    one = _corpus(spark, [("y", "Irish", [_message("only")], [_entry(0.1)])])
    row = first_messages(one).first()
    assert (row.first_user_message, row.first_assistant_message) == ("only", None)
    assert triples(one).count() == 0


def test_unequal_arrays_stop_the_job(spark):
    df = _corpus(spark, [("x", "Irish", [_message("a"), _message("b")], [_entry(0.1)])])
    with pytest.raises(Exception, match="differ in length"):
        explode_messages(df).collect()


def test_lengths_from_messages_equal_nested(spark):
    rng = random.Random(3)
    rows, nested = [], []
    for c in range(30):
        conv = [
            _message(" ".join("w" * rng.randint(0, 9)), rng.choice(["user", "assistant", "system"]))
            for _ in range(rng.randint(1, 8))
        ]
        rows += [(str(c), i, m["role"], m["content"]) for i, m in enumerate(conv)]
        nested.append((str(c), "Irish", conv, [_entry(0.1)] * len(conv)))
    rng.shuffle(rows)
    flat = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    long = opened_by_user(conversation_lengths(flat))
    wide = add_lengths(_corpus(spark, nested).where(opens_with_user(F.col("conversation"))))
    names = ["num_user_words", "num_assistant_words", "num_messages"]
    assert sorted(map(tuple, long.select("conv_id", *names).collect())) == sorted(
        map(tuple, wide.select("conversation_hash", *names).collect())
    )


def _skewed(spark, n=3000, partitions=7):
    """A third of the rows are copies of one key in one group."""
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"),
        F.when(F.col("id") % 6 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"),
    )
    return df.repartition(partitions)


def test_cap_takes_the_smallest_keys_of_each_group(spark):
    import hashlib

    def digest(k):
        return hashlib.md5(f"{k}|42".encode()).hexdigest()

    df = _skewed(spark)
    rows = {}
    for r in df.collect():
        rows.setdefault(r.g, []).append(r.k)
    for n in (1, 50, 400, 5000):
        got = {}
        for r in cap_per_group(df, "g", F.col("k"), n).collect():
            got.setdefault(r.g, []).append(r.k)
        for g, keys in rows.items():
            assert sorted(got[g], key=digest) == sorted(keys, key=digest)[:n]


def test_cap_keeps_the_null_group_and_ignores_partitioning(spark):
    df = spark.createDataFrame([(None, i) for i in range(9)] + [("a", 1)], "g string, k int")
    first = cap_per_group(df, "g", F.col("k"), 4)
    again = cap_per_group(df.repartition(5), "g", F.col("k"), 4)
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    assert first.where("g IS NULL").count() == 4


def test_sample_per_language(spark):
    rows = [(str(i), "Irish", [_message("a")], [_entry(0.1)]) for i in range(12)]
    assert sample_per_language(_corpus(spark, rows), 5).count() == 5


def test_positions_are_dense_and_stable(spark):
    df = spark.range(5000)
    a = {r.id: r.position for r in positions(df, F.col("id")).collect()}
    b = {r.id: r.position for r in positions(df.repartition(3), F.col("id")).collect()}
    assert a == b and sorted(a.values()) == list(range(5000))


@pytest.mark.parametrize("rows", [1, 7, 3000, 90_000])
def test_keys_at_positions(spark, rows):
    df = spark.range(rows).withColumn("other", F.lit("x"))
    picks = spark.range(400).select(F.col("id").alias("n"), (F.col("id") * 7919 % (rows + 5)).alias("_pick"))
    at = {r.position: r.id for r in positions(df, F.col("id")).collect()}
    found = sorted((r.n, r._pick, r._picked) for r in keys_at(df, F.col("id"), picks, rows).collect())
    assert found == [(n, n * 7919 % (rows + 5), at[n * 7919 % (rows + 5)]) for n in range(400) if n * 7919 % (rows + 5) < rows]


def test_bootstrap_is_uniform(spark):
    """Chi-squared statistic of 20,000 draws of 50 rows: 49 degrees, 0.999 quantile 85.4."""
    drawn = bootstrap(spark.range(50), F.col("id"), draws=1000, subsets=20, rows=50)
    counts = [r["count"] for r in drawn.groupBy("id").count().collect()]
    assert len(counts) == 50 and sum(counts) == 20_000
    assert sum((n - 400) ** 2 / 400 for n in counts) < 85.4


def test_bootstrap_draws_with_replacement(spark):
    df = spark.range(40)
    rows = bootstrap(df, F.col("id"), draws=30, subsets=4, rows=40).collect()
    assert len(rows) == 120
    assert len({(r.subset, r.draw) for r in rows}) == 120
    assert len({r.id for r in rows if r.subset == 0}) < 30


def _mid_ranks(values):
    order = sorted(values)
    return {v: (order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in set(values)}


@pytest.mark.parametrize("buckets", [None, 3, 40])
def test_ranks_and_quantiles(spark, buckets):
    rng = random.Random(5)
    data = {
        "hot": [0.5] * 300 + [rng.random() for _ in range(60)],
        "few": [1.0, 2.0],
        "one": [7.0],
    }
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("hot", None), ("few", float("nan"))]
    df = spark.createDataFrame(rows, "g string, value double")
    hist = value_histogram(df, ["g"])
    ranked = running_counts(hist, ["g"], buckets=buckets)
    got = {}
    for r in ranked.collect():
        got.setdefault(r.g, {})[r.value] = r.upto - r.ties + (r.ties + 1) / 2
        assert r["size"] == len(data[r.g])
    assert got == {k: _mid_ranks(v) for k, v in data.items()}
    import numpy as np

    probs = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q9": 0.9, "q10": 1.0}
    for r in quantiles(hist, ["g"], probs, buckets=buckets).collect():
        for name, q in probs.items():
            assert r[name] == pytest.approx(np.quantile(data[r.g], q), rel=1e-12)


def test_nearest_quantile_of_one_to_28(spark):
    df = spark.range(1, 29).select(F.lit("a").alias("g"), F.col("id").alias("value"))
    hist = value_histogram(df, ["g"])
    assert quantiles(hist, ["g"], {"q": 0.9}, method="nearest", buckets=None).first().q == 25


def _brute_kruskal(groups):
    values = [v for g in groups.values() for v in g]
    ranks, n = _mid_ranks(values), len(values)
    ties = sum(values.count(v) ** 3 - values.count(v) for v in set(values))
    h = 12 / (n * (n + 1)) * sum(sum(ranks[v] for v in g) ** 2 / len(g) for g in groups.values())
    return (h - 3 * (n + 1)) / (1 - ties / (n**3 - n))


@pytest.mark.parametrize("buckets", [None, 4])
def test_rank_tests_against_brute_force(spark, buckets):
    rng = random.Random(11)
    groups = {g: [round(rng.gauss(i, 2), 1) for _ in range(20 + 9 * i)] for i, g in enumerate("abcd")}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, m double")
    sums = rank_sums(ranked_histogram(long_measures(df, "g", ["m"]), "g", buckets), "g")
    row = kruskal_wallis(sums, "g").first()
    assert row.h_statistic == pytest.approx(_brute_kruskal(groups), rel=1e-10)
    assert row.df == 3
    pairs = dunn(sums, "g")
    assert pairs.count() == 6
    full = {(r.row, r.col): r.p for r in square(pairs, "g").collect()}
    assert len(full) == 16
    assert all(full[a, b] == full[b, a] and full[a, b] <= 1 for a, b in full)
    assert all(full[a, a] == 1.0 for a in "abcd")
    total = sum(r.rank_sum for r in sums.collect())
    n = sum(map(len, groups.values()))
    assert total == pytest.approx(n * (n + 1) / 2)


def test_all_tied_and_single_group(spark):
    tied = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, m double")
    sums = rank_sums(ranked_histogram(long_measures(tied, "g", ["m"]), "g", None), "g")
    assert kruskal_wallis(sums, "g").first().h_statistic is None
    assert dunn(sums, "g").first().p_value is None
    one = spark.createDataFrame([("a", 1.0)], "g string, m double")
    sums = rank_sums(ranked_histogram(long_measures(one, "g", ["m"]), "g", None), "g")
    assert kruskal_wallis(sums, "g").first().p_value is None


def test_one_row_groups_have_no_deviation(spark):
    df = spark.createDataFrame([("a", "user", 1.0), ("b", "user", 2.0), ("b", "assistant", 4.0)], "lang string, role string, x double")
    assert mean_and_std(df, ["lang"], ["x"]).where("lang = 'a'").first().std_x is None
    rows = {(r.lang, r.role): r for r in mean_and_std_with_total(df, "lang", "role", ["x"]).collect()}
    assert rows["a", "all"].std_x is None and rows["b", "user"].std_x is None
    assert rows["b", "all"].avg_x == 3.0
    assert rows["b", "all"].std_x == pytest.approx(math.sqrt(2))


def test_role_totals_equal_the_doubled_rows(spark):
    df = spark.range(500).select(
        F.concat(F.lit("l"), F.col("id") % 3).alias("lang"),
        F.when(F.col("id") % 7 < 4, "user").otherwise("assistant").alias("role"),
        (F.lit(1e6) + F.sin("id")).alias("x"),
    )
    doubled = df.unionByName(df.withColumn("role", F.lit("all")))
    want = {tuple(r)[:2]: tuple(r)[2:] for r in mean_and_std(doubled, ["lang", "role"], ["x"]).collect()}
    got = {tuple(r)[:2]: tuple(r)[2:] for r in mean_and_std_with_total(df, "lang", "role", ["x"]).collect()}
    assert set(want) == set(got)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9)


def test_minimum_messages_counts_twice(spark):
    rows = [("a", "user", 0.1)] * 3 + [("b", "user", 0.2)] * 2 + [("c", "user", 0.3), ("c", "assistant", 0.1), ("c", "assistant", 0.2)]
    df = spark.createDataFrame(rows, "lang string, role string, s double")
    df = df.select("lang", "role", *[F.col("s").alias(m) for m in MEASURES])
    assert {r.lang for r in toxicity.languages_with_messages(df).collect()} == {"a", "c"}
    ranked = toxicity.ranked_scores(df)
    assert {r.lang for r in ranked.collect()} == {"a", "c"}
    assert ranked.where("measure = 'max_toxicity_score'").agg(F.sum("n")).first()[0] == 4


def test_absent_label_is_a_zero_column(spark):
    df = spark.createDataFrame([("a", "YES"), ("a", None), ("b", "NO")], "lang string, y string")
    rows = {r.lang: r for r in label_counts(df, "lang", "y").collect()}
    assert (rows["a"].count_na, rows["a"].total, rows["a"].percentage_yes) == (0, 1, 1.0)
    assert label_counts(df.where("y IS NULL"), "lang", "y").count() == 0


def test_mode_prefers_the_smallest_on_ties(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (1, 2), (1, 0), (2, 1)], "g int, label int")
    assert {(r.g, r["mode"]) for r in mode(df, ["g"], "label").collect()} == {(1, 0), (2, 1)}


def test_column_helpers(spark):
    df = spark.createDataFrame([("Irish", 1), ("Klingon", None)], "lang string, x int")
    assert without(df, "x", "absent").columns == ["lang"]
    assert ensure_column(df, "x", "int", 5).collect() == df.collect()
    assert [r.x for r in augment(df, "x", F.lit(9)).collect()] == [1, 9]
    assert [r[0] for r in df.select(region(F.col("lang"))).collect()] == ["Western", None]
    codes = {r.lang: r.code for r in category_codes(df, "lang").collect()}
    assert codes == {"Irish": 0.0, "Klingon": 0.5}


def test_pooling_with_an_empty_mask(spark):
    df = spark.createDataFrame(
        [([[1.0, 2.0], [3.0, 6.0]], [1.0, 1.0]), ([[1.0, 2.0], [3.0, 6.0]], [0.0, 0.0])],
        "t array<array<double>>, m array<double>",
    )
    got = [r[0] for r in df.select(mean_pool(F.col("t"), F.col("m"))).collect()]
    assert got == [[2.0, 4.0], [0.0, 0.0]]
    assert df.select(argmax(F.col("m"))).first()[0] == 0


def test_batch_model_equals_expression_and_skips_null(spark):
    df = spark.createDataFrame([("een",), (None,), ("",), ("xyz",)], "t string").repartition(2)
    both = df.select(
        "t",
        batch_scores(letter_sentiment, F.col("t"), 2).alias("a"),
        letter_sentiment_scores(F.col("t")).alias("b"),
        labelled(letter_sentiment_scores(F.col("t")), ["x", "y", "z"]).alias("c"),
    ).collect()
    for r in both:
        if r.t is None:
            assert r.a is None and r.b is None and r.c is None
        else:
            assert r.a == pytest.approx(r.b)


def test_sentiment_is_only_filled_where_missing(spark):
    conv = [_message("een"), _message("aaa", "assistant")]
    df = _corpus(spark, [("x", "Irish", conv, []), ("y", "Irish", conv[:1], [])])
    once = sentiment.add_sentiment(df)
    kept = [{"label": s, "score": 9.0} for s in sentiment.SENTIMENTS]
    marked = once.withColumn(
        "user_sentiment",
        F.when(
            F.col("conversation_hash") == "x",
            F.array(*[F.struct(F.lit(k["label"]).alias("label"), F.lit(k["score"]).alias("score")) for k in kept]),
        ),
    )
    rows = {r.conversation_hash: r for r in sentiment.add_sentiment(marked).collect()}
    assert rows["x"].user_sentiment[0].score == 9.0
    assert rows["y"].user_sentiment[0].score == pytest.approx(0.5)
    assert rows["y"].assistant_sentiment is None


def _brute_silhouette(points, labels):
    out = []
    for i, p in enumerate(points):
        by = {}
        for j, q in enumerate(points):
            if i != j:
                by.setdefault(labels[j], []).append(math.dist(p, q))
        others = [sum(v) / len(v) for k, v in by.items() if k != labels[i]]
        if labels[i] not in by:
            out.append(0.0)
            continue
        a, b = sum(by[labels[i]]) / len(by[labels[i]]), min(others)
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return out


@pytest.mark.parametrize("block_rows", [8, 1000])
def test_silhouettes_against_brute_force(spark, block_rows):
    rng = random.Random(2)
    points = [[rng.gauss(i % 3, 1) for _ in range(4)] for i in range(60)]
    points += [points[0]] * 30  # copies of one point
    labels = [i % 3 for i in range(60)] + [0] * 15 + [1] * 15
    points.append([9.0] * 4)
    labels.append(7)  # alone in its label
    rows = [(i, p, k) for i, (p, k) in enumerate(zip(points, labels))]
    df = spark.createDataFrame(rows, "id long, v array<double>, k int").repartition(5)
    got = {r.id: r.silhouette for r in silhouettes(df, "id", "v", "k", block_rows=block_rows).collect()}
    want = _brute_silhouette(points, labels)
    assert [got[i] for i in range(len(rows))] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("block_rows", [8, 1000])
def test_silhouettes_without_far_labels(spark, block_rows):
    rng = random.Random(3)
    points = [[rng.gauss(8 * (i % 6), 1) for _ in range(4)] for i in range(150)]
    labels = [f"l{i % 6}" for i in range(150)]
    points += [[rng.gauss(0, 9) for _ in range(4)] for _ in range(20)] + [points[0]] * 9 + [[99.0] * 4]
    labels += [f"l{rng.randrange(6)}" for _ in range(20)] + ["l0"] * 5 + ["l4"] * 4 + ["alone"]
    rows = [(i, p, k) for i, (p, k) in enumerate(zip(points, labels))]
    df = spark.createDataFrame([*rows, (-1, None, "l0"), (-2, points[0], None)], "id long, v array<double>, k string")
    got = {r.id: r for r in near_label_silhouettes(df.repartition(5), "id", "v", "k", block_rows).collect()}
    assert [got[i].silhouette for i in range(len(rows))] == pytest.approx(_brute_silhouette(points, labels), abs=1e-9)
    assert [got[i].label for i in range(len(rows))] == labels and len(got) == len(rows)
    clustered = [got[i].compared for i in range(150)]
    assert sum(clustered) < 0.5 * 150 * len(rows)
    alone = [(i, [float(i)], "x") for i in range(4)]
    one = spark.createDataFrame(alone, df.schema)
    assert [(r.silhouette, r.compared) for r in near_label_silhouettes(one, "id", "v", "k").collect()] == [(None, 4)] * 4
    assert near_label_silhouettes(one.limit(0), "id", "v", "k").count() == 0


def test_more_labels_than_are_sent(spark, monkeypatch):
    from tertulia.operators import near_labels

    monkeypatch.setattr(near_labels, "LABELS", 2)
    points = [[float(i * i % 17)] for i in range(30)]
    df = spark.createDataFrame([(i, p, i % 4) for i, p in enumerate(points)], "id long, v array<double>, k int")
    rows = sorted(near_label_silhouettes(df, "id", "v", "k").collect())
    want = _brute_silhouette(points, [i % 4 for i in range(30)])
    assert [r.silhouette for r in rows] == pytest.approx(want) and {r.compared for r in rows} == {30}


def test_silhouette_of_one_label_is_null(spark):
    df = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 0)], "id long, v array<double>, k int")
    assert {r.silhouette for r in silhouettes(df, "id", "v", "k").collect()} == {None}


def test_folds_and_baselines(spark):
    df = spark.range(95).select("id", (F.col("id") % 3 % 2).cast("int").alias("label"))
    folded = classify.folds(df, F.col("id"), 95)  # int(0.8 n) + int(0.1 n) = 85 of them
    sizes = sorted(r["count"] for r in folded.groupBy("fold").count().collect())
    assert sizes == [8] * 5 + [9] * 5
    rows = folded.collect()
    for r in classify.majority_baseline(folded).collect():
        inside = [x.label for x in rows if x.fold == r.fold]
        outside = [x.label for x in rows if x.fold != r.fold]
        best = min(set(outside), key=lambda k: (-outside.count(k), k))
        assert (r.prediction, r.rows) == (best, len(inside))
        assert r.accuracy == pytest.approx(inside.count(best) / len(inside))
    assert classify.split_sizes(95) == (76, 10, 9)


def test_head_arguments():
    with pytest.raises(ValueError):
        classify.head(0)
    with pytest.raises(ValueError):
        classify.head(3)
    with pytest.raises(ValueError):
        classify.head(2, inputs=4, weighted=True)


def test_labels_are_kept_filled_or_left_null(spark):
    conv = [_message("e"), _message("e", "assistant"), _message("e")]
    df = _corpus(spark, [("a", "Irish", conv, []), ("b", "Irish", conv[:2], []), ("c", "Irish", conv, [])])
    df = df.withColumn("satisfaction_label", F.when(F.col("conversation_hash") == "c", "YES"))
    for out in (
        annotate.label_missing(df, F.array(F.lit(0.1), F.lit(0.2), F.lit(0.7))),
        annotate.label_missing_by_model(df, lambda: lambda t: [[0.1, 0.2, 0.7]] * len(t)),
    ):
        rows = {r.conversation_hash: r.satisfaction_label for r in out.collect()}
        assert rows == {"a": "NA", "b": None, "c": "YES"}


def test_unannotated_compares_whole_triples(spark):
    conv = [_message("a"), _message("b", "assistant"), _message(None)]
    other = [_message("a"), _message("b", "assistant"), _message("c")]
    df = triples(_corpus(spark, [("x", "Irish", conv, []), ("y", "Irish", other, []), ("z", "Irish", conv, [])]))
    done = df.where("conversation_hash = 'x'").select("chat_triples")
    assert [r[0] for r in annotate.unannotated(df, done).select("conversation_hash").collect()] == ["y"]
