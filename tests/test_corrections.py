"""Rows that must not vanish, figures that must not lose digits, plans that must not move text."""

import math
import re

import numpy as np
import pytest
from compare import data_folder
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tertulia import session
from tertulia.operators import annotate, classify
from tertulia.operators.charts import score_histogram
from tertulia.operators.contingency import label_counts, transposed
from tertulia.operators.correlation import correlations, pearson
from tertulia.operators.messages import explode_messages
from tertulia.operators.ordering import bootstrap, positions
from tertulia.operators.ranktests import kruskal_wallis, matrix
from tertulia.schema import CORPUS
from tertulia.sources.corpus import write_corpus

FOLDER = data_folder("0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (None,)], "k long")
    found = sorted(r.position for r in positions(df, F.col("k")).collect())
    assert found == [0, 1, 2, 3]
    split = classify.split(df, F.col("k"), 4)
    assert split.count() == 4


def test_unlisted_values_stop_the_job(spark):
    df = spark.createDataFrame([("a", "YES"), ("a", "MAYBE")], "g string, label string")
    with pytest.raises(PySparkException, match="MAYBE"):
        label_counts(df, "g", "label").collect()
    codes = spark.createDataFrame([(0, 1), (0, 7)], "label int, prediction int")
    with pytest.raises(PySparkException, match="7"):
        classify.confusion_matrix(codes, "label", "prediction").collect()
    long = spark.createDataFrame([("x", "y", 0.5)], "row string, col string, p double")
    with pytest.raises(PySparkException, match="y"):
        matrix(long, ["x"]).collect()
    assert matrix(long).columns == ["lang", "y"]
    cells = spark.createDataFrame([("YES", "x", 1.0)], "label string, g string, residual double")
    assert transposed(cells, "g").columns == ["label", "x"]
    with pytest.raises(PySparkException, match="x"):
        transposed(cells, "g", ["z"]).collect()


def test_language_filter_of_the_registered_query_reaches_the_scan(spark, tmp_path):
    text = plan(entry_point.queries()["prepared_european"](spark, FOLDER))
    assert "RoundRobinPartitioning" not in text and "Exchange" not in text
    # from a stored corpus the list of languages is pushed into the reader
    from tertulia.operators.prepare import european, prepare

    path = write_corpus(spark.createDataFrame([], CORPUS), str(tmp_path / "corpus"))
    stored = plan(prepare(european(spark.read.parquet(path))))
    assert re.search(r"PushedFilters: \[.*In\(language", stored) and "Exchange" not in stored


def test_no_evaluation_row_is_in_a_fold(spark):
    df = spark.range(137)
    parts = {r.id: r.split for r in classify.split(df, F.col("id"), 137).collect()}
    folded = [r.id for r in classify.folds(df, F.col("id"), 137).collect()]
    assert len(folded) == int(0.8 * 137) + int(0.1 * 137)
    assert {parts[i] for i in folded} == {"train", "test"}


def test_splits_and_folds_move_no_row(spark):
    from tertulia.operators import ordering

    df = spark.range(3000).withColumn("text", F.repeat(F.lit("x"), 50))
    at = {r.id: r.position for r in ordering.positions(df, F.col("id")).collect()}
    split = classify.split(df, F.col("id"), 3000)
    folded = classify.folds(df, F.col("id"), 3000, k=7)
    assert "Exchange" not in plan(split) and "Exchange" not in plan(folded)
    part = {r.id: r.split for r in split.collect()}
    assert all(part[i] == ("train" if p < 2400 else "test" if p < 2700 else "eval") for i, p in at.items())
    by_position = sorted((at[r.id], r.fold) for r in folded.collect())
    assert [p for p, _ in by_position] == list(range(2700))
    assert [f for _, f in by_position] == [int(f) for f, x in enumerate(np.array_split(range(2700), 7)) for _ in x]


@pytest.mark.parametrize("digits", [1, 4])
def test_digests_at_places(spark, monkeypatch, digits):
    from tertulia.operators import ordering

    monkeypatch.setattr(ordering, "DIGITS", digits)
    df = spark.range(500).select(F.when(F.col("id") >= 40, F.col("id")).alias("k"))  # 40 null keys
    keys = sorted(r[0] for r in df.select(ordering.shuffle_key(F.col("k"))).collect())
    places = [0, 1, 77, 250, 499, 500, 600]
    for place, bound in zip(places, ordering.digests_at(df, F.col("k"), places), strict=True):
        smaller = sum(bound is None or k < bound for k in keys)
        assert smaller == min(place, 500) or keys[place - 1] == keys[place]
    assert ordering.digests_at(df.limit(0), F.col("k"), [0, 5]) == [None, None]
    nulls = keys.index(max(set(keys), key=keys.count))
    bound = ordering.digests_at(df, F.col("k"), [nulls + 7])[0]
    assert sum(k < bound for k in keys) == nulls


def test_values_on_a_bin_edge(spark):
    values = [i / 100 for i in range(101)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    assert sorted(r.bin for r in score_histogram(df, ["g"], "v").collect()) == list(range(101))


def test_null_arrays_have_no_messages(spark):
    text, entry = {"content": "a", "role": "user"}, {"categories": {}, "category_scores": {}, "flagged": False}
    rows = [("a", "m", 1, False, "x", c, m) for c, m in (([text], [entry]), (None, None), (None, [entry]), ([text], None))]
    assert explode_messages(spark.createDataFrame(rows, CORPUS), "language").count() == 1
    bad = spark.createDataFrame([("a", "m", 1, False, "x", [text, text], [entry])], CORPUS)
    with pytest.raises(PySparkException, match="differ in length"):
        explode_messages(bad, "language").collect()


def test_null_prompts_are_not_sent(spark):
    def load():
        def generate(texts):
            return np.array([t.upper() for t in texts], dtype=object)

        return generate

    df = spark.createDataFrame([(["a", None, "b"],), (None,)], "prompts array<string>")
    found = [r.generated for r in annotate.translate(df, load).collect()]
    assert found == [["A", None, "B"], [None, None, None]]


@pytest.mark.parametrize("n", [10**6, 10**11, 10**13])
def test_h_keeps_its_digits(spark, n):
    """Two halves whose mean ranks differ from the middle by a known gap."""
    gap = math.sqrt(0.0048 * (n + 1) / 12)
    middle, half = (n + 1) / 2, n // 2
    rows = [("m", "a", half, half * (middle - gap), 0.0), ("m", "b", half, half * (middle + gap), 0.0)]
    sums = spark.createDataFrame(rows, "measure string, lang string, n long, rank_sum double, tie_share double")
    assert kruskal_wallis(sums, "lang").first().h_statistic == pytest.approx(0.0048, rel=0.02)


def test_one_scan_gives_both_correlations(spark):
    draw = np.random.default_rng(1)
    rows = [(float(x), float(x + y)) for x, y in draw.integers(0, 9, (300, 2))] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    both = {r.method: r for r in correlations(df, "x", "y").collect()}
    alone = pearson(df, "x", "y").first()
    assert both["pearson"].r == pytest.approx(alone.r, abs=1e-12) and both["pearson"].n == 300
    assert both["pearson"].p_value == pytest.approx(alone.p_value, abs=1e-12)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert {r.r for r in correlations(flat, "x", "y").collect()} == {None}


def test_only_picked_vectors_move(spark):
    df = spark.range(500).select("id", F.array(F.col("id").cast("double")).alias("v"))
    sampled = bootstrap(df, F.col("id"), 20, 3, 500)
    assert sampled.count() == 60
    for line in plan(sampled).splitlines():
        assert not ("Exchange" in line and " v#" in line)


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
    Context.getCheckpointDir = lambda self: "hdfs://given"
    assert session.shared_folder(Session()) == "hdfs://given"


def test_a_head_keeps_known_labels(spark):
    from tertulia.catalog.tables import satisfaction

    known = {r.doc_id: r.satisfaction_label for r in satisfaction(spark, FOLDER).collect()}
    rows = entry_point.queries()["labelled_by_head"](spark, FOLDER).collect()
    for r in rows:
        if known.get(r.doc_id):
            assert r.satisfaction_label == known[r.doc_id]
        else:
            assert (r.satisfaction_label is None) == (r.chat_triples is None)
            assert r.chat_triples is None or len(r.chat_triples) == 3


@pytest.mark.parametrize("name", ["toxicity_projection", "toxicity_projection_assistant"])
def test_projected_axes_are_uncorrelated(spark, name):
    """Signs of the axes are free, their variances and covariance are not."""
    row = entry_point.queries()[name](spark, FOLDER).agg(
        F.covar_samp("x", "y"), F.var_samp("x"), F.var_samp("y")
    ).first()
    assert abs(row[0]) < 1e-9 * row[1] + 1e-15 and row[1] >= row[2] > 0


@pytest.mark.parametrize("t", [0.3, 2.0, 6.0])
def test_the_t_tail_is_smooth_where_its_form_changes(spark, t):
    from tertulia.functions.tails import student_t_two_sided

    df = spark.createDataFrame([(999_999.0,), (1_000_001.0,), (1e13,)], "df double")
    below, above, far = (r.p for r in df.select(student_t_two_sided(F.lit(t), F.col("df")).alias("p")).collect())
    assert above == pytest.approx(below, rel=1e-9)
    assert far == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-9)
