"""Second-stage statistics recomputed from published aggregates."""

import math

import golden
import pytest
from pyspark.sql import functions as F

from tertulia.functions.tails import chi2_sf, normal_two_sided, student_t_two_sided
from tertulia.operators.contingency import chi2_independence, expected_counts
from tertulia.operators.correlation import correlations
from tertulia.operators.distribution import at_or_above_quantile
from tertulia.plans import satisfaction


def test_kruskal_p_values(spark):
    rows = spark.createDataFrame(golden.KRUSKAL, "h double, p double")
    out = rows.select("p", chi2_sf(F.col("h"), F.lit(golden.KRUSKAL_DF)).alias("ours")).collect()
    for r in out:
        assert r.ours == pytest.approx(r.p, rel=1e-12, abs=0)


def test_normal_and_student_tails(spark):
    z = spark.createDataFrame([(x / 4,) for x in range(0, 140)], "z double")
    for r in z.select("z", normal_two_sided(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)), rel=1e-12)
    t = spark.createDataFrame([(x / 3,) for x in range(1, 60)], "t double")
    one, two = F.lit(1.0), F.lit(2.0)
    for r in t.select(
        "t",
        student_t_two_sided(F.col("t"), one).alias("p1"),
        student_t_two_sided(F.col("t"), two).alias("p2"),
    ).collect():
        assert r.p1 == pytest.approx(2 / math.pi * math.atan2(1, r.t), rel=1e-11)
        assert r.p2 == pytest.approx(1 - r.t / math.sqrt(2 + r.t**2), rel=1e-9, abs=1e-13)


def _counts(spark):
    df = spark.createDataFrame(golden.SATISFACTION, "lang string, count_yes long, count_no long, count_na long")
    return df.withColumn("total", F.expr("count_yes + count_no + count_na"))


def test_chi_squared(spark):
    row = satisfaction.independence(_counts(spark)).first()
    assert row.statistic == pytest.approx(1736.8303212388387, rel=1e-12)
    assert (row.dof, row.p_value, row.groups, row.observations) == (36, 0.0, 19, 230810)
    assert row.cramers_v == pytest.approx(0.061339, abs=5e-7)


def test_expected_counts_after_dropping(spark):
    kept = satisfaction.kept(_counts(spark))
    row = expected_counts(kept, satisfaction.NAMES).where("lang = 'Norwegian'").first()
    assert row.expected_yes == pytest.approx(47.7759846, abs=1e-6)
    assert row.expected_no == pytest.approx(14.8177072, abs=1e-6)
    assert row.expected_na == pytest.approx(12.4063082, abs=1e-6)


def test_yates_correction_and_single_group(spark):
    two = spark.createDataFrame(
        [("a", 10, 20), ("b", 30, 5)], "lang string, count_yes long, count_no long"
    )
    row = chi2_independence(two, ["yes", "no"]).first()
    # by hand: sum of (|O - E| - 0.5)^2 / E
    e = [[30 * 40 / 65, 30 * 25 / 65], [35 * 40 / 65, 35 * 25 / 65]]
    o = [[10, 20], [30, 5]]
    want = sum(
        (abs(o[i][j] - e[i][j]) - 0.5) ** 2 / e[i][j] for i in range(2) for j in range(2)
    )
    assert row.dof == 1
    assert row.statistic == pytest.approx(want, rel=1e-12)
    one = chi2_independence(two.where("lang = 'a'"), ["yes", "no"]).first()
    assert (one.statistic, one.dof, one.p_value, one.cramers_v) == (0.0, 0, 1.0, None)


def test_correlations_over_languages(spark):
    words = spark.createDataFrame(golden.USER_WORDS, "lang string, words double")
    counts = spark.createDataFrame(golden.CONVERSATIONS, "lang string, n long")
    joined = words.join(counts, "lang")
    for buckets in (None, 5):
        out = {r.method: r for r in correlations(joined, "words", "n", buckets).collect()}
        assert out["pearson"].r == pytest.approx(0.171092, abs=5e-7)
        assert out["pearson"].p_value == pytest.approx(0.384027, abs=5e-7)
        assert out["spearman"].r == pytest.approx(0.510469, abs=5e-7)
        assert out["spearman"].p_value == pytest.approx(0.005512, abs=5e-7)


def test_nearest_quantile_keeps_four_languages(spark):
    counts = spark.createDataFrame(golden.CONVERSATIONS, "lang string, n long")
    for buckets in (None, 4):
        kept = at_or_above_quantile(counts, "n", 0.9, buckets).collect()
        assert {r.lang for r in kept} == {"English", "Portuguese", "Spanish", "French"}


def test_satisfaction_total(spark):
    assert _counts(spark).agg(F.sum("total")).first()[0] == 231041
