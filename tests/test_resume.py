"""Scoring that goes on where a stopped run ended, and the Bloom filter of the anti-join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tertulia.functions.scoring import batch_scores
from tertulia.operators.annotate import unannotated, unannotated_prefiltered
from tertulia.operators.bloom import MOST_BLOCKS, blocks_for, bloom_table, with_possible
from tertulia.sources.resume import finished, scored_in_parts


def stored(spark, path, first, n, files):
    rows = spark.range(first, first + n).select("id", F.concat(F.lit("text "), "id").alias("text"))
    rows.repartition(files).write.mode("append").parquet(path)


def scorer(calls, stop_at=None):
    """Lengths by a model that notes each text it is sent; the driver's part ``stop_at`` fails."""
    seen = []

    def make():
        def predict(texts):
            with open(calls, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return np.array([[float(len(t))] for t in texts])

        return predict

    def score(df):
        seen.append(1)
        if len(seen) == stop_at:
            raise RuntimeError("stopped")
        return df.select("id", F.get(batch_scores(make, F.col("text")), F.lit(0)).alias("score"))

    return score


def noted(calls):
    return sorted(calls.read_text().split("\n")[:-1])


def test_a_restart_scores_only_what_is_not_done(spark, tmp_path):
    source, path, calls = str(tmp_path / "in"), str(tmp_path / "out"), tmp_path / "calls"
    stored(spark, source, 0, 500, 6)
    with pytest.raises(RuntimeError):
        scored_in_parts(spark, source, scorer(calls, 4), path, files_a_part=1)
    assert len(finished(spark, path)) == 3
    before = noted(calls)
    assert 0 < len(before) < 500
    # a part that was written, in whole or in half, but not named
    spark.createDataFrame([(-1, -1.0)], "id long, score double").write.parquet(f"{path}/results/half")
    found = scored_in_parts(spark, source, scorer(calls), path, files_a_part=2)
    rows = sorted((r["id"], r["score"]) for r in found.collect())
    assert rows == [(i, float(len(f"text {i}"))) for i in range(500)]
    assert noted(calls) == sorted(f"text {i}" for i in range(500))  # each text was sent once in all
    scored_in_parts(spark, source, scorer(calls), path).count()
    assert len(noted(calls)) == 500
    stored(spark, source, 500, 50, 1)  # a new file is scored, the others are not
    assert scored_in_parts(spark, source, scorer(calls), path).count() == 550
    assert len(noted(calls)) == 550


def test_a_run_of_few_parts_and_a_model_that_fails(spark, tmp_path):
    source, path, calls = str(tmp_path / "in put"), str(tmp_path / "out"), tmp_path / "calls"
    stored(spark, source, 0, 100, 4)

    def broken(df):
        return df.select("id", F.raise_error(F.lit("no model")).cast("double").alias("score"))

    with pytest.raises(Exception, match="no model"):
        scored_in_parts(spark, source, broken, path)
    assert finished(spark, path) == {}
    part = scored_in_parts(spark, source, scorer(calls), path, files_a_part=1, most_parts=1)
    assert 0 < part.count() < 100
    assert scored_in_parts(spark, source, scorer(calls), path, files_a_part=3).count() == 100


def test_partitioned_and_empty_sources(spark, tmp_path):
    source = str(tmp_path / "by")
    spark.range(20).select("id", (F.col("id") % 3).alias("k")).write.partitionBy("k").parquet(source)
    found = scored_in_parts(spark, source, lambda df: df.select("id", "k"), str(tmp_path / "a"), files_a_part=1)
    assert sorted(map(tuple, found.collect())) == [(i, i % 3) for i in range(20)]
    empty = str(tmp_path / "empty")
    spark.range(0).write.parquet(empty)
    found = scored_in_parts(spark, empty, lambda df: df.withColumn("s", F.lit(1)), str(tmp_path / "b"))
    assert found.columns == ["id", "s"] and found.count() == 0


@pytest.mark.parametrize("n", [0, 1, 20_000])
def test_filter_loses_no_key_and_rules_out_most_others(spark, n):
    blocks = blocks_for(n)
    table = bloom_table(spark.range(n), "id", blocks)
    asked = spark.range(2 * max(n, 1000))
    found = with_possible(asked, "id", table, blocks, "possible").groupBy(F.col("id") < n).agg(
        F.avg(F.col("possible").cast("int")), F.count(F.lit(1))
    )
    share = {r[0]: (r[1], r[2]) for r in found.collect()}
    if n:
        assert share[True] == (1.0, n)
    assert share[False][0] < 0.01 and sum(c for _, c in share.values()) == asked.count()


def test_filter_is_bounded():
    assert blocks_for(0) == 1 and blocks_for(10**12) == MOST_BLOCKS


def test_prefiltered_anti_join(spark):
    kind = "id int, chat_triples array<struct<content:string,role:string>>"
    rows = [(i, [(f"t{i % 400}", "user"), (None, "assistant")]) for i in range(3000)]
    df = spark.createDataFrame([*rows, (-1, None), (-2, []), (-2, [])], kind)
    for done in (df.where("id < 100"), df.where("id < 0"), df.where("id = 1 OR id = 401"), df.limit(0), df):
        got = sorted(r["id"] for r in unannotated_prefiltered(df, done).collect())
        assert got == sorted(r["id"] for r in unannotated(df, done).collect())


def test_only_possible_matches_are_shuffled(spark):
    kind = "chat_triples array<struct<content:string,role:string>>"
    triple = F.array(F.struct(F.concat(F.lit("t"), "id").alias("content"), F.lit("user").alias("role")))
    df = spark.range(20_000).select("id", triple.alias("chat_triples"))
    done = df.where("id % 20 = 0").select(F.col("chat_triples").cast(kind.split(" ", 1)[1]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rest = unannotated_prefiltered(df, done)
        plan = rest._jdf.queryExecution().executedPlan().toString()
        assert rest.count() == 19_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain, compared = plan.split("LeftAnti", 1)
    assert "Exchange hashpartitioning" not in plain and "Exchange hashpartitioning" in compared
    # the filter lies below the exchange of the candidates, and lets hits and few others through
    assert "conv(hex(substring(_bits" in compared.split("Exchange hashpartitioning")[1]
    keyed = df.withColumn("_key", F.xxhash64(F.to_json("chat_triples")))
    hits = keyed.where("id % 20 = 0")
    blocks = blocks_for(1000)
    found = with_possible(keyed, "_key", bloom_table(hits, "_key", blocks), blocks, "_possible")
    assert 1000 <= found.where("_possible").count() <= 1000 + 190
