"""Bloom filters, quantile sketches, models kept by workers and counted failures."""

import os
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from calltriage.operators import bloom, corpus, evaluate, scorers


@pytest.mark.parametrize("error", [0.1, 0.01, 0.001])
def test_bloom_keeps_all_keys_and_few_others(spark, error):
    n = 50_000
    keys, others = spark.range(n).select(F.col("id").cast("string").alias("k")), spark.range(n, 5 * n).select(F.col("id").cast("string").alias("k"))
    longs = bloom.size(n, error)
    f = bloom.build(keys, F.col("k"), longs)
    assert bloom.may_hold(keys, F.col("k"), f, longs).count() == n
    assert bloom.may_hold(others, F.col("k"), f, longs).count() <= 1.3 * error * 4 * n
    assert bloom.size(0, error) == 1 and bloom.size(10**12, error) == bloom.MAX_LONGS
    assert bloom.may_hold(keys, F.col("k"), bloom.build(keys.limit(0), F.col("k"), 1), 1).count() == 0


def test_leaks_look_at_candidates_only(spark):
    rest = spark.range(20_000).select(F.lit("a").alias("source"), F.when(F.col("id") % 1000 > 0, F.concat(F.lit("text "), "id")).alias("text"))
    held = spark.createDataFrame([("b", "text 7"), ("b", "text 7"), ("b", "text 19999"), ("b", "other"), ("b", None)], "source string, text string")
    got = {r.rule: r.n for r in corpus.leaks(rest, held).collect()}
    assert got == {"source": 0, "text": 2}
    found = corpus.leak_candidates(rest, held)
    assert found.columns == rest.columns and 2 <= found.count() < 600
    plan = corpus.leak_candidates(rest, held)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert {r.rule: r.n for r in corpus.leaks(rest, held.limit(0)).collect()} == {"source": 0, "text": 0}


def test_quantile_sketches(spark):
    rng = random.Random(6)
    rows = [("x" if i % 3 else "y", i % 7, rng.lognormvariate(0, 2)) for i in range(60_000)] + [("x", 1, None), ("z", 0, 5.0)]
    df = spark.createDataFrame(rows, "g string, part int, v double")
    q = {"p10": 0.1, "median": 0.5, "p99": 0.99}
    whole, kept = evaluate.sketches(df, F.col("v"), "g"), evaluate.sketches(df, F.col("v"), "g", "part")
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan.replace("SortAggregate", "")
    for s in (whole, evaluate.merged(kept, "g")):
        found = evaluate.sketch_quantiles(s, q, "g")
        gaps = {r.g: r for r in evaluate.rank_gaps(df, F.col("v"), found, q, "g").collect()}
        assert {g: r.n for g, r in gaps.items()} == {"x": 40_000, "y": 20_000, "z": 1}
        assert all(gaps[g][n] <= 2 * evaluate.rank_error() for g in gaps for n in q)
        assert {r.g: r.median for r in found.collect()}["z"] == 5.0
    wrong = spark.createDataFrame([("x", 0.0, 0.0, 0.0)], "g string, p10 double, median double, p99 double")
    assert evaluate.rank_gaps(df, F.col("v"), wrong, q, "g").first().median == 0.5


def test_model_is_made_once_in_a_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda x: x[:, 0]

    model = scorers.AudioScorer("late", length=2, load=load)
    df = spark.range(0, 400, 1, 16).select("id", F.when(F.col("id") % 5 > 0, F.array(F.lit(0.0), F.lit(1.0))).alias("x"))
    for _ in range(3):
        got = df.select("id", model.column(F.col("x")).alias("p")).collect()
        assert {r.p for r in got if r.id % 5} == {0.5} and all(r.p is None for r in got if r.id % 5 == 0)
    pids = open(log).read().split()
    assert model.is_loaded and len(pids) == len(set(pids)) < 48


def test_failures_are_counted(spark):
    def picky(x):
        if (x[:, 0] < 0).any():
            raise ValueError("not for me")
        return x[:, 0]

    rows = [(i, None if i % 7 == 0 else [] if i % 7 == 1 else [float(i % 4) - 1, 1.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x array<double>").repartition(5)
    known = scorers.Registry().register(scorers.AudioScorer("picky", picky, 2)).register(scorers.AudioScorer("absent")).register(scorers.AudioScorer("calm", lambda x: x[:, 1], 2))
    had = [r for r in rows if r[1]]
    bad = sum(r[1][0] < 0 for r in had)
    seen = Observation("voice")
    out = scorers.with_scores(df, known, F.col("x"), seen).collect()
    assert sum(r.score_picky is None and bool(r.x) for r in out) == bad > 0
    assert seen.get == {"tried_picky": len(had), "failed_picky": bad, "tried_calm": len(had), "failed_calm": 0}
    assert {tuple(r) for r in scorers.failures(df, known, F.col("x")).collect()} == {("picky", len(had), bad), ("calm", len(had), 0)}
    assert {r.tried for r in scorers.failures(df.limit(0), known, F.col("x")).collect()} == {0}
