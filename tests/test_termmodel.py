"""The term dictionary and the joint fit, against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from calltriage.operators import logistic, termmodel, textmodel

TEXTS = [None, "", " ", "a", "ab", "Pay the FEE now now", "pay the fee", "É ß straße", "one-two  three_four 5 66", "naïve 漢字漢字 😀😀😀😀", "x" * 50]


def texts(n=60):
    rng = random.Random(2)
    words = ["pay", "the", "fee", "now", "bank", "É", "straße", "漢字", "😀", "a", "call-me", "x_1"]
    return TEXTS + [rng.choice([" ", ", ", "  "]).join(rng.choices(words, k=rng.randrange(30))) for _ in range(n)]


def plain_counts(text):
    t = (text or "").lower()
    w = re.findall(r"\b\w\w+\b", t)
    yield from ((("word", x), n) for x, n in Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]).items())
    yield from ((("char", x), n) for x, n in Counter(t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)).items())


def plain_weights(text, idf):
    w = {k: (1 + math.log(n)) * idf[k] for k, n in plain_counts(text) if k in idf}
    length = {f: math.sqrt(sum(x * x for (g, _), x in w.items() if g == f)) for f in ("word", "char")}
    return {k: x / length[k[0]] for k, x in w.items()}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    seen = sorted({k for t in texts() for k, _ in plain_counts(t)})
    kept = [k for k in seen if rng.random() < 0.6 or len(k[1]) == 3]
    idf = {k: rng.uniform(1, 5) for k in kept}
    coef = {k: rng.uniform(-1, 1) for k in kept}
    d = termmodel.Dictionary([f for f, _ in kept], [t for _, t in kept], np.array([idf[k] for k in kept]))
    return kept, idf, coef, termmodel.TermModel(d, np.array([coef[k] for k in kept]), -0.3)


@pytest.mark.parametrize("chunk", [1 << 20, 20])
def test_weights_and_scores_equal_plain_ones(spark, model, monkeypatch, chunk):
    monkeypatch.setattr(termmodel, "CHUNK", chunk)
    kept, idf, coef, m = model
    df = spark.createDataFrame(list(enumerate(texts())), "id long, text string").repartition(2)
    rows = {r.id: dict(zip(r.i, r.w, strict=True)) for r in termmodel.features(df, m.dictionary, "id", "text").collect()}
    scores = {r.id: r.p for r in df.select("id", m.column(spark, F.col("text")).alias("p")).collect()}
    for i, t in enumerate(texts()):
        want = plain_weights(t, idf)
        assert {kept[k]: pytest.approx(x) for k, x in rows[i].items()} == want
        z = sum(x * coef[k] for k, x in want.items()) - 0.3
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-z)))


def test_dictionary_scores_without_exchange_and_as_a_join(spark, model):
    """The same scores as from a table of terms, and no exchange or row for each term in the plan."""
    kept, idf, coef, m = model
    df = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts())], "id long, text string")
    t = spark.createDataFrame([(f, x, idf[f, x], coef[f, x]) for f, x in kept], "family string, term string, idf double, coef double")
    own = df.select("id", m.column(spark, F.col("text")).alias("p"))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    loaded = termmodel.TermModel.of(t, -0.3)
    w = textmodel.two_families(df, "id", "text").join(t, ["family", "term"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = w.groupBy("id", "family").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    w = w.join(norm, ["id", "family"]).withColumn("w", F.col("w") / F.col("n"))
    joined = textmodel.logreg_score(df, w.select("family", "id", "term", "w"), t.select("family", "term", "coef"), -0.3, "id", "text")
    want = {r.id: r.prob for r in joined.collect() if r.prob is not None}
    for s in (own, df.select("id", loaded.column(spark, F.col("text")).alias("p"))):
        got = {r.id: r.p for r in s.collect()}
        assert {i: got[i] for i in want} == pytest.approx(want)


def test_empty_table_and_dictionary(spark):
    none = termmodel.TermModel(termmodel.Dictionary([], [], np.zeros(0)), np.zeros(0), 1.0)
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "id long, text string")
    assert [r.p for r in df.select(none.column(spark, F.col("text")).alias("p")).collect()] == pytest.approx([1 / (1 + math.exp(-1))] * 2)
    assert df.limit(0).select(none.column(spark, F.col("text")).alias("p")).count() == 0
    assert all(r.i == [] for r in termmodel.features(df, none.dictionary, "id", "text").collect())


def newton(x, y, weight, c):
    z, b = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    ridge = np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve(c * (z * (weight * p * (1 - p))[:, None]).T @ z + ridge, c * z.T @ (weight * (p - y)) + ridge @ b)
    return b


def test_joint_fit_equals_newton(spark, monkeypatch):
    monkeypatch.setattr(logistic, "BLOCK", 7)
    rng = np.random.default_rng(3)
    x = rng.random((150, 5)) * (rng.random((150, 5)) < 0.6)
    y = (x @ [2, -1, 0.5, 0, 1] + rng.normal(0, 0.4, 150) > 0.6).astype(int)
    rows = [(int(v), [j for j in range(5) if r[j]], [float(a) for a in r if a]) for r, v in zip(x, y, strict=True)]
    df = logistic.balanced(spark.createDataFrame(rows, "label int, i array<int>, w array<double>").repartition(3)).persist()
    jobs, plain = [], logistic.evaluate
    monkeypatch.setattr(logistic, "evaluate", lambda *a: jobs.append(len(a[1])) or plain(*a))
    found = logistic.fit(df, 5, textmodel.GRID)
    weight = np.where(y == 1, 75 / y.sum(), 75 / (150 - y.sum()))
    for c, m in found.items():
        assert m["converged"] and np.allclose([*m["coefficients"], m["intercept"]], newton(x, y, weight, c), atol=1e-3)
    # one job for the steps of all strengths: no more of them than the longest search has
    assert jobs[0] == 7 and len(jobs) < 2 * max(m["iterations"] for m in found.values()) + 10
    s = {(round(r.c, 2), r.label): r.n for r in logistic.scored(df, found).groupBy("c", "label").agg(F.count("score").alias("n")).collect()}
    assert len(s) == 14 and sum(s.values()) == 7 * 150


def test_fit_of_one_class_or_nothing(spark):
    df = spark.createDataFrame([(1, [0], [1.0]), (1, [], [])], "label int, i array<int>, w array<double>")
    m = logistic.fit(logistic.balanced(df), 1, (1.0,), max_iter=30)[1.0]
    assert m["intercept"] > 1
    assert logistic.fit(logistic.balanced(df.limit(0)), 1, (1.0,))[1.0]["converged"]


def test_rows_are_packed_for_the_fit(spark, monkeypatch):
    """Every step of a search reads blocks of bytes, not lists of numbers; blocks of one row and rows without terms count, too."""
    monkeypatch.setattr(logistic, "ENTRIES", 2)
    rows = [(1, [0, 1], [0.5, 1.0]), (0, [2], [1.0]), (0, [], []), (1, [0, 1, 2], [0.1, 0.2, 0.3])]
    df = spark.createDataFrame(rows, "label int, i array<int>, w array<double>").withColumn("weight", F.lit(2.0)).repartition(2)
    blocks = logistic.packed(df)
    assert {f.dataType.simpleString() for f in blocks.schema.fields} == {"binary"} and 2 <= blocks.count() <= 4
    loss, slope = logistic.evaluate(blocks, np.zeros((2, 4)))
    assert loss == pytest.approx([8 * math.log(2)] * 2) and slope[1] == pytest.approx([-0.6, -1.2, 0.7, 0.0])


def test_features_are_handed_on_in_slices(spark, monkeypatch):
    """The terms of a batch of texts are never all in memory: each slice of few characters is a batch of its own."""
    monkeypatch.setattr(termmodel, "FEATURES_CHUNK", 20)
    d = termmodel.Dictionary(["word", "char"], ["pay", "the"], np.ones(2))
    df = spark.createDataFrame([(i, "pay the fee") for i in range(30)], "id long, text string").coalesce(1)
    out = termmodel.features(df, d, "id", "text")
    assert [(r.id, r.i) for r in out.collect()] == [(i, [0, 1]) for i in range(30)]
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()


def test_steps_by_tables_and_by_sorted_arrays_are_alike(monkeypatch):
    """Runs are looked up in tables of bounded size, or else in sorted arrays; a dictionary without runs looks at no character."""
    some = [t or "" for t in texts()]
    runs = sorted({t[i : i + n] for t in some for n in (3, 4, 5) for i in range(0, max(0, len(t) - n + 1), 2)})
    one, other = (termmodel.Dictionary(["char"] * len(runs), runs, np.ones(len(runs))) for _ in range(2))
    assert one._tables()[2]
    monkeypatch.setattr(termmodel, "TABLE", 1)
    assert not other._tables()[2]
    a, b = (sorted(zip(*map(list, d._runs(termmodel.pa.array(some + ["\U0010ffff" * 9]))), strict=True)) for d in (one, other))
    assert a == b and len(a) > 300
    monkeypatch.setattr(termmodel.pc, "utf8_length", None)
    assert [len(x) for x in termmodel.Dictionary(["word"], ["pay"], np.ones(1))._runs(termmodel.pa.array(some))] == [0, 0]


def test_searches_of_large_strengths_take_few_steps():
    """F1 to F3: as many steps as before are too many on larger tables, as each is a job over all rows; the optimum is the same."""
    # most terms feel little but the ridge
    scales, steps = np.concatenate([np.ones(270), np.geomspace(2, 1e4, 30)]), 0
    s = logistic.search(np.zeros(300), 1e4, 2000)
    x = next(s)
    try:
        while True:
            steps += 1
            x = s.send((scales @ (x - 1) ** 2 / 2, scales * (x - 1)))
    except StopIteration as end:
        best, _, good = end.value
    assert good and np.allclose(best, 1, atol=1e-2) and steps < 250  # 397 before


def test_sums_are_those_of_each_row(monkeypatch):
    """Losses and slopes of a block with empty rows, as from a dense table, without a number for each row and entry."""
    rng = np.random.default_rng(5)
    x = rng.random((40, 6)) * (rng.random((40, 6)) < 0.5)
    x[[0, 7, 39]] = 0
    y, weight, points = rng.integers(0, 2, 40).astype(float), rng.random(40), rng.normal(size=(3, 7))
    i, w, n = np.nonzero(x)[1].astype(np.int32), x[x != 0], (x != 0).sum(axis=1).astype(np.int32)
    total = np.zeros((3, 8))
    logistic._add(total, {"label": y, "weight": weight, "n": n, "i": i, "w": w}, points)
    for t, p in zip(total, points, strict=True):
        z = x @ p[:-1] + p[-1]
        r = weight * (1 / (1 + np.exp(-z)) - y)
        assert np.allclose(t, [*(r @ x), r.sum(), (weight * np.logaddexp(0, np.where(y == 1, -z, z))).sum()])
    lists = [logistic.pa.ListArray.from_arrays(logistic.pa.array(np.append(0, np.cumsum(n)), logistic.pa.int32()), logistic.pa.array(v)) for v in (i, w)]
    for entries in (1, 7, 1000):
        monkeypatch.setattr(logistic, "ENTRIES", entries)
        want = 1 / (1 + np.exp(-(x @ points[:, :-1].T + points[:, -1])))
        assert np.allclose(logistic._scores(*lists, points), want)
        assert np.allclose(logistic._scores(*(v.slice(5, 20) for v in lists), points), want[5:25])
