from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from calltriage.llm import ordinal, quality_classifier, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_fit_orders_grades():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 900)
    owner = np.concatenate([np.arange(900), np.arange(900)])
    feature = np.concatenate([np.where(rng.random(900) < 0.9, grade, 2 - grade) + 10, rng.integers(100, 140, 900)])
    m = ordinal.fit(*(x[np.argsort(owner, kind="stable")] for x in (owner, feature)), grade)
    assert (np.diff(m.thresholds) > 0).all() and m.weights[10] < m.weights[11] < m.weights[12]
    tails = m.tails(m.weights[[10, 11, 12]])
    assert (np.diff(tails.sum(axis=1)) > 0).all() and (tails[:, 0] >= tails[:, 1]).all()


def test_fit_is_an_optimum():
    """No step in any direction lowers the loss, which is written out here once more, by a hundred thousandth."""
    rng = np.random.default_rng(5)
    grade = rng.integers(0, 3, 1200)
    pairs = {(i, int(f)) for i in range(1200) for f in {grade[i] + 10 if rng.random() < 0.8 else 10, 20 + rng.integers(0, 3), 30 + (grade[i] > 0) * (rng.random() < 0.7)}}
    owner, feature = (np.array(x) for x in zip(*sorted(pairs), strict=True))
    m = ordinal.fit(owner, feature, grade)
    used = np.flatnonzero(m.weights)

    def loss(w, t):
        weights = np.zeros(ordinal.BUCKETS)
        weights[used] = w
        z = np.bincount(owner, weights=weights[feature], minlength=1200)
        above = np.column_stack([np.ones(1200), *(1 / (1 + np.exp(-(z - x))) for x in t), np.zeros(1200)])
        return -np.log(above[np.arange(1200), grade] - above[np.arange(1200), grade + 1]).mean() + ordinal.PENALTY / 2 * (w**2).sum()

    w, t = m.weights[used].astype(float), m.thresholds
    assert len(used) >= 3 and loss(w, t) < loss(0 * w, t) - 0.1
    for i in range(len(w) + len(t)):
        step = np.zeros(len(w) + len(t))
        step[i] = 0.05
        assert all(loss(w + k * step[: len(w)], t + k * step[len(w) :]) > loss(w, t) - 1e-5 for k in (-1, 1))


def test_scores_equal_sums_word_by_word(spark):
    """A text's score is the sum of the weights of its features, each text by itself."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = ordinal.train(docs, toxicity.severity(labels), toxicity.features)
    got = {r.doc_id: r.tails for r in ordinal.score(docs.filter("doc_id < 60"), model, toxicity.features).collect()}
    for r in docs.filter("doc_id < 60").collect():
        names = Counter(n for word in (r.text or "").encode().split() for n in toxicity._names(word))
        of = Counter()
        for n, c in names.items():
            of[int(ordinal.hashed([n])[0])] += c
        features = set(of) | {int(ordinal.often(np.array([b]), k)[0]) for b, c in of.items() for k in ordinal.COUNTS if c >= k}
        want = model.tails(np.array([sum(float(model.weights[f]) for f in features)]))[0]
        assert np.allclose(got[r.doc_id], want, atol=1e-5)


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    s = quality_classifier.score_documents(docs, labels.filter(fold == 0)).join(labels.filter(fold == 1), "doc_id")
    r = s.agg(F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("good"), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("bad")).first()
    assert r.good > 0.95 and r.bad < 0.25


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.01', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    s = toxicity.score_documents(docs, labels.filter(fold != 0)).join(labels.filter(fold == 0).withColumnRenamed("toxic", "want"), "doc_id")
    r = s.agg(F.avg(F.when(F.col("want") == 1, F.col("toxic").cast("int"))).alias("found"), F.avg(F.when(F.col("want") == 0, F.col("toxic").cast("int"))).alias("wrong")).first()
    assert r.found > 0.8 and r.wrong < 0.03


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (3, "x"), (None, "y " * 9000)], "doc_id long, text string").selectExpr("*", "1 as toxic", "2 as grade")
    labels = spark.createDataFrame([(1, 0, 1), (3, 1, 0), (3, 1, 1), (7, 1, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for f in (toxicity.score_documents, quality_classifier.score_documents):
        assert f(docs, labels).count() == 5 and f(docs, labels.limit(0)).count() == 5 and f(docs.limit(0), labels).count() == 0


def test_names_are_numbered():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
