"""The most frequent terms by sketches, against counting all of them."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from calltriage.operators import heavyterms, textmodel

from .test_termmodel import plain_counts, texts


def plain(docs, min_df, size):
    df, total = Counter(), Counter()
    for t in docs:
        for k, n in plain_counts(t):
            df[k] += 1
            total[k] += n
    rows = []
    for f in textmodel.FAMILIES:
        own = sorted(((f, t, df[f, t], n) for (g, t), n in total.items() if g == f and df[g, t] >= min_df), key=lambda r: (-r[3], r[1].encode()))
        rows += own[:size]
    return sorted(rows)


def zipf(n=300, seed=3):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(800)]
    # the last text alone has the most frequent words, so that few survivors are in two texts
    return [" ".join(rng.choices(words, [1 / (i + 1) for i in range(800)], k=40)) for _ in range(n)] + [" ".join(f"solo{i} " * 400 for i in range(60))]


@pytest.mark.parametrize("docs", [texts(), zipf(), [None, ""], ["one text " * 9]])
@pytest.mark.parametrize(("size", "summary", "survivors"), [(30_000, 1 << 20, 1 << 22), (20, 1 << 20, 1 << 22), (20, 600, 1 << 22), (20, 30, 1 << 22), (20, 1 << 20, 5)])
def test_vocabulary_equals_counting(spark, docs, size, summary, survivors):
    df = spark.createDataFrame([(t, 1) for t in docs], "text string, family int").repartition(3)
    got = heavyterms.vocabulary(df, "text", 2, size, summary, survivors).collect()
    assert sorted(tuple(r) for r in got) == plain(docs, 2, size)


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string")
    assert heavyterms.vocabulary(df, "text").count() == 0


def test_summary_encloses_the_counts():
    rng = np.random.default_rng(1)
    parts = [rng.zipf(1.3, 5_000).astype(np.uint64) for _ in range(8)]
    true = Counter(np.concatenate(parts).tolist())
    s = heavyterms.Summary(100)
    for p in parts:
        s.add(p)
        assert len(s.h) <= 100
    kept = dict(zip(s.h.tolist(), s.n.tolist(), strict=True))
    assert s.lost > 0 and all(kept.get(k, 0) <= n <= kept.get(k, 0) + s.lost for k, n in true.items())


def test_only_survivors_are_counted_as_strings(spark):
    """With a sketch that loses counts, the recount makes far fewer rows than there are terms."""
    docs = zipf(200, 5)[:-1]
    df = spark.createDataFrame([(t,) for t in docs], "text string")
    s = {(r.family, r.h): r.n for r in heavyterms.summaries(df, "text", 1_500).collect()}
    lost = s["word", None]
    floor = sorted((n for (f, h), n in s.items() if f == "word" and h is not None), reverse=True)[40 - 1]
    hashes = np.sort(np.array([h for (f, h), n in s.items() if f == "word" and h is not None and n + lost >= floor], np.int64).view(np.uint64))
    assert 0 < lost < floor and len(hashes) < 400
    got = {r.term: r.total for r in heavyterms.recount(df, "text", {"word": hashes, "char": np.zeros(0, np.uint64)}).collect()}
    total = Counter()
    for t in docs:
        total.update({k: n for (f, k), n in plain_counts(t) if f == "word"})
    assert len(got) < len(total) / 4 and all(total[t] == n for t, n in got.items())
    assert {t for t, n in total.items() if n >= floor} <= set(got)


def test_runs_come_length_by_length():
    """Only the runs of one length are in memory at a time."""
    found = list(heavyterms._runs(pa.array(["abcdef", None, "ab", "xyz"])))
    assert [len(h) for h, *_ in found] == [5, 3, 2] and [row.tolist() for _, row, *_ in found] == [[0, 0, 0, 0, 3], [0, 0, 0], [0, 0]]
