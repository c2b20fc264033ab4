import math
import random
import re
from collections import Counter

import pytest

from calltriage.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(docs, items, k=20):
    words = lambda t: TERM.findall((t or "").translate(str.maketrans(UPPER, LOWER)))
    ds = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for _, _, n in ds), sum(n for _, _, n in ds)
    df = Counter(t for _, c, _ in ds for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in ds:
            s = 0
            for t in words(text):
                if c[t]:
                    m = 75 + 25 * n * n_docs // n_terms
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def tables(seed, n=300):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "Straße", "x_y", "A1", "漢字", "9"]
    text = lambda m: rng.choice([" ", ", ", "\n", "\x1f"]).join(rng.choices(vocabulary, [1 / (1 + i) for i in range(len(vocabulary))], k=rng.randrange(m)))
    docs = [(i, text(80)) for i in range(n)] + [(900, None), (901, ""), (902, "w1 " * 30_000), (903, "., !")]
    docs += [(1000 + i, "w50 w51 w52 w53") for i in range(40)] + [docs[3], docs[3], (None, "w50 w51 w52 w53 w54"), (None, docs[4][1])]
    items = [(f"q{i}", text(25)) for i in range(12)] + [("none", None), ("empty", ""), ("unknown", "zzz"), ("same", "w50 w51 w52"), ("same", "w50 w51 w52"), ("ties", "W50 w50"), (None, "w3 w4")]
    return docs, items


@pytest.mark.parametrize(("slots", "block"), [(1024, 8 << 20), (3, 8 << 20), (16, 120)])
def test_equals_brute_force(spark, monkeypatch, slots, block):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical_search.Block.__init__, "__defaults__", (slots,))
    docs, items = tables(slots)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, qid string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id string, text string, rank int")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.search(d, q).collect()), key=str)
    assert got == brute(docs, items)


def test_small_slices_stop_early(spark, monkeypatch):
    """In slices of a few documents the best k of a task carry over; not all documents are rescored."""
    docs, items = tables(7, 2000)
    block = lexical_search.Block(list(enumerate(t for _, t in items)))
    counts = [block.read([t]) for _, t in docs]
    n_docs, n_terms = sum(int(c[0][0] > 0) for c in counts), sum(int(c[0][0]) for c in counts)
    import numpy as np

    df = np.bincount(np.concatenate([c[2] for c in counts]), minlength=len(block.number))
    s = lexical_search.Scorer(block, lexical_search.weights(n_docs, df), n_docs, n_terms, 20)
    rescored, plain = [], s._rescore

    def spy(q, some, *rest):
        rescored.append(len(some))
        plain(q, some, *rest)

    monkeypatch.setattr(s, "_rescore", spy)
    for at in range(0, len(docs), 100):
        s.add([i for i, _ in docs[at : at + 100]], [t for _, t in docs[at : at + 100]])
    assert sum(rescored) < 0.5 * len(docs) * len(items)
    got = [(items[q][0], r, x[2], -x[0]) for q, best in zip(block.ids, s.best, strict=True) for r, x in enumerate(best, 1)]
    assert sorted(got, key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = tables(1)
    none = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id string, text string")
    assert lexical_search.search(none, q).count() == 0
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert lexical_search.search(d, q.limit(0)).count() == 0
    assert lexical_search.search(d.filter("text is null"), q).count() == 0
