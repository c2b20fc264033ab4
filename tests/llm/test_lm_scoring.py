import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from calltriage.llm import lm_scoring as L

from .tree import build_tree


def brute_tree(counts, depth):
    """Plain recursion: weighted log probability of the root, and the estimates."""
    nodes = {}
    for ctx, sym, n in counts:
        for d in range(depth + 1):
            c = tuple(ctx[:d])
            for b in range(8):
                key = (c, (256 | sym) >> (8 - b))
                z = nodes.setdefault(key, [0, 0])
                z[(sym >> (7 - b)) & 1] += n

    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    def weigh(c, node):
        z, o = nodes.get((c, node), (0, 0))
        own = kt(z, o) if z + o else 0.0
        if len(c) == depth:
            return own
        kids = sum(weigh(k, node) for k in {x[0] for x in nodes if len(x[0]) == len(c) + 1 and x[0][:-1] == c})
        return float(np.logaddexp(own, kids)) - math.log(2)

    def prob(ctx, node, d=0):
        c = tuple(ctx[:d])
        z, o = nodes.get((c, node), (0, 0))
        p = (o + 0.5) / (z + o + 1)
        if d == depth:
            return p
        w = math.exp((kt(z, o) if z + o else 0.0) - math.log(2) - weigh(c, node))
        return w * p + (1 - w) * (prob(ctx, node, d + 1) if any(x[0] == tuple(ctx[: d + 1]) for x in nodes) else 0.5)

    return prob


def test_tree_equals_plain_recursion(monkeypatch):
    monkeypatch.setattr(L, "DEPTH", 2)
    text = b"abab abac\n"
    buf, at, _ = L._stream([[text[:-2], b"c\n"]])
    grams = Counter(((int(buf[i - 1]), int(buf[i - 2])), int(buf[i])) for i in at)
    tables = []
    for d in range(3):
        by = Counter()
        for (ctx, sym), n in grams.items():
            by[(sum(c << (8 * (d - 1 - j)) for j, c in enumerate(ctx[:d])), sym)] += n
        ctx, sym = zip(*sorted(by), strict=True)
        tables.append(pa.table({"ctx": np.array(ctx, np.int64), "sym": np.array(sym, np.int64), "n": np.array([by[k] for k in sorted(by)], np.int64)}))
    tree = build_tree(tables)
    prob = brute_tree([(c, s, n) for (c, s), n in grams.items()], 2)
    for i, got in zip(at, tree.score(buf, at), strict=True):
        s, ctx = int(buf[i]), (int(buf[i - 1]), int(buf[i - 2]))
        want = sum(math.log10(p if (s >> (7 - b)) & 1 else 1 - p) for b in range(8) for p in [prob(ctx, (256 | s) >> (8 - b))])
        assert abs(got - want) < 1e-7
    p = 10.0 ** tree.log10.astype(float)
    assert np.allclose(p[:, :-1].sum(axis=1) + (256 - p.shape[1] + 1) * p[:, -1], 1, atol=1e-7)


def test_scores(spark):
    rows = [(i, t) for i, t in enumerate([None, "", " \t", "A b a", "the cat\nsat on THE mat", "é É é", "x" * 3000, "w " * 3000] * 4)] + [(None, "odd one"), (3, "A b a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("other", "x")
    got = L.score_documents(df.selectExpr("doc_id", "text", "1 as n", "2 as h", "3 as score")).collect()
    assert len(got) == len(rows)
    c = Counter()
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    for i, t in rows:
        if not held[i]:
            c.update(L.tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held[i], len(L.tokens(t)), sum(c[w] > 0 for w in L.tokens(t)), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in L.tokens(t)), 6)) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)


def test_empty_table(spark):
    assert L.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_context_is_dropped(spark, monkeypatch):
    """More contexts than any cap: the scores equal those of one tree over all of them."""
    rng = np.random.default_rng(7)
    texts = [" ".join("".join(w) for w in rng.choice(list("abcdefghijklmnop"), (1500, 7))) for _ in range(14)]
    rows = [(i, texts[i % 14]) for i in range(42)] + [(100, None), (101, "zebra quiz " * 9)]
    learned, held_out = ([t for i, t in rows if (zlib.crc32(str(i).encode()) % 7 == 2) == h] for h in (False, True))
    assert held_out
    keys, n = np.unique(L._grams(*L._stream([L.tokens(t) for t in learned])[:2]), return_counts=True)
    tables = []
    for d in range(L.DEPTH + 1):
        k, inverse = np.unique(keys >> 8 * (L.DEPTH - d + 1) << 8 | keys & 255, return_inverse=True)
        tables.append(pa.table({"ctx": k >> 8, "sym": k & 255, "n": np.bincount(inverse, weights=n).astype(np.int64)}))
    assert sum(len(np.unique(t.column("ctx"))) for t in tables) > 100_000
    tree = build_tree(tables)
    want = {i: tree.score(*L._stream([L.tokens(t)])[:2]).sum() for i, t in rows[:4] + rows[-2:-1]}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in L.score_documents(df).collect()}
    assert all(abs(got[i].score - x) < 1e-6 * abs(x) for i, x in want.items())
    monkeypatch.setattr(L, "COMMON_GRAMS", 50)  # now nearly all grams are joined
    monkeypatch.setattr(L, "BLOCK", 1000)
    monkeypatch.setattr(L, "COMMON_WORDS", 3)  # and nearly all words
    again = {r.doc_id: r for r in L.score_documents(df).collect()}
    assert got.keys() == again.keys() and all(abs(got[i].score - again[i].score) < 1e-6 * abs(got[i].score) for i in got)
    assert all(abs(got[i].base_score - again[i].base_score) < 1e-6 * abs(got[i].base_score) and got[i].n_known == again[i].n_known for i in got)
