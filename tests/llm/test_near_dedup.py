import random

import numpy as np
import pytest

from calltriage.llm import near_dedup as N

from ..conftest import SF


def brute(rows, k, percent=80):
    def sh(t):
        w = (t or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = [sh(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(x for x in (least.get(r), d) if x is not None) if (least.get(r), d) != (None, None) else None
    return sorted((-1 if d is None else d, len(sets[i]), -1 if (c := least[find(i)] if sets[i] else d) is None else c) for i, (d, _) in enumerate(rows))


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows = [(None, "a null id with some words"), (900, None), (901, ""), (902, " \t"), (903, "one"), (904, "One"), (905, "two words"), (3, "two words")]
    i = 10
    for n in (3, 8, 30, 120, 400):
        for _ in range(4):
            base = [word() for _ in range(n)]
            for edits in range(6):
                t = list(base)
                for _ in range(edits * max(1, n // 60)):
                    t[rng.randrange(n)] = word()
                rows.append((i, " ".join(t)))
                i += 1
    return rows + rows[30:33]


@pytest.mark.parametrize(("k", "block", "nodes"), [(4, 250_000, 1 << 21), (5, 200, 0)])
def test_equals_brute_force(spark, monkeypatch, k, block, nodes):
    monkeypatch.setattr(N, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(N, "BROADCAST_NODES", nodes)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as digest", "2 as rid").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in N.near_duplicates(df, shingle=k).collect())
    assert got == brute(rows, k)


def test_keep_one(spark):
    rows = [(5, "a b c d e f g", "p"), (2, "A b c d e f G", "q"), (7, None, "r"), (8, "", "s"), (9, "other words than those above here", "t"), (9, "other words than those above here", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string")
    got = sorted(map(tuple, N.keep_one(df).collect()), key=str)
    assert got == sorted([rows[1], rows[2], rows[3], rows[4]], key=str)
    assert N.keep_one(df.limit(0)).count() == 0 and N.near_duplicates(df.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    x = N._mix(rng.integers(0, 1 << 62, 3000).astype(np.uint64))
    sig = N.signatures([np.unique(x[:1000]), np.unique(x[100:1100]), np.unique(x[2000:2003])])
    same = (sig[0] == sig[1]).mean()
    assert abs(same - 900 / 1100) < 0.08 and (sig[0] == sig[2]).mean() == 0 and (sig != 0xFFFFFFFFFFFFFFFF).all()


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3, 4), (2, "a b c d e f", 5, 6, 7, 8)], ["doc.id", "te xt", "__", "a.b", "text", "Text "])
    out = N.keep_one(df, "doc.id", "te xt")
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "a b c d e f", 1, 2, 3, 4)]


def test_failed_nodes_meet_other_blocks():
    """A node that is not like the first is compared with all others, a linked one is not."""
    s = [np.arange(0, 100), np.arange(0, 95), np.arange(40, 140), np.arange(42, 142), np.arange(300, 310)]
    sets = [np.array(x, np.uint64) for x in s]
    links, failed = N._linked([5, 6, 2, 3, 9], sets, [True] * 5, 80)
    assert sorted(links) == [(3, 2), (6, 5)] and failed == [2, 3, 4]
    links, failed = N._linked([5, 6, 2, 3, 9], sets, [True, False, True, False, False], 80)
    assert sorted(links) == [(3, 2), (6, 5)] and failed == [2]


def test_recall_on_documents(spark):
    """Every text of sf0.01 whose id 20 divides, against all texts: each link of similarity 0.8 or more is found."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    group = {r.doc_id: r.component_id for r in N.near_duplicates(docs).collect()}
    sets = {}
    for d, t in docs.collect():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    links = [(a, b) for a in sets if a % 20 == 0 for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    assert len(links) > 5 and all(group[a] == group[b] for a, b in links)


def test_failed_nodes_of_different_parts_meet(spark, monkeypatch):
    """Pairs that are like each other, but not like their hub, are found in whatever blocks and parts they fall."""
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 100)
    words = [[f"w{i}x{j}" for j in range(40)] for i in range(30)]
    texts = [(0, " ".join(f"hub{j}" for j in range(40)))] + [(2 * i + 1 + e, " ".join([*w[: 40 - e], *["end"] * e])) for i, w in enumerate(words) for e in (0, 1)]
    rows = spark.createDataFrame(texts, "node long, text string")
    links = N._links(spark.createDataFrame([(0, n, 37) for n, _ in texts[1:]], "hub long, node long, n int"), rows, 4, 80)
    assert {tuple(sorted((r.a, r.b))) for r in links.collect() if r.a != r.b} == {(2 * i + 1, 2 * i + 2) for i in range(30)}
