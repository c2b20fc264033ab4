import random
import re
from collections import Counter, defaultdict

import pytest

from calltriage.llm import collocations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(rows, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(UPPER, LOWER))):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= 30}
        longest = Counter()
        for p, a in cands.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        longest[p[i:j]] = max(longest[p[i:j]], a)
        rows_ = []
        for p, a in cands.items():
            if 100 * longest[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, l, r_, n[lang], -s) for r, (s, a, p, l, r_) in enumerate(sorted(rows_)[:top], 1)]
    return sorted(out)


def texts(seed, n=900):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["É", "ß", "漢字", "a\x0bb", "x y", "A"]
    fixed = ["one two three four", "one two three", "of the", "w1 w2 w3 w4 w5 w6", "the of the of the", "Once upon a time"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.15 else rng.choices(words, [1 / (1 + i) for i in range(len(words))])[0] for _ in range(rng.randrange(40))]
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " "]) for p in parts)))
    return rows + [("en", None), (None, ""), ("fr", "too few words"), ("xx", "!!! ..."), ("en", "again and again " * 3000)]


@pytest.mark.parametrize(("top", "bits", "chunk"), [(2000, 1 << 27, 8 << 20), (5, 1 << 27, 500), (40, 1 << 15, 3000), (12, 1 << 27, 8 << 20)])
def test_equals_brute_force(spark, monkeypatch, top, bits, chunk):
    monkeypatch.setattr(collocations, "MAX_BITS", bits)
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    monkeypatch.setattr(collocations, "WAITING", 2 * chunk)
    rows = texts(top)
    d = spark.createDataFrame([(a, b, 1, "q") for a, b in rows], "lang string, text string, rank int, phrase string").repartition(3)
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.mine(d, top=top).collect())
    assert got == brute(rows, top)


def test_rounds_until_settled(spark, monkeypatch):
    """Where longer candidates take the place of the best pairs, tau falls until enough survive."""
    monkeypatch.setattr(collocations, "WIDER", 1.5)
    seen, plain = [], collocations._thresholds
    monkeypatch.setattr(collocations, "_thresholds", lambda *a: seen.append(a[2]) or plain(*a))
    rng = random.Random(3)
    rows = [("en", " ".join(f"p{k}{x}" for x in "abcd")) for k in range(30) for _ in range(40)]
    rows += [("en", f"p{rng.randrange(30)}a w{rng.randrange(6)} w{rng.randrange(6)}") for _ in range(4000)]
    d = spark.createDataFrame(rows, "lang string, text string")
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.mine(d, top=45).collect())
    assert got == brute(rows, 45) and len(seen) > 1


def test_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.mine(spark.createDataFrame([("en", None), (None, "a b")], "lang string, text string")).count() == 0


def test_large_counts(spark):
    """Products beyond 64 bits are exact."""
    d = spark.createDataFrame([(5_000_000_000_000, 9_000_000_000_000, 7_000_000_000_001)], "a long, l long, r long")
    got = d.select(collocations._ratio(d.a, d.l + d.r).alias("s")).first().s
    assert got == 2_000_000 * 5_000_000_000_000 // 16_000_000_000_001
