import random

from calltriage.llm import substring_dedup as S

from ..conftest import SF


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_passages_are_found_wherever_they_stand(spark):
    rng = random.Random(2)
    passage = text(rng, 60)
    rows = [(i, f"{text(rng, 40)} {passage if i % 3 == 0 else ''} {text(rng, 30)}\nÜber {text(rng, 5)}") for i in range(30)]
    rows += [(100, rows[1][1]), (100, rows[1][1]), (101, None), (102, ""), (103, f"{passage}\n{passage.upper()}"), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as words", "2 as start").repartition(3)
    got = S.repeated_spans(df, line_words=S.MIN_WORDS).collect()
    by = {r.doc_id for r in got}
    assert by == {i for i in range(3, 30, 3)} | {100, 103, None}
    texts = dict(rows)
    for r in got:
        t = texts[r.doc_id]
        assert len(t[r.start : r.end].split()) == r.n_words >= S.MIN_WORDS
        if r.doc_id not in (100, 103):
            assert t[r.start : r.end] in passage and r.n_words > 30
    # the earliest place stays; afterwards nothing is repeated
    left = S.remove_repeats(df, line_words=S.MIN_WORDS).collect()
    assert len(left) == len(rows) and any(r.doc_id == 0 and passage in r.text for r in left)
    assert sum(passage.lower() in (r.text or "").lower() for r in left) == 1


def words(t):
    return (t or "").lower().split()


def test_units_are_hashes_of_their_words():
    rng = random.Random(4)
    long = text(rng, 200)
    texts = [f"one two\n{long}", None, "", "  É x\t", f"{text(rng, 9)} {long.upper()} end"]
    doc, digest, a, b, w, x = S.units(texts)
    assert set(doc.tolist()) == {0, 3, 4} and (x - w > 0).all()
    seen = {}
    for d, h, i, j, m, n in zip(doc, digest, a, b, w, x, strict=True):
        own = tuple(words(texts[d][i:j]))
        assert own == tuple(words(texts[d])[m:n]) and seen.setdefault(own, h) == h
    assert len(set(seen.values())) == len(seen)
    lines = [(int(m), int(n)) for d, m, n in zip(doc, w, x, strict=True) if d == 0 and n - m < S.MIN_WORDS]
    assert lines == [(0, 2)] and set(digest[doc == 0].tolist()) & set(digest[doc == 4].tolist())


def brute(rows, n=S.MIN_WORDS):
    """For each row, by rank: which words lie in a run of n words that an earlier row holds, or the same one before."""
    marked, seen = {}, {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w, own = words(t), {}
        hit = [False] * len(w)
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if seen.get(g, d) != d or own.setdefault(g, i) + n <= i:
                hit[i : i + n] = [True] * n
        for g in own:
            seen.setdefault(g, d)
        marked.setdefault(d, []).append(hit)
    return marked


def test_removes_what_brute_force_finds(spark):
    """Nothing else is removed, and of a repeated passage no more stays than its ends."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = {d: h[0] for d, h in brute(rows).items()}
    texts, got = dict(rows), {d: [False] * len(h) for d, h in want.items()}
    for r in S.repeated_spans(docs, line_words=S.MIN_WORDS).collect():
        at = len(words(texts[r.doc_id][: r.start]))
        assert len(words(texts[r.doc_id][r.start : r.end])) == r.n_words >= S.MIN_WORDS
        got[r.doc_id][at : at + r.n_words] = [True] * r.n_words
    assert sum(map(sum, got.values())) > 0.9 * sum(map(sum, want.values())) > 0
    for d, h in want.items():
        assert all(x or not y for x, y in zip(h, got[d], strict=True))
        runs = "".join("x" if x else " " for x in h).split(" ")
        at = 0
        for run in runs:  # every long passage is found, and most of it goes
            if len(run) > 50:
                assert sum(got[d][at : at + len(run)]) >= len(run) - 40
            at += len(run) + 1


def test_short_lines_go(spark):
    df = spark.createDataFrame([(1, "a b\nc d e"), (2, "x\nA  b\ny"), (3, "c d e f")], "doc_id long, text string")
    assert S.repeated_spans(df, line_words=3).count() == 0
    assert [(r.doc_id, r.start, r.end, r.n_words) for r in S.repeated_spans(df).collect()] == [(2, 2, 6, 2)]
    assert [r.text for r in S.remove_repeats(df).orderBy("doc_id").collect()] == ["a b\nc d e", "x\n\ny", "c d e f"]


def covered(spark, docs, line_words):
    texts = dict(tuple(r) for r in docs.collect())
    got = {d: [False] * len(words(t)) for d, t in texts.items()}
    for r in S.repeated_spans(docs, line_words=line_words).collect():
        at = len(words(texts[r.doc_id][: r.start]))
        got[r.doc_id][at : at + r.n_words] = [True] * r.n_words
    return got


def test_all_repeated_lines_are_covered(spark):
    """Lines of one word and up, against plain Python; besides them, only what long units cover."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-2, "a\nB c\n\na\n a "), (-1, "b  C\nb c d\n\tA")], "doc_id long, text string"))
    want, seen, short = covered(spark, docs, S.MIN_WORDS), set(), 0
    for d, t in sorted(tuple(r) for r in docs.collect()):
        at = 0
        for line in (t or "").split("\n"):
            w = tuple(words(line))
            if w and w in seen:
                want[d][at : at + len(w)] = [True] * len(w)
                short += len(w) < S.MIN_WORDS
            seen.add(w)
            at += len(w)
    assert want[-2] == [False] * 3 + [True] * 2 and want[-1] == [True] * 2 + [False] * 3 + [True] and short > 20
    assert covered(spark, docs, 1) == want


def test_odd_column_names(spark):
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, t, 1, 2, 3, 4), (2, t, 1, 2, 3, 4)], ["doc.id", "te xt", "rid", "c1", "a b", "__"])
    out = S.remove_repeats(df, "doc.id", "te xt")
    assert out.columns == df.columns and sorted(len(r[1]) for r in out.collect()) == [0, len(t)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.repeated_spans(df).count() == 0 and S.remove_repeats(df).count() == 0
