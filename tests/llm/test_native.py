"""Quality rules and decontamination against plain Python, and the pipeline's stages."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import pytest
from calltriage.llm import decontaminate, near_dedup, quality_rules, secret_scan

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a b c d e f g h " * 40), (5, "Line one here\nLine one here\n\n x"), (6, "é" * 5 + " # $$ <|>"), (7, "w" * 50_000), (8, "same same " * 2), (8, "same same " * 2), (None, "k"), (9, " lead and trail ")]


def measured(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    c = Counter(grams)
    covered = {p for i, g in enumerate(grams) if c[g] > 1 for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'x' as n_lines", "5 as n_words")
    got = quality_rules.ledger(df).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert len(got) == len(ODD) and all(tuple(r)[1:] == measured(r.text) for r in got)
    kept = quality_rules.keep(df, "base")
    assert kept.columns == df.columns and kept.count() == 0 and quality_rules.ledger(df.limit(0)).count() == 0
    a = {r["rule"]: (r["failed"], r["regained"]) for r in quality_rules.ablation(quality_rules.ledger(df), "base").collect()}
    assert a["few_words"][0] == 10 and a["repeated_windows"] == (1, 1)


@pytest.fixture
def no_auto_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(("hash_set", "bytes_"), [(50_000, 1 << 26), (0, 1 << 26), (50_000, 0), (0, 0)])
def test_contamination(spark, monkeypatch, no_auto_broadcast, hash_set, bytes_):
    """Every way of looking windows up gives the same, the shuffled join included."""
    monkeypatch.setattr(decontaminate, "HASH_SET", hash_set)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bytes_)
    item = "one two three four five six seven eight nine ten eleven twelve"
    bench = [(1, item), (2, "Short item"), (3, None), (4, "..."), (10, item)]
    docs = [*ODD, (20, f"x {item.upper()}, y"), (21, "a SHORT, item; and short item"), (22, item[: item.index(" ten")]), (23, ("pad " * 29) + item + " pad" * 40), (24, item[4:])]
    b = spark.createDataFrame(bench, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_hit", "'q' as h")
    got = {r.doc_id: r for r in decontaminate.decontaminate(d, b).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, hit, items in ((20, 12, "1,10"), (21, 4, "2"), (22, 0, ""), (23, 12, "1,10"), (24, 11, "1,10"), (1, 0, ""), (8, 0, "")):
        assert (got[i].n_hit, got[i].items_sha256, got[i].contaminated) == (hit, sha(items), hit > 0)
    assert decontaminate.decontaminate(d, b).count() == len(docs)
    left = decontaminate.drop_contaminated(d, b)
    assert left.columns == d.columns and left.count() == len(docs) - 4
    assert decontaminate.decontaminate(d, b.limit(0)).filter("contaminated").count() == 0 and decontaminate.decontaminate(d.limit(0), b).count() == 0


def test_odd_column_names(spark):
    t = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(1, t, 1, 2, 3), (2, " ".join(f"w{i}" for i in range(30)), 1, 2, 3)], ["doc_id", "te xt", "__text", "a.b", "Te xt."])
    b = spark.createDataFrame([(1, t)], "item_id long, text string")
    for out in (decontaminate.drop_contaminated(df, b, "te xt"), quality_rules.keep(df, "base", "te xt"), secret_scan.redact(df, "te xt")):
        assert out.columns == df.columns and 2 in {r[0] for r in out.collect()}


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
            continue
        assert out.columns == columns and 0 < out.count() <= before
        if name == "quality_rules":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in quality_rules.ledger(docs.select("doc_id", "text")).collect() if r.fail_bits == 0}
        elif name == "minhash_near_dedup":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in near_dedup.near_duplicates(docs).collect() if r.kept}
        elif name == "secret_scan":
            assert out.count() == docs.count() and all(not secret_scan.find(r.text)[0] for r in out.collect())
        docs, before = out, out.count()


def test_ledger_keeps_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "word " * 30, 7, "x", 2), (2, None, 8, "y", 3)], "doc_id long, text string, n_words int, fail_bits string, `a.b` int")
    rows = {r.doc_id: r for r in quality_rules.ledger(d).collect()}
    assert (rows[1].n_words, rows[1].n_words_input, rows[1].fail_bits_input, rows[1]["a.b"]) == (30, 7, "x", 2) and rows[2].n_words == 0
    assert quality_rules.keep(d.withColumnRenamed("n_words", "c0")).columns == ["doc_id", "text", "c0", "fail_bits", "a.b"]
