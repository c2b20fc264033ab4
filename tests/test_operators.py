"""Golden cases and properties of the call operators."""

import math
import random
import re
from dataclasses import replace
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from calltriage.config import Settings
from calltriage.functions import risk
from calltriage.operators import audio, corpus, evaluate, explain, normalize, scorers, sessions, signatures, textmodel
from calltriage.plans import fixtures as fx, models
from calltriage.sources import files
from calltriage.streaming import sessions as live

from .conftest import SF


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_speakers_and_types(spark):
    r = one(spark, a=normalize.normalize_speakers(F.lit("Suspect :  hi\n Person B: yo")), b=normalize.unify_type(F.lit("ssn"), F.lit(0)), c=normalize.unify_type(F.lit(None).cast("string"), F.lit(1)), d=normalize.unify_type(F.lit("wrong"), F.lit(0)))
    assert tuple(r) == ("Caller: hi Receiver: yo", "none", "unknown_scam", "wrong_number")


@pytest.mark.parametrize(
    ("text", "sev", "voice", "want"),
    [(None, [], None, 0.0), (0.588, [], None, 0.588), (0.6, [3, 2], 0.4, 0.830916), (None, [], 1.0, 0.45), (0.18, [], 0.999, 0.548631), (0.9, [], 1.0, 0.945), (None, [3], None, 0.2975), (None, [3] * 10, None, 0.85)],
)
def test_fusion(spark, text, sev, voice, want):
    r = one(spark, x=risk.noisy_or(F.lit(text).cast("double"), F.array(*map(F.lit, sev)).cast("array<int>"), F.lit(voice).cast("double")))
    assert r.x == pytest.approx(want, abs=1e-6)


def test_levels(spark):
    assert tuple(one(spark, **{f"l{i}": risk.classify_level(F.lit(x)) for i, x in enumerate((0.0, 0.35, 0.65, 1.0))})) == ("low", "suspicious", "high", "high")


def test_rules_equal_python_matching(spark):
    texts = [*fx.TEMPLATES, "", None, "Never share your OTP", "x" * 40 + " share your pin code, share your pin now", "OTP? read it. otp please read it out"]
    df = spark.createDataFrame(list(enumerate(texts)), "call_id long, text string")
    got = {r.call_id: {h.id: list(h.matches) for h in r.hits} for r in signatures.with_hits(df, with_snippets=True).collect()}
    for i, t in enumerate(texts):
        want = {}
        for rule in signatures.RULES:
            found = []
            for p in rule.patterns:
                for m in re.finditer(p, t or "", re.IGNORECASE):
                    s = t[max(0, m.start() - 15) : m.end() + 15].strip()
                    found += [s] if s not in found else []
            if found:
                want[rule.id] = found[:3]
        assert got[i] == want


def test_explanations_have_reasons(spark):
    df = spark.createDataFrame([(lv, t, v) for lv in ("low", "suspicious", "high") for t in (None, 0.2, 0.9) for v in (None, 0.3, 0.9)], "level string, t double, v double")
    none = F.array().cast("array<struct<severity:int,pos:int,advice:string>>")
    for r in df.select("*", explain.explanation(F.col("level"), none, F.col("t"), F.col("v")).alias("x")).collect():
        assert "tricks heard" not in r.x
        assert r.x == explain.LOW if r.level == "low" else "\n- " in r.x


def test_hysteresis_window_equals_fold(spark):
    rng = random.Random(3)
    rows = [(s, i, rng.choice([0.0, 0.29, 0.3, 0.34, 0.375, 0.4, 0.41, 0.5, 0.6, 0.61, 0.65, 0.7, 0.75, 1.0])) for s in range(20) for i in range(60)]
    rows += [(99, i, x) for i, x in enumerate((0, 0.375, 0.41, 0.325, 0.29, 0.75, 0.5, 0.29))]
    rows = [(s, i, float(x)) for s, i, x in rows]
    got = {(r.s, r.i): r.level for r in sessions.hysteresis(spark.createDataFrame(rows, "s long, i long, x double"), "s", "i", "x").collect()}
    level = {}
    for s, i, x in rows:
        level[s] = live.next_level(level.get(s, "low"), x)
        assert got[s, i] == level[s]
    assert [got[99, i] for i in range(8)] == ["low", "low", "suspicious", "suspicious", "low", "high", "suspicious", "low"]


def test_stream_equals_batch(spark, tmp_path):
    """Texts, scores, levels and alerts as the batch operators have them; rules are found across chunks."""
    got = {(r.session_id, r.seq): r for r in live.score_stream(fx.as_chunks(live.read_events(spark, SF)), str(tmp_path / "out"), _length_score).collect()}
    texts = sessions.rolling_transcript(fx.chunks(spark, SF), "session_id", "seq", "chunk").withColumn("late", F.lit(False))
    scores = live.score_texts(texts, _length_score)
    batch = sessions.hysteresis(scores, "session_id", "seq", "risk_score")
    alerts = {(r.session_id, r.seq) for r in sessions.escalations(batch, "session_id", "seq").collect()}
    rows = batch.collect()
    assert len(rows) == len(got) == spark.read.parquet(f"{SF}/events.parquet").count()
    for r in rows:
        g = got[r.session_id, r.seq]
        assert (g.n_chars, g.hit_ids, g.level, g.alert, g.late) == (r.n_chars, r.hit_ids, r.level, (r.session_id, r.seq) in alerts, False)
        assert g.risk_score == pytest.approx(r.risk_score, abs=1e-12)
    assert len({r.level for r in rows}) == 3 and alerts


def test_a_phrase_across_chunks_raises_the_level(spark, tmp_path):
    parts = ["hello, there is an arrest", "warrant and you must share", "", None, "your otp, stay on the", "call", "bye"]
    events = [(i, datetime(2024, 1, 1, 0, i), 7, c) for i, c in enumerate(parts)]
    spark.createDataFrame(events, "seq long, ts timestamp, session_id long, chunk string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, ts timestamp, session_id long, chunk string").parquet(str(tmp_path / "in"))
    got = live.score_stream(stream, str(tmp_path / "out")).orderBy("seq").collect()
    assert [r.n_hits for r in got] == [0, 1, 1, 1, 2, 2, 2]
    assert [r.level for r in got] == ["low"] * 4 + ["suspicious"] * 3 and not any(r.alert for r in got)


def test_rolling_text_equals_the_fold(spark):
    rng = random.Random(8)
    rows = [(s, i, rng.choice(["", "  ", None, " a", "b ", "word\n", "two  words", "é"])) for s in range(6) for i in range(50)]
    s = Settings().override(rolling_chars=20)
    got = {(r.s, r.i): r.transcript for r in sessions.rolling_transcript(spark.createDataFrame(rows, "s long, i long, c string"), "s", "i", "c", s).collect()}
    text = {}
    for k, i, c in rows:
        text[k] = live.next_transcript(text.get(k, ""), c or "", s)
        assert got[k, i].strip() == text[k].strip()


def test_split_sizes_and_dedup(spark):
    df = spark.createDataFrame([(i, "a", i % 2) for i in range(20)], "id long, source string, label int")
    n = {(r.label, r.split): r["count"] for r in corpus.stratified_split(df, ["label", "source"], "id").groupBy("label", "split").count().collect()}
    assert n == {(k, s): c for k in (0, 1) for s, c in (("train", 8), ("val", 1), ("test", 1))}
    d = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (4, None)], "id long, text string")
    assert sorted(r.id for r in corpus.dedup_keep_first(d, "text", "id").collect()) == [1, 2]


def test_rates_without_a_class_are_null(spark):
    r = evaluate.confusion(spark.createDataFrame([(1, True), (1, False)], "label int, predicted boolean")).first()
    assert (r.tp, r.fn, r.tpr, r.fpr) == (1, 1, 0.5, None)


def test_windows(spark):
    for n, want in ((510, 1), (511, 3), (1000, 7), (0, 1)):
        assert spark.range(1).select(F.size(textmodel.token_windows(F.array_repeat(F.lit("a"), n))).alias("n")).first().n == want


def test_waveforms(spark):
    ramp = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("float"))
    r = one(spark, short=audio.fit_window(ramp(5), 8), long=audio.fit_window(ramp(12), 8), same=audio.fit_window(ramp(8), 8))
    assert r.short == [0, 1, 2, 3, 4, 0, 0, 0] and r.long == list(range(2, 10)) and r.same == list(range(8))


def _length_score(text):
    """Stands for a text model."""
    return F.length(text) / 6000.0


def test_settings():
    assert Settings().override(high=0.9).high == 0.9
    with pytest.raises(TypeError):
        Settings().override(unknown=1)


def test_models_learn_from_all_turns_and_both_families(spark):
    d, v = models._vectors(spark, SF)
    x = d.collect()
    assert len(x) == models.turns(spark, SF).count() and set(v["family"]) == {"word", "char"}
    assert max(math.fsum(w * w for w in r.w) for r in x) == pytest.approx(2)  # each family has length one


def test_tuned_strength_is_kept_with_the_model(spark):
    log, found, v = models._tuned(spark, SF)
    log = sorted(log.collect(), key=lambda r: r.c)
    assert [r.c for r in log] == list(textmodel.GRID) and all(r.converged and 0 <= r.auc <= 1 for r in log)
    best = max(log, key=lambda r: r.f1).c  # the first, if several are equal
    assert [r.c for r in log if r.best] == [best]
    rows = models.QUERIES["model_persist"](spark, SF).collect()
    n = {f: sum(r.family == f for r in rows) for f in ("word", "char")}
    assert n["char"] > 300 and n["word"] > 300 and {r.best_c for r in rows} == {best} and all(r.idf >= 1 for r in rows)
    assert rows[0].intercept == pytest.approx(found[best]["intercept"], abs=1e-6)


def test_models_that_cannot_be_read(spark, tmp_path):
    assert textmodel.load_model(spark, str(tmp_path / "none")) is None
    spark.range(1).write.parquet(str(tmp_path / "bad"))
    assert textmodel.load_model(spark, str(tmp_path / "bad")) is None
    spark.createDataFrame([("word", "a", 0.5)], "family string, term string, coef double").write.parquet(str(tmp_path / "plain"))
    terms, intercept, best = textmodel.load_model(spark, str(tmp_path / "plain"))
    assert (terms.first().coef, intercept, best) == (0.5, 0.0, None)


def test_scorers(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, []), (4, [-1.0, 0.0])], "id long, x array<float>")

    def picky(x):
        if (x[:, 0] < 0).any():
            raise ValueError("not for me")
        return x[:, 0]

    r = scorers.Registry().register(scorers.AudioScorer("none")).register(scorers.AudioScorer("picky", picky, 3))
    got = {r.id: r.p for r in df.select("id", r.ensemble(F.col("x")).alias("p")).collect()}
    assert got[1] == pytest.approx(1 / (1 + math.exp(-1))) and got[2] is got[3] is got[4] is None
    assert r.loaded() == ["picky"] and one(spark, p=scorers.Registry().ensemble(F.lit("x"))).p is None
    with pytest.raises(ValueError):
        r.register(scorers.AudioScorer("picky"))
    t = scorers.TextScorer("len", lambda c: F.length(c) / 10.0)
    assert tuple(one(spark, a=t.column(F.lit("abc")), b=t.column(F.lit(" \n")), c=t.column(F.lit(None).cast("string")))) == (0.3, None, None)


def test_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(g, x, rng.randrange(5)) for g in ("a", "b", None) for x in range(700)]
    d = evaluate.running_sums(spark.createDataFrame(rows, "g string, x long, n long"), F.desc("x"), {"n": "upto"}, "g")
    got = {(r.g, r.x): (r.upto, r.upto_all) for r in d.collect()}
    for g in ("a", "b", None):
        mine, total = sorted((x, n) for k, x, n in rows if k == g), 0
        for x, n in reversed(mine):
            total += n
            assert got[g, x] == (total, sum(n for _, n in mine))


def test_split_equals_ranks(spark):
    df = spark.createDataFrame([(i, "ab"[i % 7 > 3], None if i % 5 == 0 else i % 2) for i in range(900)] + [(5000, "c", 1), (5001, "d", 1), (5002, "d", 1)], "id long, source string, label int")
    from pyspark.sql import Window

    w = Window.partitionBy("label", "source").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit("|42"))), "id")
    r, n = F.row_number().over(w), F.count("*").over(Window.partitionBy("label", "source"))
    a, b = F.bround(n * 0.8), F.bround(n * 0.1)
    want = {r.id: r.s for r in df.select("id", F.when(r <= a, "train").when(r <= a + b, "val").otherwise("test").alias("s")).collect()}
    assert {r.id: r.split for r in corpus.stratified_split(df, ["label", "source"], "id").collect()} == want


def test_checks_raise(spark):
    v = spark.createDataFrame([("a", 0), ("b", 2)], "rule string, n long")
    assert corpus.require(v, "a").count() == 2
    with pytest.raises(ValueError, match="b: 2 rows"):
        corpus.require(v)
    p = spark.createDataFrame([("/x/a",)], "path string")
    with pytest.raises(FileNotFoundError):
        files.existing(p, p.limit(0))
    assert files.existing(p, p)[1] == 0


def test_missing_baseline_is_null(spark, tmp_path):
    assert tuple(files.read_baseline(spark, str(tmp_path / "no"), "probe", {"n": "long"}).first()) == (None,)
    (tmp_path / "b.json").write_text('{"other": {"n": 1}}')
    assert tuple(files.read_baseline(spark, str(tmp_path / "b.json"), "probe", {"n": "long"}).first()) == (None,)
    (tmp_path / "c.json").write_text('{"probe": {"n": 3}}')
    assert tuple(files.read_baseline(spark, str(tmp_path / "c.json"), "probe", {"n": "long", "r": "double"}).first()) == (3, None)


# Expected rule ids of texts written for the rules, as literals.
GOLDEN = (
    ("You are under digital arrest. Share the OTP now, do not tell anyone, you have within ten minutes.", {"otp_pin_cvv_request", "digital_arrest_or_warrant_threat", "secrecy_demand", "urgency_deadline"}),
    ("Please install AnyDesk on the phone.", {"remote_access_app_request"}),
    ("Accept the collect request, scan this qr code.", {"upi_collect_qr_trick"}),
    ("Your KYC is incomplete; move the money to a safe account.", {"kyc_expiry_threat", "safe_account_rbi_transfer"}),
    ("You are the lottery winner.", {"prize_lottery_fee"}),
    ("We send your photos to everyone on the list.", {"loan_app_photo_threat"}),
    ("I am in the army and pay by transfer.", {"army_marketplace_claim"}),
    ("It is a guaranteed profit, double your money.", {"investment_guaranteed_return"}),
    ("The bank will never ask; never share your OTP.", set()),
    ("You do not need to share your PIN.", set()),
    ("I can share a pin location, or send me the pin code of the area.", set()),
    ("\u017fhare the otp", {"otp_pin_cvv_request"}),
    ("SHARE THE \u212aYC PIN; K\u0131ndly confirm the p\u0131n", {"otp_pin_cvv_request"}),
    ("", set()),
    (None, set()),
    ("Mum, dinner is at seven.", set()),
)


def test_golden_rule_ids(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in GOLDEN)), "call_id long, text string")
    got = {r.call_id: set(r.hit_ids.split(",")) - {""} for r in signatures.summary(signatures.with_hits(df)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(GOLDEN)}


def test_anchors_change_nothing(spark):
    """Every rule finds the same with and without its anchors, in the calls and in words put together at random."""
    rng = random.Random(6)
    words = sorted({w for r in signatures.RULES for a in r.anchors for w in a.split()} | set("share tell me the your in for a won receive won't not photos 20% month blocked today pay buy".split()))
    texts = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(800)]
    df = fx.calls(spark, SF).select("text").unionByName(spark.createDataFrame([(t,) for t in texts], "text string"))
    pairs = [(signatures.flag(F.col("text"), r), signatures.flag(F.col("text"), replace(r, anchors=()))) for r in signatures.RULES]
    r = df.agg(*[F.count_if(a != b).alias(f"d{i}") for i, (a, b) in enumerate(pairs)], *[F.count_if(a).alias(f"n{i}") for i, (a, _) in enumerate(pairs)]).first()
    assert all(r[f"d{i}"] == 0 and r[f"n{i}"] > 0 for i in range(len(pairs)))


def test_stream_reads_a_folder_of_parts_and_reports_late_chunks(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.timestamp_seconds(1_700_000_000 + F.col("event_id")))
    sf, out = str(tmp_path / "sf"), str(tmp_path / "out")
    later = F.col("event_id") >= events.count() // 2
    events.filter(later).repartition(3).write.parquet(f"{sf}/events.parquet")
    assert live.score_stream(fx.as_chunks(live.read_events(spark, sf)), out).count() == events.filter(later).count() > 0
    events.filter(~later).repartition(2).write.mode("append").parquet(f"{sf}/events.parquet")
    got = live.score_stream(fx.as_chunks(live.read_events(spark, sf)), out)
    assert sorted(r.seq for r in got.collect()) == sorted(r.event_id for r in events.collect()) and got.filter("late").count() > 0
