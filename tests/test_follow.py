"""The chained stateful query, recent sessions and alerts, against the batch operators."""

import time

import pytest
from pyspark.sql import functions as F

from calltriage.config import Settings
from calltriage.operators import sessions
from calltriage.plans import fixtures as fx
from calltriage.streaming import follow, sessions as live

from .conftest import SF


def length_score(text):
    return F.length(text) / (F.length(text) + 1500.0)


CHUNKS = "seq long, ts timestamp, session_id long, chunk string"


def put(spark, folder, rows):
    t = spark.createDataFrame([(i, s, c) for i, s, c in rows], "seq long, session_id long, chunk string")
    t.select("seq", F.timestamp_seconds(1_700_000_000 + F.col("seq")).alias("ts"), "session_id", "chunk").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(CHUNKS).parquet(folder)


def read(spark, out, schema=live.LEVELS):
    return spark.read.schema(f"{schema}, batch long").parquet(out)


def test_one_query_equals_the_batch_operators(spark, tmp_path):
    out = str(tmp_path / "out")
    follow.run_follow(follow.follow(fx.as_chunks(live.read_events(spark, SF)), length_score), out)
    got = {(r.session_id, r.seq): r for r in read(spark, f"{out}/levels").collect()}
    texts = sessions.rolling_transcript(fx.chunks(spark, SF), "session_id", "seq", "chunk").withColumn("late", F.lit(False))
    batch = sessions.hysteresis(live.score_texts(texts, length_score), "session_id", "seq", "risk_score")
    alerts = {(r.session_id, r.seq) for r in sessions.escalations(batch, "session_id", "seq").collect()}
    rows = batch.collect()
    assert len(rows) == len(got) == spark.read.parquet(f"{SF}/events.parquet").count()
    for r in rows:
        g = got[r.session_id, r.seq]
        assert (g.n_chars, g.hit_ids, g.level, g.alert, g.late) == (r.n_chars, r.hit_ids, r.level, (r.session_id, r.seq) in alerts, False)
        assert g.risk_score == pytest.approx(r.risk_score, abs=1e-12)
    assert alerts == {(r.session_id, r.seq) for r in read(spark, f"{out}/alerts", "session_id long, seq long").collect()} != set()
    # state read back: the last text and level of each session
    last = {r.session_id: r for r in batch.groupBy("session_id").agg(F.max_by("level", "seq").alias("level"), F.max("seq").alias("seq")).collect()}
    assert {(r.session_id, r.seq) for r in follow.states(spark, out, "seen").collect()} == {(k, r.seq) for k, r in last.items()}
    assert {(r.session_id, r.level) for r in follow.states(spark, out, "level").collect()} == {(k, r.level) for k, r in last.items()}


def test_sessions_are_apart_and_go_on_until_forgotten(spark, tmp_path):
    src, gone, out = str(tmp_path / "in"), str(tmp_path / "gone"), str(tmp_path / "out")
    spark.createDataFrame([], "session_id long").write.parquet(gone)
    forget = lambda: spark.readStream.schema("session_id long").parquet(gone)
    put(spark, src, [(1, 1, "there is an arrest warrant"), (2, 2, "hello"), (3, 1, None)])
    follow.run_follow(follow.follow(put(spark, src, [(4, 2, "  ")]), None, forget()), out)
    assert {r.session_id: r.transcript for r in follow.states(spark, out, "text").collect()} == {1: "there is an arrest warrant", 2: "hello"}
    spark.createDataFrame([(1,)], "session_id long").write.mode("append").parquet(gone)
    follow.run_follow(follow.follow(put(spark, src, [(5, 1, "anew"), (6, 2, "there"), (2, 2, "again")]), None, forget()), out)
    assert {r.session_id: r.transcript for r in follow.states(spark, out, "text").collect()} == {1: "anew", 2: "hello there"}
    late = {(r.session_id, r.seq, r.batch) for r in read(spark, f"{out}/levels").filter("late").collect()}
    assert {(s, q) for s, q, _ in late} == {(2, 2)}


def test_idle_sessions_start_anew(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    follow.run_follow(follow.follow(put(spark, src, [(1, 1, "before")]), idle_ms=1), out)
    time.sleep(0.1)
    follow.run_follow(follow.follow(put(spark, src, [(2, 1, "after")]), idle_ms=1), out)
    assert {r.seq: r.n_chars for r in read(spark, f"{out}/levels").collect()} == {1: 6, 2: 5}


def test_recent_sessions_equal_the_batch_form(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    src, out, s = str(tmp_path / "in"), str(tmp_path / "out"), Settings().override(max_sessions=7)
    seen = None
    for part in range(3):
        events.filter(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(src)
        follow.keep_recent(fx.as_chunks(spark.readStream.schema(live.EVENTS).parquet(src)), out, s)
        used = events.filter(F.col("event_id") % 3 <= part).groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("last_seen"))
        want = {tuple(r) for r in sessions.evict(used, "last_seen", "session_id", s).collect()}
        assert {tuple(r) for r in follow.recent(spark, out).select("session_id", "last_seen").collect()} == want
        now = {k for k, _ in want}
        dropped = {r.session_id for r in spark.read.parquet(f"{out}/evicted").collect()}
        assert not seen or (seen - now) <= dropped
        seen = now


def test_a_repeated_batch_gives_no_second_alert(spark, tmp_path):
    send = follow.alert_sink(str(tmp_path / "alerts"))
    rows = [(1, 5, 9, 1, "a", 0.9, "high", True, False), (2, 6, 9, 0, "", 0.1, "low", False, False)]
    t = spark.createDataFrame(rows, live.LEVELS)
    for batch in (0, 0, 1, 0):
        send(t.limit(0) if batch else t, batch)
    assert [tuple(r)[:2] for r in read(spark, str(tmp_path / "alerts"), "session_id long, seq long").collect()] == [(1, 5)]
