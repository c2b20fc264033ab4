"""Live sessions as Structured Streaming.

Two queries follow one another. The first keeps each session's rolling text as
state and emits runs of it (``windows``); rules, a text scorer and fusion score
the text at each chunk, and only the scores are written. The second keeps each session's level as state and
emits levels and alerts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Settings
from ..functions import risk
from ..operators import scorers, signatures
from ..operators.termmodel import TermModel
from . import windows

DAY_MS = 24 * 3600 * 1000
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
TEXTS = "session_id long, seq long, ts timestamp, transcript string, late boolean"
SCORES = "session_id long, seq long, ts timestamp, n_chars int, n_hits int, hit_ids string, risk_score double, late boolean"
LEVELS = "session_id long, seq long, n_chars int, n_hits int, hit_ids string, risk_score double, level string, alert boolean, late boolean"


def next_level(level: str, score: float, s: Settings = Settings()) -> str:
    """One step of the level: up at a threshold plus the margin, down at one minus it."""
    if score >= s.high + s.margin:
        return "high"
    if score <= s.suspicious - s.margin:
        return "low"
    if level == "low":
        return "suspicious" if score >= s.suspicious + s.margin else "low"
    if level == "high":
        return "suspicious" if score <= s.high - s.margin else "high"
    return level


def next_transcript(transcript: str, chunk: str, s: Settings = Settings()) -> str:
    return f"{transcript} {chunk}".strip()[-s.rolling_chars :]


def _keep(state: GroupState, values: tuple, rows: pd.DataFrame) -> None:
    """Sessions that nobody continues for a day of event time are forgotten."""
    state.update(values)
    state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + DAY_MS)


def in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A session's rows of a micro-batch by seq."""
    rows = list(batches)
    rows = rows[0] if len(rows) == 1 else pd.concat(rows)
    return rows if rows["seq"].is_monotonic_increasing else rows.sort_values("seq", kind="stable")


def _texts(found: tuple[str, ...] | None):
    """A session's chunks of a micro-batch, in order, as runs of its text; repeated or late ones with the text as it stands."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        transcript, last = state.get if state.exists else ("", -1)
        chunks = in_order(batches)
        made, transcript, last = windows.runs(key[0], transcript, last, False, chunks, found)
        _keep(state, (transcript, last), chunks)
        yield made

    return run


def with_levels(rows: pd.DataFrame, levels: list[str], alerts: list[bool], late: list[bool]) -> pd.DataFrame:
    """A session's scores with levels, made at once, as there are many short sessions."""
    return pd.DataFrame({c: rows[c].to_numpy() for c in ("session_id", "seq", "n_chars", "n_hits", "hit_ids", "risk_score")} | {"level": levels, "alert": alerts, "late": late})


def _levels(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A session's scores of a micro-batch, in order, with its level; late ones with the level as it stands."""
    if state.hasTimedOut:
        state.remove()
        return
    level, last = state.get if state.exists else ("low", -1)
    rows = in_order(batches)
    levels, alerts, late = [], [], []
    for seq, score, was_late in zip(rows["seq"], rows["risk_score"], rows["late"], strict=True):
        late.append(bool(was_late) or seq <= last)
        was = level
        if not late[-1]:
            level, last = next_level(level, score), seq
        levels.append(level)
        alerts.append(level == "high" and was != "high")
    _keep(state, (level, int(last)), rows)
    yield with_levels(rows, levels, alerts, late)


def text_runs(chunks: DataFrame, found: tuple[str, ...] | None) -> DataFrame:
    """A stream of (session_id, seq, ts, chunk) as runs of the sessions' texts."""
    rows = chunks.select("session_id", "seq", "ts", "chunk", windows.micros(F.col("ts"))).withWatermark("ts", "1 day")
    return rows.groupBy("session_id").applyInPandasWithState(_texts(found), windows.RUNS, "transcript string, seq long", "append", GroupStateTimeout.EventTimeTimeout)


def rolling_texts(chunks: DataFrame) -> DataFrame:
    """A stream of (session_id, seq, ts, chunk) with the session's rolling text at each chunk."""
    return windows.texts(text_runs(chunks, None))


def score_texts(texts: DataFrame, text_score: Callable[[Column], Column] | None = None, rules=signatures.RULES, *kept: str) -> DataFrame:
    """Rolling texts, batch or stream, scored by rules and a text scorer (none: that signal is missing); the texts are left out, columns of ``kept`` stay."""
    d = signatures.summary(signatures.with_hits(texts, rules, "transcript"))
    own = text_score(F.col("transcript")) if text_score else F.lit(None).cast("double")
    d = d.withColumn("risk_score", risk.noisy_or(own, F.col("hits.severity"), F.lit(None).cast("double")))
    return d.select("session_id", "seq", "ts", F.length("transcript").alias("n_chars"), F.col("n_hits").cast("int").alias("n_hits"), "hit_ids", "risk_score", "late", *kept)


def score_runs(make: Callable[[tuple[str, ...] | None], DataFrame], text_score: TermModel | Callable[[Column], Column] | None = None, rules=signatures.RULES, *kept: str) -> DataFrame:
    """The same of runs, which ``make`` gives for the anchors to look for: windows are scored together where the scorers allow it, else each rolling text."""
    if not windows.applies(text_score, rules):
        if isinstance(text_score, TermModel):
            text_score = scorers.TextScorer("terms", partial(text_score.column, SparkSession.active())).column
        return score_texts(windows.texts(make(None), *kept), text_score, rules, *kept)
    d = signatures.summary(windows.with_hits(windows.scored(make(windows.anchors(rules)), text_score, rules), rules))
    d = d.withColumn("risk_score", risk.noisy_or(F.col("text_score"), F.col("hits.severity"), F.lit(None).cast("double")))
    return d.select("session_id", "seq", windows.time(F.col("us")), "n_chars", F.col("n_hits").cast("int").alias("n_hits"), "hit_ids", "risk_score", "late", *kept)


def follow_levels(scores: DataFrame) -> DataFrame:
    """A stream of scores with levels and alerts."""
    return scores.withWatermark("ts", "1 day").groupBy("session_id").applyInPandasWithState(_levels, LEVELS, "level string, seq long", "append", GroupStateTimeout.EventTimeTimeout)


def read_events(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    """The events as a stream."""
    # a glob of the whole path finds a single file and a folder of part files
    return spark.readStream.schema(EVENTS).parquet(f"{folder.rstrip('/')}/{glob[:-1]}[{glob[-1]}]")


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Everything there is now, written as Parquet; a later call goes on where this one stopped."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination()


def score_stream(chunks: DataFrame, out: str, text_score: TermModel | Callable[[Column], Column] | None = None) -> DataFrame:
    """Scores, levels and alerts of all chunks there are now, read back from ``out``, where a later call goes on.

    Chunks that come with a smaller seq than their session has seen are
    reported as late, with the text and level as they stand; Spark drops those
    older than the watermark of a day.
    """
    spark = chunks.sparkSession
    run_once(score_runs(partial(text_runs, chunks), text_score), f"{out}/scores", f"{out}/scores-state")
    scores = spark.readStream.schema(SCORES).parquet(f"{out}/scores")
    run_once(follow_levels(scores), f"{out}/levels", f"{out}/levels-state")
    return spark.read.schema(LEVELS).parquet(f"{out}/levels")
