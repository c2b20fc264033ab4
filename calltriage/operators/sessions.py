"""Sessions of chunks, as batch operators over sorted windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings


def rolling_transcript(chunks: DataFrame, session: str, seq: str, chunk: str, s: Settings = Settings()) -> DataFrame:
    """The last characters of each session's text so far, at each chunk.

    As if each chunk were added after a space and the whole stripped: white
    space at a chunk's end goes, and blank or null chunks add nothing. Chunks
    that add something add two characters at least, so the frame holds half as
    many of them as characters.
    """
    said = F.regexp_replace(F.col(chunk), r"(?U)\s+$", "")
    w = Window.partitionBy(session)
    d = chunks.withColumn("__said", F.when(said != "", said))
    d = d.withColumn("__k", F.count("__said").over(w.orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.collect_list("__said").over(w.orderBy("__k").rangeBetween(-(s.rolling_chars // 2), 0)), " ")
    return d.withColumn("transcript", F.right(F.regexp_replace(joined, r"(?U)^\s+", ""), F.lit(s.rolling_chars))).drop("__said", "__k")


def final_transcript(chunks: DataFrame, session: str, seq: str, chunk: str) -> DataFrame:
    rows = chunks.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(chunk).alias("c")))).alias("r"))
    return rows.select(session, F.array_join(F.col("r.c"), " ").alias("transcript"))


def hysteresis(scores: DataFrame, session: str, seq: str, score: str, s: Settings = Settings()) -> DataFrame:
    """Adds ``level`` without flicker: up at a threshold plus the margin, down at one minus it.

    A score beyond the outer bounds sets the level from any state. Between two
    such scores the level can only move to suspicious, once: from high when a
    score falls to the inner bound, from low when one rises to it.
    """
    x = F.col(score)
    up_high, up_susp = s.high + s.margin, s.suspicious + s.margin
    down_low, down_susp = s.suspicious - s.margin, s.high - s.margin
    w = Window.partitionBy(session).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    reset = F.when(x >= up_high, "high").when(x <= down_low, "low")
    d = scores.withColumns({"__g": F.sum(F.when(reset.isNotNull(), 1).otherwise(0)).over(w), "__base": F.coalesce(F.last(reset, ignorenulls=True).over(w), F.lit("low"))})
    g = Window.partitionBy(session, "__g").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    inner = F.when(reset.isNull(), x)
    moved = F.when(F.col("__base") == "high", F.min(inner).over(g) <= down_susp).otherwise(F.max(inner).over(g) >= up_susp)
    return d.withColumn("level", F.when(F.coalesce(moved, F.lit(False)), "suspicious").otherwise(F.col("__base"))).drop("__g", "__base")


def escalations(levels: DataFrame, session: str, seq: str) -> DataFrame:
    """The rows at which a session turns high."""
    w = Window.partitionBy(session).orderBy(seq)
    return levels.withColumn("__was", F.lag("level").over(w)).filter((F.col("level") == "high") & F.coalesce(F.col("__was") != "high", F.lit(True))).drop("__was")


def interim_delta(current: Column, sent: Column) -> Column:
    """What to send: the new end if the text only grew, else all of it; null if nothing is new."""
    grown = F.when(F.startswith(current, sent), F.substring(current, F.length(sent) + 1, F.length(current))).otherwise(current)
    out = F.trim(F.coalesce(grown, current))
    return F.when(out != "", out)


def evict(sessions: DataFrame, last_seen: str, session: str, s: Settings = Settings()) -> DataFrame:
    """The most recently used sessions."""
    return sessions.orderBy(F.desc(last_seen), session).limit(s.max_sessions)


def throttle(rows: DataFrame, session: str, ts: str, seq: str, every_ms: int = 2500) -> DataFrame:
    """The rows (session, seq, ts) that are sent: a session's first, then each that comes ``every_ms`` or more after the last one sent.

    What is sent next follows from what was sent before, so a session's rows
    are streamed in order through one task, which holds only the last time.
    Rows without a time are not sent.
    """
    narrow = rows.select(F.col(session).alias("session"), F.col(seq).alias("seq"), F.col(ts).alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    narrow = narrow.repartition("session").sortWithinPartitions("session", "at", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = (), 0
        for batch in batches:
            who, at = batch.column("session").to_pylist(), batch.column("at").to_pylist()
            sent = []
            for s, t in zip(who, at, strict=True):
                sent.append(t is not None and (key != (s,) or t >= last + 1000 * every_ms))
                if sent[-1]:
                    key, last = (s,), t
            yield batch.filter(pa.array(sent, pa.bool_()))

    sent = narrow.mapInArrow(run, narrow.schema)
    return sent.select(F.col("session").alias(session), F.col("seq").alias(seq), F.col("ts").alias(ts))
