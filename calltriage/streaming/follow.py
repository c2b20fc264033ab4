"""Live sessions as one streaming query with state variables that live for a limited time, and what follows from them.

``follow`` chains two stateful operators: the first keeps each session's rolling
text and emits runs of it, which rules and a text scorer work on, the second keeps
the session's level. Nothing is written between them. ``keep_recent`` keeps the most
recently used sessions as a bounded table, batch by batch, and says which were
let go; ``follow`` forgets those. ``send_alerts`` sends each alert once, however
often a batch is repeated.

State variables need the RocksDB state store (``STATE_STORE``), which ``run_follow`` sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Settings
from ..operators import sessions, signatures
from ..operators.termmodel import TermModel
from . import sessions as live
from . import windows

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Sessions that nobody continues for this long start anew.
IDLE_MS = 24 * 3600 * 1000
RECENT = "session_id long, last_seen timestamp"


class Texts(StatefulProcessor):
    """A session's chunks of a micro-batch, in order, as runs of its text; late ones with the text as it stands.

    State variables: ``text`` and ``seen``. A row with ``forget`` clears them,
    before the chunks of its batch, and gives no row.
    """

    def __init__(self, idle_ms: int = IDLE_MS, found: tuple[str, ...] | None = None):
        self.idle_ms, self.found = idle_ms, found

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.text = handle.getValueState("text", "transcript string", self.idle_ms)
        self.seen = handle.getValueState("seen", "seq long", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = live.in_order(rows)
        if chunks["forget"].any():
            self.text.clear()
            self.seen.clear()
            chunks = chunks[~chunks["forget"]]
        if not len(chunks):
            return
        text, seen = self.text.get(), self.seen.get()
        transcript, last = text[0] if text else "", seen[0] if seen else -1
        made, transcript, last = windows.runs(key[0], transcript, last, last < 0, chunks, self.found)
        self.text.update((transcript,))
        self.seen.update((last,))
        yield made

    def close(self) -> None:
        pass


class Levels(StatefulProcessor):
    """A session's scores of a micro-batch, in order, with its level; a session's first chunk starts from low.

    State variable: ``level``.
    """

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState("level", "level string", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        scores, level = live.in_order(rows), self.level.get()
        level = level[0] if level else "low"
        levels, alerts = [], []
        for score, late, first in zip(scores["risk_score"], scores["late"], scores["first"], strict=True):
            was = level = "low" if first else level
            if not late:
                level = live.next_level(level, score)
            levels.append(level)
            alerts.append(level == "high" and was != "high")
        self.level.update((level,))
        yield live.with_levels(scores, levels, alerts, scores["late"].tolist())

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    return rows.groupBy("session_id").transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")


def follow(chunks: DataFrame, text_score: TermModel | Callable[[Column], Column] | None = None, forget: DataFrame | None = None, rules=signatures.RULES, idle_ms: int = IDLE_MS) -> DataFrame:
    """A stream of (session_id, seq, ts, chunk) as a stream of scores, levels and alerts.

    ``forget`` is a stream of (session_id) of sessions that start anew.
    Repeated and late chunks are reported as late, whatever their age. Null
    and blank chunks add nothing to the text.
    """
    rows = chunks.select("session_id", "seq", windows.micros(F.col("ts")), "chunk", F.lit(False).alias("forget"))
    if forget is not None:
        rows = rows.unionByName(forget.select("session_id", F.lit(-1).cast("long").alias("seq"), F.lit(windows.NO_TIME).alias("us"), F.lit(None).cast("string").alias("chunk"), F.lit(True).alias("forget")))
    scores = live.score_runs(lambda found: _stateful(rows, Texts(idle_ms, found), windows.RUNS), text_score, rules, "first")
    return _stateful(scores, Levels(idle_ms), live.LEVELS)


def written(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What batches have written below a folder, with their ``batch``; empty if there is none."""
    try:
        return spark.read.schema(f"{schema}, batch long").parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, batch long")


def once(rows: DataFrame, batch: int, folder: str) -> None:
    """The rows of a batch in a folder of its own: a repeated batch replaces what it wrote."""
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def keep_recent(chunks: DataFrame, out: str, s: Settings = Settings()) -> None:
    """The ``max_sessions`` most recently used sessions of all chunks there are now: each batch's sessions merged into those kept before.

    ``out/recent`` has them by batch, ``out/evicted`` the sessions that each
    batch let go. A session's last use never gets earlier, so what was let go
    can't be among the most recent ones until it is used again.
    """

    def merge(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        before = written(spark, f"{out}/recent", RECENT)
        before = before.filter(F.col("batch") == batch - 1).drop("batch")  # max_sessions rows at most
        seen = rows.groupBy("session_id").agg(F.max("ts").alias("last_seen"))
        both = before.unionByName(seen).groupBy("session_id").agg(F.max("last_seen").alias("last_seen")).persist()
        once(sessions.evict(both, "last_seen", "session_id", s), batch, f"{out}/recent")
        kept = spark.read.schema(RECENT).parquet(f"{out}/recent/batch={batch}")
        once(both.join(F.broadcast(kept), "session_id", "left_anti").select("session_id"), batch, f"{out}/evicted")
        both.unpersist()

    q = chunks.select("session_id", "ts").writeStream.foreachBatch(merge).option("checkpointLocation", f"{out}/recent-state").trigger(availableNow=True).start()
    q.awaitTermination()


def recent(spark: SparkSession, out: str) -> DataFrame:
    """The sessions kept after the last batch."""
    t = written(spark, f"{out}/recent", RECENT)
    last = t.agg(F.max("batch")).first()[0]
    return t.filter(F.col("batch") == F.lit(last)).drop("batch")


def evicted(spark: SparkSession, out: str) -> DataFrame:
    """A stream of the sessions that ``keep_recent`` lets go."""
    return spark.readStream.schema("session_id long, batch long").parquet(f"{out}/evicted")


def alert_sink(out: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the alerts of each batch of levels, in a folder by batch id."""

    def send(levels: DataFrame, batch: int) -> None:
        once(levels.filter("alert").select("session_id", "seq", "hit_ids", "risk_score"), batch, out)

    return send


def run_follow(levels: DataFrame, out: str) -> None:
    """All chunks there are now: levels to ``out/levels`` and alerts to ``out/alerts``, both by batch id; a later call goes on."""
    send = alert_sink(f"{out}/alerts")

    def put(rows: DataFrame, batch: int) -> None:
        once(rows, batch, f"{out}/levels")
        send(rows.sparkSession.read.schema(live.LEVELS).parquet(f"{out}/levels/batch={batch}"), batch)

    # with times to live, Spark would run batches without data for ever
    wanted = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    conf = levels.sparkSession.conf
    before = {k: conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        q = levels.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/follow-state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            conf.set(k, v)


def states(spark: SparkSession, out: str, variable: str) -> DataFrame:
    """A state variable of each session, as the last batch left it: ``text``, ``seen`` or ``level``."""
    # operators are numbered from the end of the plan
    t = spark.read.format("statestore").option("operatorId", 0 if variable == "level" else 1).option("stateVarName", variable).load(f"{out}/follow-state")
    # with a time to live, the value has its expiry beside it
    return t.select("key.*", "value.value.*")
