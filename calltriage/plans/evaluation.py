"""Queries: evaluation tables, sessions and their levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import evaluate, sessions
from ..sources import files
from . import fixtures as fx
from .scoring import HITS_SQL, scored
from .textscores import COEF_SQL, scorer, scores_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql=None, name=None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


def predicted(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.withColumns(evaluate.predictions(F.col("text_score"), F.col("max_severity"), F.col("level")))


def rows(spark, sf_dir, *keep):
    return evaluate.unpivot(predicted(spark, sf_dir), "call_id", "label", *keep)


PRED_SQL = f"""{HITS_SQL}, pred AS (
  SELECT *, coalesce(text_score >= 0.5, false) AS text_only, max_severity >= 2 AS signatures_only, level <> 'low' AS fusion_notlow, level = 'high' AS fusion_high FROM scored),
rows_ AS ({" UNION ALL ".join(f"SELECT call_id, label, scam_type, source, text_score, risk, '{c}' AS config, {c} AS predicted FROM pred" for c in evaluate.CONFIGS)}),
conf AS (
  SELECT config, count(*) FILTER (predicted AND label = 1) AS tp, count(*) FILTER (NOT predicted AND label = 1) AS fn,
    count(*) FILTER (predicted AND label = 0) AS fp, count(*) FILTER (NOT predicted AND label = 0) AS tn FROM rows_ GROUP BY config)"""

for _c in evaluate.CONFIGS:

    def _one(spark, sf_dir, c=_c):
        return predicted(spark, sf_dir).select("call_id", F.col(c).alias("predicted"))

    QUERIES[f"predict_{_c}"] = _one
    SQL[f"predict_{_c}"] = f"WITH {PRED_SQL} SELECT call_id, {_c} AS predicted FROM pred"


@query(f"WITH {PRED_SQL} SELECT call_id, label, config, predicted FROM rows_")
def eval_unpivot(spark, sf_dir):
    return rows(spark, sf_dir)


@query(f"WITH {PRED_SQL} SELECT * FROM conf")
def confusion(spark, sf_dir):
    return evaluate.confusion(rows(spark, sf_dir), "config").drop("tpr", "fpr")


@query(f"WITH {PRED_SQL} SELECT config, round(tp / nullif(tp + fn, 0), 9) AS tpr, round(fp / nullif(fp + tn, 0), 9) AS fpr FROM conf")
def tpr_fpr(spark, sf_dir):
    return evaluate.confusion(rows(spark, sf_dir), "config").select("config", F.round("tpr", 9).alias("tpr"), F.round("fpr", 9).alias("fpr"))


@query(f"WITH {PRED_SQL} SELECT call_id, config, (label = 1) = predicted AS correct, (v // 100000 + CASE WHEN v % 100000 > 50000 OR (v % 100000 = 50000 AND (v // 100000) % 2 = 1) THEN 1 ELSE 0 END) / 10000.0::DOUBLE AS score FROM (SELECT *, CAST(round(risk * 1e9) AS BIGINT) AS v FROM rows_)")
def eval_records(spark, sf_dir):
    r = rows(spark, sf_dir, "risk")
    return r.select("call_id", "config", ((F.col("label") == 1) == F.col("predicted")).alias("correct"), F.bround(F.round("risk", 9).cast("decimal(18,9)"), 4).cast("double").alias("score"))


@query(f"WITH {PRED_SQL} SELECT config, call_id, CASE WHEN label = 1 THEN 'fn' ELSE 'fp' END AS kind FROM rows_ WHERE (label = 1) <> predicted")
def fp_fn_lists(spark, sf_dir):
    """One row per wrong call, so that a long list stays distributed."""
    r = rows(spark, sf_dir).filter((F.col("label") == 1) != F.col("predicted"))
    return r.select("config", "call_id", F.when(F.col("label") == 1, "fn").otherwise("fp").alias("kind"))


@query(f"WITH {PRED_SQL} SELECT call_id FROM pred WHERE label = 1 AND NOT fusion_notlow EXCEPT SELECT call_id FROM pred WHERE label = 1 AND NOT text_only")
def misses_except(spark, sf_dir):
    """As an aggregate: Spark would move filters on predictions below the rules, which are then matched for each use."""
    p = predicted(spark, sf_dir).filter("label = 1").groupBy("call_id").agg(F.bool_or(~F.col("fusion_notlow")).alias("missed"), F.bool_or(~F.col("text_only")).alias("by_text"))
    return p.filter("missed and not by_text").select("call_id")


@query(f"WITH {PRED_SQL} SELECT config, coalesce(fp / nullif(fp + tn, 0), 0) <= 1 / 15.0::DOUBLE + 1e-9 AS passed FROM conf WHERE config = 'fusion_high'")
def fpr_gate(spark, sf_dir):
    c = evaluate.confusion(rows(spark, sf_dir), "config").filter("config = 'fusion_high'")
    return c.select("config", (F.coalesce("fpr", F.lit(0.0)) <= 1 / 15 + 1e-9).alias("passed"))


@query("""WITH s AS (SELECT value AS ms, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT max(n) AS n, round(median(ms), 3) AS median, round(max(ms) FILTER (i = least(n - 1, CAST(floor(0.95 * n) AS BIGINT))), 3) AS p95, round(min(ms), 3) AS min, round(max(ms), 3) AS max, round(avg(ms), 3) AS mean FROM s""")
def latency_stats(spark, sf_dir):
    return evaluate.latency_stats(fx.table(spark, sf_dir, "events"), "value")


@query("SELECT event_type, count(value) AS n, true AS within FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_sketch(spark, sf_dir):
    """Median and 95th percentile by sketches: are their exactly counted ranks within twice the bound?"""
    e, q = fx.table(spark, sf_dir, "events"), {"median": 0.5, "p95": 0.95}
    found = evaluate.sketch_quantiles(evaluate.sketches(e, F.col("value"), "event_type"), q, "event_type")
    gaps = evaluate.rank_gaps(e, F.col("value"), found, q, "event_type")
    return gaps.select("event_type", "n", (F.greatest("median", "p95") <= 2 * evaluate.rank_error()).alias("within"))


METRICS_SQL = """n, accuracy, precision, recall, f1"""


def _metrics_sql(rows_: str, by: str) -> str:
    return f"""SELECT {by}, tp + fn + fp + tn AS n, round((tp + tn) / (tp + fn + fp + tn), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM (
  SELECT {by}, count(*) FILTER (predicted AND label = 1) AS tp, count(*) FILTER (NOT predicted AND label = 1) AS fn, count(*) FILTER (predicted AND label = 0) AS fp,
    count(*) FILTER (NOT predicted AND label = 0) AS tn FROM {rows_} GROUP BY {by})"""


def _rounded(df, *by):
    return df.select(*by, "n", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query(f"WITH {PRED_SQL} {_metrics_sql('rows_', 'config')}")
def class_metrics(spark, sf_dir):
    return _rounded(evaluate.class_metrics(rows(spark, sf_dir), "config"), "config")


@query(f"""WITH {PRED_SQL}, g AS (SELECT label, predicted, text_score, CASE WHEN source = 'src0' THEN 'synthetic' ELSE 'other' END AS part FROM rows_ WHERE config = 'text_only'),
a AS (SELECT p.part, avg(CASE WHEN p.text_score > n.text_score THEN 1.0 WHEN p.text_score = n.text_score THEN 0.5 ELSE 0 END) AS auc FROM g p JOIN g n USING (part) WHERE p.label = 1 AND n.label = 0 AND p.text_score IS NOT NULL AND n.text_score IS NOT NULL GROUP BY 1)
SELECT m.*, round(auc, 9) AS auc FROM ({_metrics_sql('g', 'part')}) m LEFT JOIN a USING (part)""")
def metrics_by_source_group(spark, sf_dir):
    """Class metrics and AUC of the generated and of all other sources; the area is that of calls with a score."""
    r = rows(spark, sf_dir, "source", "text_score").filter("config = 'text_only'").withColumn("part", F.when(F.col("source") == "src0", "synthetic").otherwise("other"))
    auc = evaluate.roc_auc(r.filter("text_score is not null").withColumn("score", F.col("text_score")), "part")
    return _rounded(evaluate.class_metrics(r, "part"), "part").join(auc, "part", "left").withColumn("auc", F.round("auc", 9))


def _curve_input(spark, sf_dir):
    return fx.calls(spark, sf_dir).filter("text_score is not null").select("label", "lang", F.col("text_score").alias("score"))


CURVE_SQL = f"""{fx.CALLS_SQL}, c AS (SELECT text_score AS score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM calls WHERE text_score IS NOT NULL GROUP BY 1),
curve AS (SELECT score, sum(n) OVER (ORDER BY score DESC) / sum(n) OVER () AS fpr, sum(p) OVER (ORDER BY score DESC) / sum(p) OVER () AS tpr FROM c UNION ALL SELECT 'inf'::DOUBLE, 0, 0)"""


@query(f"WITH {CURVE_SQL} SELECT CASE WHEN score < 2 THEN round(score, 6) ELSE 2 END AS score, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM curve")
def roc_curve(spark, sf_dir):
    """The first point's score, which is infinite, is shown as 2."""
    c = evaluate.roc_curve(_curve_input(spark, sf_dir)).withColumn("score", F.when(F.col("score") < 2, F.col("score")).otherwise(2.0))
    return c.select(*[F.round(c, 9).alias(c) for c in ("score", "fpr", "tpr")])


@query(f"WITH {fx.CALLS_SQL} SELECT round(avg(CASE WHEN p.text_score > n.text_score THEN 1.0 WHEN p.text_score = n.text_score THEN 0.5 ELSE 0 END), 9) AS auc FROM calls p, calls n WHERE p.label = 1 AND n.label = 0 AND p.text_score IS NOT NULL AND n.text_score IS NOT NULL")
def roc_auc(spark, sf_dir):
    return evaluate.roc_auc(_curve_input(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


EER_SQL = f"{CURVE_SQL}, best AS (SELECT (fpr + 1 - tpr) / 2 AS eer FROM curve ORDER BY round(abs(1 - tpr - fpr), 12), score DESC LIMIT 1)"


@query(f"WITH {EER_SQL} SELECT round(eer, 9) AS eer FROM best")
def eer(spark, sf_dir):
    return evaluate.eer(_curve_input(spark, sf_dir)).select(F.round("eer", 9).alias("eer"))


_AUC_SQL = "SELECT round(avg(CASE WHEN p.text_score > n.text_score THEN 1.0 WHEN p.text_score = n.text_score THEN 0.5 ELSE 0 END), 9) AS auc FROM calls p, calls n WHERE p.label = 1 AND n.label = 0 AND p.text_score IS NOT NULL AND n.text_score IS NOT NULL"


@query(f"WITH {EER_SQL} SELECT round(eer, 9) AS eer, ({_AUC_SQL}) AS auc, (SELECT round(avg(CASE WHEN (text_score >= 0.5) = (label = 1) THEN 1 ELSE 0 END), 9) FROM calls WHERE text_score IS NOT NULL) AS accuracy, (SELECT count(text_score) FROM calls) AS n FROM best")
def audio_eval(spark, sf_dir):
    """A voice split's four figures, from one row each; an undefined AUC counts as 0.5."""
    s = _curve_input(spark, sf_dir)
    m = evaluate.class_metrics(s.withColumn("predicted", F.col("score") >= 0.5))
    one = [evaluate.eer(s).select("eer"), evaluate.roc_auc(s).select(F.coalesce("auc", F.lit(0.5)).alias("auc")), m.select("accuracy", "n")]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one)
    return rows.agg(*[F.round(F.max(c), 9).alias(c) for c in ("eer", "auc", "accuracy")], F.max("n").alias("n"))


@query(f"""WITH {COEF_SQL}, {fx.CALLS_SQL}, probes AS (SELECT * FROM calls WHERE label = 1), {scores_sql('probe', 'probes', 'call_id', 'word')},
p AS (SELECT call_id, prob, prob >= 0.5 AS flagged FROM probe_scores WHERE prob IS NOT NULL)
SELECT call_id, round(prob, 6) AS prob, flagged, (SELECT count(*) FROM p) AS n, (SELECT count(*) FROM p WHERE flagged) AS n_flagged, (SELECT round(count(*) FILTER (flagged) / count(*), 9) FROM p) AS recall FROM p""")
def probe_heldout(spark, sf_dir):
    """The held-out scam calls with the score of their text by a model of words, and how many of them it flags."""
    p = evaluate.probe(fx.calls(spark, sf_dir).filter("label = 1").withColumn("prob", scorer(spark, sf_dir, "word").column(F.col("text"))))
    return p.select("call_id", F.round("prob", 6).alias("prob"), "flagged", "n", "n_flagged", F.round("recall", 9).alias("recall"))


@query("SELECT max(event_id) FILTER (e = m) AS event_id FROM (SELECT event_id, round(value) AS e, min(round(value)) OVER () AS m FROM events)")
def best_checkpoint(spark, sf_dir):
    """The latest of the best."""
    return fx.table(spark, sf_dir, "events").agg(F.min_by("event_id", F.struct(F.round("value"), -F.col("event_id"))).alias("event_id"))


_THRESHOLDS = (("text_score", 0.5), ("signature_severity", 2.0), ("risk_high", 0.65), ("risk_suspicious", 0.35))


@query(f"""WITH {PRED_SQL}, parts AS (
  {" UNION ALL ".join(f"SELECT 'thresholds' AS part, '{k}' AS name, NULL::BIGINT AS call_id, {v}::DOUBLE AS value" for k, v in _THRESHOLDS)}
  UNION ALL SELECT 'summary', config || '.' || what, NULL, v FROM (UNPIVOT (SELECT config, tp::DOUBLE AS tp, fn::DOUBLE AS fn, fp::DOUBLE AS fp, tn::DOUBLE AS tn FROM conf) ON tp, fn, fp, tn INTO NAME what VALUE v)
  UNION ALL SELECT 'records', config, call_id, CASE WHEN (label = 1) = predicted THEN 1 ELSE 0 END FROM rows_) SELECT * FROM parts""")
def write_eval_report(spark, sf_dir):
    """Thresholds, summary and records, written as tables of one report and read back as (part, name, call_id, value)."""
    path = files.scratch_path(spark, "report")
    r = rows(spark, sf_dir)
    correct = ((F.col("label") == 1) == F.col("predicted")).cast("double")
    thresholds = spark.createDataFrame(list(_THRESHOLDS), "name string, value double")
    files.write_report({"thresholds": thresholds, "summary": evaluate.confusion(r, "config"), "records": r.select("call_id", "config", "label", "predicted", correct.alias("correct"))}, path)
    read = lambda part: spark.read.json(f"{path}/{part}")
    none = F.lit(None).cast("long").alias("call_id")
    summary = read("summary").select("config", *[F.col(c).cast("double").alias(c) for c in ("tp", "fn", "fp", "tn")]).unpivot("config", ["tp", "fn", "fp", "tn"], "what", "value")
    parts = [
        read("thresholds").select(F.lit("thresholds").alias("part"), "name", none, "value"),
        summary.select(F.lit("summary").alias("part"), F.concat_ws(".", "config", "what").alias("name"), none, "value"),
        read("records").select(F.lit("records").alias("part"), F.col("config").alias("name"), "call_id", F.col("correct").alias("value")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


_FIGURES = ("accuracy", "precision", "recall", "f1")


@query(f"WITH {PRED_SQL}, m AS ({_metrics_sql('rows_', 'config')}), l AS (UNPIVOT m ON {', '.join(_FIGURES)} INTO NAME metric VALUE value) SELECT run, config AS split, metric, value FROM l, (VALUES ('first'), ('second')) r(run)")
def write_metrics(spark, sf_dir):
    """All figures of two runs, one appended to the other; the first is written again and replaces itself."""
    path = files.scratch_path(spark, "metrics")
    m = _rounded(evaluate.class_metrics(rows(spark, sf_dir), "config"), "config").unpivot("config", list(_FIGURES), "metric", "value").withColumnRenamed("config", "split")
    for run in ("first", "second", "first"):
        files.append_metrics(m, run, path)
    return spark.read.parquet(path)


@query(f"WITH {PRED_SQL}, probe AS (SELECT sum((text_score >= 0.5)::INT)::BIGINT AS flagged, count(*) AS n FROM calls WHERE label = 1 AND text_score IS NOT NULL) SELECT config, tp, flagged, round(flagged / n, 9) AS recall, NULL::DOUBLE AS other FROM conf, probe")
def baseline_context(spark, sf_dir):
    """A run's committed probe figures, read from its JSON document, beside the summary; fields that it lacks are null."""
    path = files.scratch_path(spark, "baseline")
    probe = evaluate.probe_figures(fx.calls(spark, sf_dir).filter("label = 1").withColumn("prob", F.col("text_score")))
    files.write_document(probe.select(F.struct(F.col("n_flagged").alias("flagged"), "n", F.round("recall", 9).alias("recall")).alias("probe")), path)
    known = files.read_baseline(spark, path, "probe", {"flagged": "long", "recall": "double", "other": "double"})
    summary = evaluate.confusion(rows(spark, sf_dir), "config")
    return summary.join(F.broadcast(known), F.lit(True), "left").select("config", "tp", "flagged", "recall", "other")  # one row


@query(f"WITH {fx.TEXTS_SQL} SELECT session_id, seq, transcript FROM texts")
def rolling_transcript(spark, sf_dir):
    return sessions.rolling_transcript(fx.chunks(spark, sf_dir), "session_id", "seq", "chunk").select("session_id", "seq", "transcript")


@query(f"WITH {fx.CHUNKS_SQL} SELECT session_id, string_agg(chunk, ' ' ORDER BY seq) AS transcript FROM chunks GROUP BY session_id")
def final_accumulate(spark, sf_dir):
    return sessions.final_transcript(fx.chunks(spark, sf_dir), "session_id", "seq", "chunk")


@query("SELECT user_id AS session_id, max(ts) AS last_seen FROM events GROUP BY user_id ORDER BY last_seen DESC, session_id LIMIT 500")
def session_evict(spark, sf_dir):
    s = fx.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("last_seen"))
    return sessions.evict(s, "last_seen", "session_id")


def levels_sql(ctes: str, table: str, score: str) -> str:
    """CTEs that end with lv(session_id, seq, r, level), the level folded over the rows of a table."""
    up_high, up_susp, down_low, down_susp = "0.65::DOUBLE + 0.05::DOUBLE", "0.35::DOUBLE + 0.05::DOUBLE", "0.35::DOUBLE - 0.05::DOUBLE", "0.65::DOUBLE - 0.05::DOUBLE"
    from_low = f"CASE WHEN x >= {up_high} THEN 'high' WHEN x >= {up_susp} THEN 'suspicious' ELSE 'low' END"
    return f"""RECURSIVE {ctes}, o AS (SELECT session_id, seq, {score} AS x, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS r FROM {table}),
lv(session_id, seq, r, level) AS (
  SELECT session_id, seq, r, {from_low} FROM o WHERE r = 1
  UNION ALL
  SELECT o.session_id, o.seq, o.r, CASE lv.level
    WHEN 'low' THEN {from_low}
    WHEN 'suspicious' THEN CASE WHEN x >= {up_high} THEN 'high' WHEN x <= {down_low} THEN 'low' ELSE 'suspicious' END
    ELSE CASE WHEN x <= {down_low} THEN 'low' WHEN x <= {down_susp} THEN 'suspicious' ELSE 'high' END END
  FROM lv JOIN o ON o.session_id = lv.session_id AND o.r = lv.r + 1)"""


LEVELS_SQL = levels_sql(fx.CHUNKS_SQL, "chunks", "risk_score")


def levels(spark, sf_dir):
    return sessions.hysteresis(fx.chunks(spark, sf_dir), "session_id", "seq", "risk_score")


@query(f"WITH {LEVELS_SQL} SELECT session_id, seq, level FROM lv")
def hysteresis(spark, sf_dir):
    return levels(spark, sf_dir).select("session_id", "seq", "level")


@query(f"WITH {LEVELS_SQL} SELECT session_id, level FROM lv WHERE r = 1")
def hysteresis_reset(spark, sf_dir):
    """A session's first level starts from low."""
    return levels(spark, sf_dir).groupBy("session_id").agg(F.min_by("level", "seq").alias("level"))


@query(f"WITH {LEVELS_SQL} SELECT session_id, seq FROM (SELECT *, lag(level) OVER (PARTITION BY session_id ORDER BY seq) AS was FROM lv) WHERE level = 'high' AND (was IS NULL OR was <> 'high')")
def alert_on_escalation(spark, sf_dir):
    return sessions.escalations(levels(spark, sf_dir), "session_id", "seq").select("session_id", "seq")


@query("""SELECT conv_id, turn, nullif(trim(CASE WHEN starts_with(cur, prev) THEN substring(cur, length(prev) + 1) ELSE cur END), '') AS delta FROM (
  SELECT conv_id, turn, cur, lag(cur) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM (
    SELECT conv_id, turn, string_agg(CASE WHEN turn % 3 = 2 THEN '' ELSE text END, '' ) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS cur FROM conversations))""")
def interim_delta(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    said = F.when(F.col("turn") % 3 == 2, "").otherwise(F.col("text"))
    t = fx.table(spark, sf_dir, "conversations").withColumn("cur", F.array_join(F.collect_list(said).over(w.rowsBetween(-1, 0)), ""))
    return t.withColumn("prev", F.lag("cur").over(w)).select("conv_id", "turn", sessions.interim_delta(F.col("cur"), F.col("prev")).alias("delta"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS session_id, event_id AS seq, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
sent(session_id, seq, ts, r, last, flushed) AS (
  SELECT session_id, seq, ts, r, ts, true FROM e WHERE r = 1
  UNION ALL
  SELECT e.session_id, e.seq, e.ts, e.r, CASE WHEN e.ts >= s.last + INTERVAL 30 MINUTE THEN e.ts ELSE s.last END, e.ts >= s.last + INTERVAL 30 MINUTE FROM sent s JOIN e ON e.session_id = s.session_id AND e.r = s.r + 1)
SELECT session_id, seq, ts FROM sent WHERE flushed""")
def interim_throttle(spark, sf_dir):
    """Half an hour after the last flush, as the table's events lie that far apart."""
    return sessions.throttle(fx.chunks(spark, sf_dir), "session_id", "ts", "seq", 30 * 60 * 1000)
