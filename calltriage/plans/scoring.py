"""Queries: signatures, fusion, explanation and scored calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Settings
from ..functions import risk
from ..operators import explain, normalize, scorers, signatures
from . import fixtures as fx
from . import textscores

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


def _bare(pattern: str) -> str:
    """A pattern without look-arounds, for texts in which what they forbid is masked."""
    return pattern.replace(signatures.NO_NEGATION, "").replace(signatures.NO_PLACE, "").replace("'", "''")


_CUES = "|".join(n.replace("'", "''") for n in signatures.NEGATIONS)
_NO_NEGATED = rf"""regexp_replace({{}}, '(?i)({_CUES}) ({signatures.REQUEST[2:]})', '\1_\2', 'g')"""
_NO_PLACES = r"""regexp_replace({}, '(?i)\bpin(\s*(?:code|location))', 'p_n\1', 'g')"""
_MASKED = _NO_PLACES.format(_NO_NEGATED.format("text"))
_FLAGS = ", ".join("({}) AS sig_{}".format(" OR ".join(f"regexp_matches(m, '(?i){_bare(p)}')" for p in r.patterns), r.id) for r in signatures.RULES)
FLAGS_SQL = f"{fx.CALLS_SQL}, masked AS (SELECT *, {_MASKED} AS m FROM calls), flags AS (SELECT * EXCLUDE (m), {_FLAGS} FROM masked)"
_RULES = ", ".join("({}, '{}', '{}', {}, '{}')".format(i, r.id, r.scam_type, r.severity, r.advice.replace("'", "''")) for i, r in enumerate(signatures.RULES))
_LONG = " UNION ALL ".join(f"SELECT call_id, {i} AS pos FROM flags WHERE sig_{r.id}" for i, r in enumerate(signatures.RULES))
HITS_SQL = f"""{FLAGS_SQL}, rules(pos, id, scam_type, severity, advice) AS (VALUES {_RULES}),
hits AS (SELECT * FROM ({_LONG}) JOIN rules USING (pos)),
summed AS (
  SELECT c.*, coalesce(n_hits, 0) AS n_hits, coalesce(hit_ids, '') AS hit_ids, coalesce(max_severity, 0) AS max_severity, w AS weight
  FROM calls c LEFT JOIN (
    SELECT call_id, count(*) AS n_hits, string_agg(id, ',' ORDER BY pos) AS hit_ids, max(severity) AS max_severity,
      least(sum(CASE severity WHEN 1 THEN 0.12::DOUBLE WHEN 2 THEN 0.22 WHEN 3 THEN 0.35 ELSE 0.15 END), 1.0::DOUBLE) AS w
    FROM hits GROUP BY call_id) USING (call_id)),
fused AS (
  SELECT *, 1 - (1 - coalesce(least(greatest(text_score, 0), 1), 0)) * (1 - coalesce(weight, 0) * 0.85::DOUBLE) * (1 - coalesce(audio_score, 0) * 0.45::DOUBLE) AS risk
  FROM summed),
scored AS (SELECT *, CASE WHEN risk >= 0.65::DOUBLE THEN 'high' WHEN risk >= 0.35::DOUBLE THEN 'suspicious' ELSE 'low' END AS level FROM fused)"""


_SUM = " + ".join(f"sig_{r.id}::INT * {dict([(1, 0.12), (2, 0.22), (3, 0.35)])[r.severity]}::DOUBLE" for r in signatures.RULES)
_IDS = ", ".join(f"CASE WHEN sig_{r.id} THEN '{r.id}' END" for r in signatures.RULES)
#: Rolling texts with hits, and fused with the score of a model of words.
SCORED_TEXTS_SQL = f"""{textscores.COEF_SQL}, {fx.TEXTS_SQL}, said_texts AS (SELECT seq, transcript AS text FROM texts),
{textscores.scores_sql('said', 'said_texts', 'seq', 'word')}, masked AS (SELECT session_id, seq, transcript, {_NO_PLACES.format(_NO_NEGATED.format('transcript'))} AS m FROM texts),
flags AS (SELECT session_id, seq, transcript, {_FLAGS} FROM masked),
scored_texts AS (SELECT session_id, seq, length(transcript)::INT AS n_chars, ({' + '.join(f'sig_{r.id}::INT' for r in signatures.RULES)})::INT AS n_hits, array_to_string(list_filter([{_IDS}], lambda x: x IS NOT NULL), ',') AS hit_ids,
  1 - (1 - coalesce(prob, 0)) * (1 - least({_SUM}, 1.0::DOUBLE) * 0.85::DOUBLE) AS risk_score FROM flags JOIN said_scores USING (seq))"""


def scored(spark, sf_dir, calls=None):
    """Calls with hits, sums, risk and level: what every score query starts from."""
    c = signatures.summary(signatures.with_hits(calls or fx.calls(spark, sf_dir)))
    c = c.withColumn("risk", risk.noisy_or(F.col("text_score"), F.col("hits.severity"), F.col("audio_score")))
    return c.withColumn("level", risk.classify_level(F.col("risk")))


for _r in signatures.RULES:

    def _one(spark, sf_dir, rule=_r):
        return fx.calls(spark, sf_dir).filter(signatures.flag(F.col("text"), rule)).select("call_id")

    QUERIES[f"sig_{_r.id}"] = _one
    SQL[f"sig_{_r.id}"] = f"WITH {FLAGS_SQL} SELECT call_id FROM flags WHERE sig_{_r.id}"


@query(f"WITH {FLAGS_SQL} SELECT call_id, {', '.join(f'sig_{r.id}' for r in signatures.RULES)} FROM flags")
def sig_flags(spark, sf_dir):
    return signatures.with_flags(fx.calls(spark, sf_dir)).select("call_id", *[f"sig_{r.id}" for r in signatures.RULES])


_OTP = " OR ".join(f"regexp_matches(u, '(?i){_bare(p)}')" for p in signatures.RULES[0].patterns)


def _guard_sql(mask: str) -> str:
    return f"WITH {FLAGS_SQL}, raw AS (SELECT call_id, {mask.format('text')} AS u FROM calls) SELECT call_id, sig_otp_pin_cvv_request AS asked, {_OTP} AS unguarded FROM flags JOIN raw USING (call_id)"


def _guarded(spark, sf_dir, guard):
    rule = signatures.RULES[0]
    return fx.calls(spark, sf_dir).select("call_id", signatures.flag(F.col("text"), rule).alias("asked"), signatures.flag(F.col("text"), signatures.without(rule, guard)).alias("unguarded"))


@query(_guard_sql(_NO_PLACES))
def sig_negation_guard(spark, sf_dir):
    """The rule for all calls, beside the rule that minds no negation."""
    return _guarded(spark, sf_dir, signatures.NO_NEGATION)


@query(_guard_sql(_NO_NEGATED))
def sig_pin_guard(spark, sf_dir):
    """The rule for all calls, beside the rule that takes a pin on a map for a secret."""
    return _guarded(spark, sf_dir, signatures.NO_PLACE)


def _found_sql(pattern: str) -> str:
    """The snippets of a pattern: matches are marked in the masked text and cut, by their places, from the text itself."""
    upto = lambda i: f"coalesce(list_sum(list_transform(ps[1:{i}], lambda x: length(x) - 1)), 0)::BIGINT"
    first = f"greatest({upto('i - 1')} + instr(ps[i], chr(1)) - 1 - {signatures.PAD}, 0)"
    cut = f"regexp_replace(substring(text, {first} + 1, {upto('i')} + {signatures.PAD} - {first}), '^\\s+|\\s+$', '', 'g')"
    parts = f"string_split(regexp_replace(m, '(?i)({_bare(pattern)})', chr(1) || '\\1' || chr(2), 'g'), chr(2))"
    return f"list_transform([{parts}], lambda ps: list_transform(range(1, len(ps)), lambda i: {cut}))[1]"


_SNIPPETS = " UNION ALL ".join(f"SELECT call_id, '{r.id}' AS id, {' || '.join(map(_found_sql, r.patterns))} AS l FROM masked" for r in signatures.RULES)
SNIPPETS_SQL = f"{FLAGS_SQL}, every AS ({_SNIPPETS}), kept AS (SELECT call_id, id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:{signatures.MAX_SNIPPETS}] AS l FROM every WHERE len(l) > 0)"


@query(f"WITH {SNIPPETS_SQL} SELECT call_id, id, array_to_string(l, ' | ') AS matches FROM kept")
def sig_snippets(spark, sf_dir):
    d = signatures.hits_long(fx.calls(spark, sf_dir), with_snippets=True)
    return d.select("call_id", "id", F.array_join("matches", " | ").alias("matches"))


@query(f"WITH {HITS_SQL} SELECT call_id, id, scam_type, severity, pos FROM hits")
def sig_hits_long(spark, sf_dir):
    return signatures.hits_long(fx.calls(spark, sf_dir)).select("call_id", "id", "scam_type", "severity", "pos")


@query(f"WITH {HITS_SQL} SELECT call_id, n_hits, hit_ids, max_severity FROM summed")
def sig_hit_summary(spark, sf_dir):
    return signatures.summary(signatures.with_hits(fx.calls(spark, sf_dir))).select("call_id", "n_hits", "hit_ids", "max_severity")


@query(f"WITH {HITS_SQL} SELECT call_id, round(coalesce(weight, 0), 6) AS subscore FROM summed")
def sig_subscore(spark, sf_dir):
    h = signatures.with_hits(fx.calls(spark, sf_dir))
    return h.select("call_id", F.round(risk.signature_subscore(F.col("hits.severity")), 6).alias("subscore"))


@query(f"WITH {HITS_SQL} SELECT id, scam_type, severity, count(*) AS n_calls FROM hits GROUP BY ALL")
def sig_prevalence(spark, sf_dir):
    return signatures.hits_long(fx.calls(spark, sf_dir)).groupBy("id", "scam_type", "severity").agg(F.count("*").alias("n_calls"))


@query(f"WITH {fx.CALLS_SQL} SELECT call_id, regexp_matches(text, '(?i)\\blunch\\b') AS sig_meal FROM calls")
def register_signature(spark, sf_dir):
    """A rule added as data."""
    rules = signatures.register(signatures.RULES, signatures.Rule("meal", "none", 1, (r"\blunch\b",), "A meal was offered."), spark)
    return signatures.with_flags(fx.calls(spark, sf_dir), rules[-1:]).select("call_id", "sig_meal")


@query(f"WITH {HITS_SQL} SELECT call_id, round(risk, 12) AS risk FROM fused")
def noisy_or(spark, sf_dir):
    return scored(spark, sf_dir).select("call_id", F.round("risk", 12).alias("risk"))


@query("SELECT doc_id AS call_id, CASE WHEN doc_id % 7 <> 0 THEN least(greatest((doc_id % 5) - 2.5::DOUBLE, 0), 1) END AS clamped FROM documents")
def clamp01(spark, sf_dir):
    x = F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 5 - 2.5)
    return fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("call_id"), risk.clamp01(x).alias("clamped"))


@query(f"WITH {HITS_SQL} SELECT call_id, round(text_score, 6) AS text, round(weight, 6) AS signature, round(audio_score, 6) AS audio FROM summed")
def components(spark, sf_dir):
    c = signatures.with_hits(fx.calls(spark, sf_dir)).withColumn("m", risk.components(F.col("text_score"), F.col("hits.severity"), F.col("audio_score")))
    return c.select("call_id", *[F.round(F.col("m").getItem(k), 6).alias(k) for k in ("text", "signature", "audio")])


@query(f"WITH {HITS_SQL} SELECT call_id, level FROM scored")
def classify_level(spark, sf_dir):
    return scored(spark, sf_dir).select("call_id", "level")


@query(f"WITH {HITS_SQL} SELECT level, count(*) AS n FROM scored GROUP BY level")
def risk_level_counts(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"))


_VOICE = "coalesce(audio_score >= 0.5, false)"
_TEXT = "coalesce(text_score >= 0.5, false)"
EXPLAIN_SQL = f"""{HITS_SQL},
ranked AS (SELECT call_id, advice, row_number() OVER (PARTITION BY call_id ORDER BY severity DESC, pos) AS r FROM hits),
listed AS (SELECT call_id, string_agg('- ' || advice, chr(10) ORDER BY r) FILTER (r <= 5) AS lines FROM ranked GROUP BY call_id),
explained AS (
  SELECT s.call_id, level, round(risk, 12) AS risk, n_hits, CASE
    WHEN level = 'low' THEN '{explain.LOW}'
    WHEN n_hits > 0 THEN CASE WHEN level = 'high' THEN '{explain.LIKELY}' ELSE '{explain.POSSIBLE}' END || ': ' || n_hits || CASE WHEN n_hits = 1 THEN ' known trick' ELSE ' known tricks' END || ' heard.' || chr(10) || lines
      || CASE WHEN n_hits > 5 THEN chr(10) || '...and ' || (n_hits - 5) || ' more.' ELSE '' END
      || CASE WHEN {_VOICE} THEN chr(10) || '{explain.VOICE}' ELSE '' END || chr(10) || '{explain.ADVICE}'
    ELSE CASE WHEN level = 'high' THEN '{explain.RISKY}' ELSE '{explain.CAREFUL}' END
      || CASE WHEN {_TEXT} AND {_VOICE} THEN '{explain.BASES[0]}' WHEN {_VOICE} THEN '{explain.BASES[1]}' WHEN {_TEXT} THEN '{explain.BASES[2]}' ELSE '{explain.BASES[3]}' END
      || CASE WHEN {_TEXT} THEN chr(10) || '{explain.PHRASING}' ELSE '' END || CASE WHEN {_VOICE} THEN chr(10) || '{explain.VOICE}' ELSE '' END
      || CASE WHEN NOT {_TEXT} AND NOT {_VOICE} THEN chr(10) || '{explain.WEAK}' ELSE '' END || chr(10) || '{explain.ADVICE}' END AS explanation
  FROM scored s LEFT JOIN listed USING (call_id))"""


def _explained(spark, sf_dir, calls=None):
    args = (F.col("hits"), F.col("text_score"), F.col("audio_score"))
    return scored(spark, sf_dir, calls).select("call_id", "level", F.round("risk", 12).alias("risk"), F.col("n_hits"), explain.explanation(F.col("level"), *args).alias("explanation"), explain.reasons(*args).alias("reasons"))


@query(f"WITH {EXPLAIN_SQL} SELECT call_id, explanation FROM explained")
def explain_calls(spark, sf_dir):
    return _explained(spark, sf_dir).select("call_id", "explanation")


QUERIES["explain"], SQL["explain"] = QUERIES.pop("explain_calls"), SQL.pop("explain_calls")


#: The calls' texts under the term model instead of their given scores.
MODEL_CALLS_SQL = f"{textscores.scores_sql('call', 'calls', 'call_id')}, model_calls AS (SELECT c.* REPLACE (prob AS text_score) FROM calls c JOIN call_scores USING (call_id))"
ANALYZE_SQL = f"{textscores.COEF_SQL}, " + EXPLAIN_SQL.replace(", masked AS", f", {MODEL_CALLS_SQL}, masked AS", 1).replace("FROM calls c LEFT JOIN", "FROM model_calls c LEFT JOIN")


def model_calls(spark, sf_dir):
    """The calls, whose text score comes from their text."""
    return fx.calls(spark, sf_dir).withColumn("text_score", textscores.scorer(spark, sf_dir).column(F.col("text")))


@query(f"WITH {ANALYZE_SQL} SELECT call_id, level, round(risk, 6) AS risk, n_hits, explanation FROM explained")
def analyze_calls(spark, sf_dir):
    """A call's text, rules and voice fused and explained; the text score is a term model's."""
    return _explained(spark, sf_dir, model_calls(spark, sf_dir)).drop("reasons").withColumn("risk", F.round("risk", 6))


@query(f"""WITH {EXPLAIN_SQL} SELECT level, count(*) AS n_calls, sum(CASE WHEN level = 'low' THEN 0 ELSE
  CASE WHEN n_hits > 0 THEN least(n_hits, 5) + (n_hits > 5)::INT + {_VOICE}::INT WHEN NOT {_TEXT} AND NOT {_VOICE} THEN 1 ELSE {_TEXT}::INT + {_VOICE}::INT END END)::BIGINT AS n_reasons
  FROM scored GROUP BY level""")
def explain_reasons_long(spark, sf_dir):
    """Reasons as rows, counted by level: every level but low has one a call at least."""
    d = _explained(spark, sf_dir).withColumn("reason", F.explode_outer(F.when(F.col("level") != "low", F.col("reasons"))))
    return d.groupBy("level").agg(F.countDistinct("call_id").alias("n_calls"), F.count("reason").alias("n_reasons"))


@query(f"WITH {fx.CALLS_SQL} SELECT count(*) AS n, count(text_score) AS n_text, count(audio_score) AS n_audio, round(count(text_score) / count(*), 6) AS text_share FROM calls")
def signal_coverage(spark, sf_dir):
    return fx.calls(spark, sf_dir).agg(F.count("*").alias("n"), F.count("text_score").alias("n_text"), F.count("audio_score").alias("n_audio"), F.round(F.count("text_score") / F.count("*"), 6).alias("text_share"))


@query(f"WITH {HITS_SQL} SELECT call_id, CASE WHEN risk >= 0.5::DOUBLE THEN 'high' WHEN risk >= 0.2::DOUBLE THEN 'suspicious' ELSE 'low' END AS level FROM fused")
def config_overrides(spark, sf_dir):
    s = Settings().override(high=0.5, suspicious=0.2)
    return scored(spark, sf_dir).select("call_id", risk.classify_level(F.col("risk"), s).alias("level"))


@query(f"WITH {HITS_SQL} SELECT call_id, CAST(floor(coalesce(text_score, 0) * 100 + 0.5) AS BIGINT) AS shown FROM scored")
def display_score(spark, sf_dir):
    return fx.calls(spark, sf_dir).select("call_id", risk.display_score(F.col("text_score")).alias("shown"))


@query(f"""WITH {HITS_SQL} SELECT call_id,
  CASE level WHEN 'high' THEN 'SCAM WARNING' WHEN 'suspicious' THEN 'BE CAREFUL' ELSE 'LOOKS SAFE' END AS verdict,
  CASE level WHEN 'high' THEN 'High risk' WHEN 'suspicious' THEN 'Suspicious' ELSE 'Low risk' END AS label,
  CASE max_severity WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Note' END AS severity FROM scored""")
def verdict_labels(spark, sf_dir):
    v = normalize.verdict_labels(F.col("level"))
    return scored(spark, sf_dir).select("call_id", v["verdict"].alias("verdict"), v["label"].alias("label"), normalize.severity_label(F.col("max_severity")).alias("severity"))


@query(f"WITH {SNIPPETS_SQL} SELECT call_id, id, l[1] AS snippet FROM kept")
def first_snippet(spark, sf_dir):
    d = signatures.hits_long(fx.calls(spark, sf_dir), with_snippets=True)
    return d.select("call_id", "id", F.try_element_at("matches", F.lit(1)).alias("snippet"))


@query("SELECT doc_id AS call_id, round(1 / (1 + exp(-((doc_id % 21) - 10) / 3.0::DOUBLE)), 6) AS one, round(1 / (1 + exp(((doc_id % 5) - (doc_id % 9))::DOUBLE)), 6) AS two FROM documents")
def softmax2_sigmoid(spark, sf_dir):
    k = F.col("doc_id")
    return fx.table(spark, sf_dir, "documents").select(k.alias("call_id"), F.round(risk.sigmoid((k % 21 - 10) / 3.0), 6).alias("one"), F.round(risk.softmax2((k % 5).cast("double"), (k % 9).cast("double")), 6).alias("two"))


@query(f"WITH {fx.CALLS_SQL} SELECT call_id, CASE WHEN text_score IS NULL THEN audio_score WHEN audio_score IS NULL THEN text_score ELSE greatest(text_score, audio_score) END AS best FROM calls")
def ensemble_max(spark, sf_dir):
    return fx.calls(spark, sf_dir).select("call_id", F.greatest("text_score", "audio_score").alias("best"))


_LOADED = {"both": ("terms", "length"), "terms_only": ("terms",), "length_only": ("length",), "none": ()}


@query("""SELECT id, round(greatest(p, q), 9) AS "both", round(p, 9) AS terms_only, round(q, 9) AS length_only, NULL::DOUBLE AS "none" FROM (
  SELECT conv_id * 1000 + turn AS id, CASE WHEN trim(text) <> '' THEN length(text) / (length(text) + 100.0::DOUBLE) END AS q,
    CASE WHEN trim(text) <> '' THEN CASE WHEN contains(lower(text), 'an') THEN 0.8::DOUBLE ELSE 0.2 END END AS p FROM conversations)""")
def scorer_select(spark, sf_dir):
    """The scorer that is chosen for each set of loaded ones: the ensemble of two, else the one that is there, else none."""
    models = {"terms": lambda t: F.when(F.contains(F.lower(t), F.lit("an")), 0.8).otherwise(0.2), "length": lambda t: F.length(t) / (F.length(t) + 100.0)}
    t = textscores.turns(spark, sf_dir)
    for name, loaded in _LOADED.items():
        known = scorers.Registry()
        for k, score in models.items():
            known.register(scorers.TextScorer(k, score if k in loaded else None))
        t = t.withColumn(name, F.round(known.select().column(F.col("text")), 9))
    return t.select("id", *_LOADED)
