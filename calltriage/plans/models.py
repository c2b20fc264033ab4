"""Queries: text features and model, audio arrays, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audio, evaluate, logistic, scorers, termmodel, textmodel
from ..sources import files
from ..streaming import follow, sessions as live
from . import fixtures as fx
from .evaluation import levels_sql
from .scoring import SCORED_TEXTS_SQL
from .textscores import COEF_SQL, TURNS_SQL, coefficients, model, scorer, turns, vocabulary

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql=None, name=None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


@query(f"WITH {TURNS_SQL} SELECT id, term, tf FROM terms WHERE family = 'word'")
def word_ngrams(spark, sf_dir):
    return textmodel.word_ngrams(turns(spark, sf_dir), "id", "text")


@query(f"WITH {TURNS_SQL} SELECT id, term, tf FROM terms WHERE family = 'char'")
def char_ngrams(spark, sf_dir):
    return textmodel.char_ngrams(turns(spark, sf_dir), "id", "text")


@query(f"WITH {TURNS_SQL} SELECT * FROM vocab")
def vocab_select(spark, sf_dir):
    return vocabulary(spark, sf_dir)


@query(f"WITH {TURNS_SQL} SELECT family, id, term, round(1 + ln(tf), 9) AS w FROM terms")
def tf_sublinear(spark, sf_dir):
    t = textmodel.two_families(turns(spark, sf_dir), "id", "text")
    return t.select("family", "id", "term", F.round(textmodel.tf_sublinear(F.col("tf")), 9).alias("w"))


@query(f"WITH {TURNS_SQL} SELECT family, term, round(ln((1 + (SELECT count(*) FROM turns)) / (1 + df)) + 1, 9) AS idf FROM vocab")
def idf_smooth(spark, sf_dir):
    n = turns(spark, sf_dir).count()
    return vocabulary(spark, sf_dir).select("family", "term", F.round(textmodel.idf_smooth(F.col("df"), F.lit(n)), 9).alias("idf"))


@query(f"WITH {TURNS_SQL} SELECT family, id, term, round(w, 6) AS w FROM tfidf")
def tfidf_l2(spark, sf_dir):
    d, v = termmodel.dictionary(vocabulary(spark, sf_dir), turns(spark, sf_dir).count())
    # the vocabulary is bounded by its size
    names = F.broadcast(spark.createDataFrame(v[["family", "term"]].reset_index(names="i")))
    x = termmodel.features(turns(spark, sf_dir), d, "id", "text").select("id", F.explode(F.arrays_zip("i", "w")).alias("x"))
    return x.select("id", "x.i", "x.w").join(names, "i").select("family", "id", "term", F.round("w", 6).alias("w"))


def _vectors(spark, sf_dir):
    """(rows of features, label and class weight, written out; the dictionary's table); a fifth of the turns is for validation, a fifth for the test."""
    t, path = turns(spark, sf_dir), files.scratch_path(spark, "vectors")
    d, v = termmodel.dictionary(vocabulary(spark, sf_dir), t.count())
    part = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long") % 5
    rows = termmodel.features(t, d, "id", "text", "label")
    rows.withColumn("split", F.when(part == 0, "val").when(part == 1, "test").otherwise("train")).write.parquet(path)
    return spark.read.parquet(path), v


def _fitted(rows, v, strengths):
    """The models of all strengths, fitted together on the training rows."""
    return logistic.fit(logistic.balanced(rows.filter("split = 'train'")), len(v), strengths)


def _tuned(spark, sf_dir):
    """(all metrics on held-out turns for each strength and whether it is the first best, the models, the dictionary's table)."""
    rows, v = _vectors(spark, sf_dir)
    models = _fitted(rows, v, textmodel.GRID)
    scored = logistic.scored(rows.filter("split = 'val'"), models).withColumn("predicted", F.col("score") >= 0.5)
    log = evaluate.class_metrics(scored, "c").join(evaluate.roc_auc(scored, "c"), "c")
    facts = spark.createDataFrame([(c, m["iterations"], m["converged"]) for c, m in models.items()], "c double, iterations int, converged boolean")
    # a row for each strength
    first = F.row_number().over(Window.orderBy(F.desc("f1"), "c")) == 1
    return log.join(F.broadcast(facts), "c").withColumn("best", first), models, v


@query()
def logreg_fit(spark, sf_dir):
    """Metrics of the fitted model on the rows that it learned from and on those that it did not."""
    rows, v = _vectors(spark, sf_dir)
    scored = logistic.scored(rows, _fitted(rows, v, (1.0,))).withColumn("predicted", F.col("score") >= 0.5)
    return evaluate.class_metrics(scored, "split").join(evaluate.roc_auc(scored, "split"), "split")


@query()
def logreg_tune_c(spark, sf_dir):
    """The tuning log: all metrics on held-out turns for each strength, and the first with the best F1."""
    return _tuned(spark, sf_dir)[0]


@query("""WITH s AS (SELECT role = 'assistant' AS y, CAST('0x' || substring(md5((conv_id * 1000 + turn)::VARCHAR), 1, 8) AS BIGINT) % 5 AS part FROM conversations)
SELECT c, n_train, n_positive, true AS stationary FROM (SELECT count(*) AS n_train, count(*) FILTER (y) AS n_positive FROM s WHERE part > 1), (SELECT unnest([0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0])::DOUBLE AS c)""")
def logreg_optimum(spark, sf_dir):
    """For each strength, whether the loss has no slope at the fitted coefficients: added up anew from a row for each term."""
    rows, v = _vectors(spark, sf_dir)
    models = _fitted(rows, v, textmodel.GRID)
    train = logistic.balanced(rows.filter("split = 'train'"))
    part = logistic.with_scores(train, models, "p").withColumn("residual", F.transform("p", lambda p: F.col("weight") * (p - F.col("label"))))
    cs = F.array(*map(F.lit, models))
    # a row for each term has the residuals of all strengths
    at = part.select("residual", F.explode(F.arrays_zip("i", "w")).alias("x"))
    slopes = at.groupBy(F.col("x.i").alias("i")).agg(F.array(*[F.sum(F.get("residual", F.lit(k)) * F.col("x.w")) for k in range(len(models))]).alias("slopes"))
    slopes = slopes.select("i", F.explode(F.arrays_zip(cs.alias("c"), F.col("slopes").alias("slope"))).alias("s")).select("i", "s.c", "s.slope")
    own = spark.createDataFrame([(c, i, float(b)) for c, m in models.items() for i, b in enumerate(m["coefficients"])], "c double, i int, b double")
    slope = F.col("c") * F.coalesce("slope", F.lit(0.0)) + F.col("b")
    worst = own.join(slopes, ["c", "i"], "left").groupBy("c").agg(F.max(F.abs(slope)).alias("slope"))
    each = part.select("label", F.explode(F.arrays_zip(cs.alias("c"), F.col("residual"))).alias("s")).select("label", "s.*")
    n = each.groupBy("c").agg(F.count("*").alias("n_train"), F.sum("label").alias("n_positive"), F.sum("residual").alias("free"))
    flat = F.greatest(F.col("slope"), F.abs(F.col("c") * F.col("free"))) <= 1e-5 * F.greatest(F.lit(1.0), F.col("c") * F.col("n_train"))
    return n.join(worst, "c").select("c", "n_train", "n_positive", flat.alias("stationary"))


@query()
def model_persist(spark, sf_dir):
    """The model of the best strength as a table, loaded again: terms with idf and coefficient, intercept and best C beside them."""
    log, models, v = _tuned(spark, sf_dir)
    best = log.filter("best").first()["c"]
    path = files.scratch_path(spark, "model")
    textmodel.model_table(spark, v, models[best], best).write.parquet(path)
    found, intercept, best = textmodel.load_model(spark, path)
    return found.withColumns({"intercept": F.lit(intercept), "best_c": F.lit(best)})


@query(f"WITH {COEF_SQL} SELECT t.id, CASE WHEN trim(any_value(text)) <> '' THEN round(1 / (1 + exp(-(coalesce(sum(w * coef), 0) - 0.5::DOUBLE))), 6) END AS prob FROM turns t LEFT JOIN (SELECT id, w, coef FROM tfidf JOIN coefs USING (family, term)) x USING (id) GROUP BY t.id")
def logreg_score(spark, sf_dir):
    return turns(spark, sf_dir).select("id", F.round(scorer(spark, sf_dir).column(F.col("text")), 6).alias("prob"))


@query(f"WITH {COEF_SQL} (SELECT 'high' AS side, term, coef FROM coefs WHERE family = 'word' ORDER BY coef DESC, term LIMIT 25) UNION ALL (SELECT 'low', term, coef FROM coefs WHERE family = 'word' ORDER BY coef, term LIMIT 25)")
def top_features(spark, sf_dir):
    """The words with the highest and lowest coefficients; their number is the operator's feature."""
    c = coefficients(vocabulary(spark, sf_dir)).filter("family = 'word'")
    high = c.orderBy(F.desc("coef"), "term").limit(25).select(F.lit("high").alias("side"), "term", "coef")
    return high.unionByName(c.orderBy("coef", "term").limit(25).select(F.lit("low").alias("side"), "term", "coef"))


@query(f"WITH {TURNS_SQL} SELECT family, count(*) AS n FROM vocab GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM vocab")
def feature_dims(spark, sf_dir):
    v = vocabulary(spark, sf_dir)
    return v.rollup("family").agg(F.count("*").alias("n")).select(F.coalesce("family", F.lit("total")).alias("family"), "n")


def _tokens(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("tok"))


_TOK_SQL = r"tok AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS tok FROM documents)"


@query(rf"WITH {_TOK_SQL} SELECT doc_id, i::INT AS i, len(tok[i * 128 + 1:i * 128 + 256])::INT AS n FROM (SELECT doc_id, tok, unnest(CASE WHEN len(tok) + 2 > 512 THEN range(0, 1 + CAST(ceil((len(tok) - 256) / 128) AS BIGINT)) ELSE [0] END) AS i FROM tok) WHERE len(tok) + 2 > 512 UNION ALL SELECT doc_id, 0, len(tok)::INT FROM tok WHERE len(tok) + 2 <= 512")
def token_windows(spark, sf_dir):
    w = _tokens(spark, sf_dir).select("doc_id", F.posexplode(textmodel.token_windows(F.col("tok"))).alias("i", "w"))
    return w.select("doc_id", "i", F.size("w").alias("n"))


@query(rf"WITH {_TOK_SQL}, s AS (SELECT doc_id, tok, unnest(range(0, greatest(CAST(ceil((len(tok) - 256) / 128) AS BIGINT), 0) + 1)) AS i FROM tok), w AS (SELECT doc_id, len(tok[i * 128 + 1:i * 128 + 256]) AS n FROM s) SELECT doc_id, (1 + count(*) FILTER (n >= 8))::INT AS n_windows FROM w GROUP BY doc_id")
def train_windows(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", F.size(textmodel.train_windows(F.col("tok"))).alias("n_windows"))


@query(rf"WITH {_TOK_SQL}, s AS (SELECT doc_id, unnest(CASE WHEN len(tok) + 2 > 512 THEN range(0, 1 + CAST(ceil((len(tok) - 256) / 128) AS BIGINT)) ELSE [0] END) AS i FROM tok) SELECT doc_id, max((doc_id * 13 + i * 7) % 100) / 100.0::DOUBLE AS prob FROM s GROUP BY doc_id")
def window_max_pool(spark, sf_dir):
    w = _tokens(spark, sf_dir).select("doc_id", F.posexplode(textmodel.token_windows(F.col("tok"))).alias("i", "w"))
    return w.withColumn("p", (F.col("doc_id") * 13 + F.col("i") * 7) % 100 / 100.0).groupBy("doc_id").agg(F.max("p").alias("prob"))


def _waves(spark, sf_dir):
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("samples"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 2 + list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 2, 4) AS total, len(embedding)::INT AS n FROM embeddings")
def mono_mixdown(spark, sf_dir):
    m = _waves(spark, sf_dir).select("vec_id", audio.mono_mixdown(F.col("samples"), F.reverse("samples")).alias("m"))
    return m.select("vec_id", F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("m").alias("n"))


@query("SELECT vec_id, 40 AS n, round(list_sum(list_transform(CASE WHEN len(embedding) > 40 THEN embedding[(len(embedding) - 40) // 2 + 1:(len(embedding) - 40) // 2 + 40] ELSE embedding END, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def fit_window(spark, sf_dir):
    m = _waves(spark, sf_dir).select("vec_id", audio.fit_window(F.col("samples"), 40).alias("m"))
    return m.select("vec_id", F.size("m").alias("n"), F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("""WITH w AS (SELECT vec_id, embedding AS e, len(embedding) AS n, CAST('0x' || substring(md5(vec_id || '|1|42'), 1, 8) AS BIGINT) % greatest(len(embedding) - 19, 1) AS s FROM embeddings)
SELECT vec_id, s AS start, round(list_sum(list_transform(e[s + 1:s + 20], lambda x: x::DOUBLE)), 4) AS total, 20 AS n FROM w""")
def random_crop(spark, sf_dir):
    m = _waves(spark, sf_dir).select("vec_id", audio.crop_start(F.size("samples"), F.col("vec_id"), 1, 20).alias("start"), audio.random_crop(F.col("samples"), F.col("vec_id"), 1, 20).alias("m"))
    return m.select("vec_id", "start", F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("m").alias("n"))


@query("""WITH p AS (SELECT vec_id, embedding AS e, len(embedding) AS n, round_even(len(embedding) / 16000.0 * 11025, 0)::INT AS m FROM embeddings),
q AS (SELECT vec_id, e, n, m, k * n / m AS x FROM (SELECT *, unnest(range(0, m)) AS k FROM p)),
v AS (SELECT vec_id, m, e[floor(x)::INT + 1]::DOUBLE AS a, e[least(floor(x)::INT + 2, n)]::DOUBLE AS b, x - floor(x) AS f FROM q)
SELECT vec_id, any_value(m) AS n, round(sum(a + (b - a) * f), 4) AS total FROM v GROUP BY vec_id""")
def resample_linear(spark, sf_dir):
    m = _waves(spark, sf_dir).select("vec_id", audio.resample_linear(F.col("samples"), 16_000, 11_025).alias("m"))
    return m.select("vec_id", F.size("m").alias("n"), F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _mean_logits(x):
    """Stands for a voice model: a logit for each row of a batch."""
    return 3 * x.astype(float).mean(axis=1)


_MEAN = "list_avg(list_transform(embedding || list_transform(range(0, greatest(80 - len(embedding), 0)), lambda i: 0::FLOAT), lambda x: x::DOUBLE))"


@query(f"SELECT vec_id, CASE WHEN vec_id % 10 <> 3 THEN round(1 / (1 + exp(-3 * {_MEAN})), 4) END AS score FROM embeddings")
def audio_score(spark, sf_dir):
    """A batch model's logits as probabilities; rows without samples get null."""
    model = scorers.AudioScorer("mean", _mean_logits, 80)
    w = _waves(spark, sf_dir)
    return w.select("vec_id", F.round(model.column(F.when(F.col("vec_id") % 10 != 3, F.col("samples"))), 4).alias("score"))


@query("SELECT vec_id, CASE WHEN embedding[1] >= 0 THEN 0.5::DOUBLE END AS score FROM embeddings")
def null_on_failure(spark, sf_dir):
    """A model that raises for some rows: the others of their batches are scored."""

    def picky(x):
        if (x[:, 0] < 0).any():
            raise ValueError("not for me")
        return 0 * x[:, 0]

    return _waves(spark, sf_dir).select("vec_id", scorers.AudioScorer("picky", picky, 80).column(F.col("samples")).alias("score"))


@query("SELECT 'picky' AS scorer, count(*) AS tried, count(*) FILTER (embedding[1] < 0) AS failed FROM embeddings WHERE len(embedding) > 0 UNION ALL SELECT 'mean', count(*), 0 FROM embeddings WHERE len(embedding) > 0")
def scorer_failures(spark, sf_dir):
    """How many rows each voice model was tried on, and on how many it failed; one model is made in the workers."""

    def picky(x):
        if (x[:, 0] < 0).any():
            raise ValueError("not for me")
        return 0 * x[:, 0]

    known = scorers.Registry().register(scorers.AudioScorer("picky", picky, 80)).register(scorers.AudioScorer("mean", length=80, load=lambda: _mean_logits)).register(scorers.AudioScorer("absent"))
    return scorers.failures(_waves(spark, sf_dir), known, F.col("samples"))


@query(f"SELECT vec_id, 'mean,first' AS loaded, round(greatest(1 / (1 + exp(-3 * {_MEAN})), 1 / (1 + exp(-embedding[1]::DOUBLE))), 4) AS score FROM embeddings")
def register_audio_scorer(spark, sf_dir):
    """The highest of all registered voice models; one of them has no model."""
    known = scorers.Registry().register(scorers.AudioScorer("mean", _mean_logits, 80)).register(scorers.AudioScorer("absent")).register(scorers.AudioScorer("first", lambda x: x[:, 0], 80))
    return _waves(spark, sf_dir).select("vec_id", F.lit(",".join(known.loaded())).alias("loaded"), F.round(known.ensemble(F.col("samples")), 4).alias("score"))


@query("""SELECT conv_id * 1000 + turn AS id, CASE WHEN trim(text) <> '' THEN round(greatest(length(text) / (length(text) + 100.0::DOUBLE), CASE WHEN starts_with(lower(text), 'a') THEN 0.9::DOUBLE ELSE 0 END), 9) END AS score,
  'length,start' AS loaded FROM conversations""")
def register_text_scorer(spark, sf_dir):
    """The highest of all registered text scorers; one of them has no model."""
    known = scorers.Registry().register(scorers.TextScorer("length", lambda t: F.length(t) / (F.length(t) + 100.0))).register(scorers.TextScorer("absent"))
    known.register(scorers.TextScorer("start", lambda t: F.when(F.startswith(F.lower(t), F.lit("a")), 0.9).otherwise(0.0)))
    return turns(spark, sf_dir).select("id", F.round(known.ensemble(F.col("text")), 9).alias("score"), F.lit(",".join(known.loaded())).alias("loaded"))


@query(f"WITH {fx.CHUNKS_SQL} SELECT seq, session_id, chunk FROM chunks")
def chunk_stream(spark, sf_dir):
    out, state = files.scratch_path(spark, "chunks-out"), files.scratch_path(spark, "chunks-state")
    live.run_once(fx.as_chunks(live.read_events(spark, sf_dir)).select("seq", "session_id", "chunk"), out, state)
    return spark.read.parquet(out)


_STREAM_SQL = f"""WITH {levels_sql(SCORED_TEXTS_SQL, 'scored_texts', 'risk_score')}, d AS (SELECT *, lag(level) OVER (PARTITION BY session_id ORDER BY seq) AS was FROM lv)
SELECT session_id, seq, n_chars, n_hits, hit_ids, round(risk_score, 6) AS risk_score, level, level = 'high' AND coalesce(was, 'low') <> 'high' AS alert, false AS late FROM d JOIN scored_texts USING (session_id, seq)"""


@query(_STREAM_SQL)
def score_stream(spark, sf_dir):
    """The events as live chunks: rules and a model of words score the rolling text at each chunk, the level follows the scores."""
    chunks = fx.as_chunks(live.read_events(spark, sf_dir)).select("session_id", "seq", "ts", "chunk")
    return live.score_stream(chunks, files.scratch_path(spark, "stream"), model(spark, sf_dir, "word")).withColumn("risk_score", F.round("risk_score", 6))


def _followed(spark, sf_dir):
    """The folder of one run of the chained query over all events."""
    out = files.scratch_path(spark, "follow")
    chunks = fx.as_chunks(live.read_events(spark, sf_dir)).select("session_id", "seq", "ts", "chunk")
    follow.run_follow(follow.follow(chunks, model(spark, sf_dir, "word")), out)
    return out


@query(_STREAM_SQL)
def score_stream_chained(spark, sf_dir):
    """The same as one query with state variables that live for a limited time."""
    return follow.written(spark, f"{_followed(spark, sf_dir)}/levels", live.LEVELS).drop("batch").withColumn("risk_score", F.round("risk_score", 6))


@query(f"SELECT session_id, seq FROM ({_STREAM_SQL}) WHERE alert")
def alert_on_escalation_live(spark, sf_dir):
    """The alerts of that query, as its sink has them: each once, by batch id."""
    return follow.written(spark, f"{_followed(spark, sf_dir)}/alerts", "session_id long, seq long").drop("batch")


@query("SELECT user_id AS session_id, max(ts) AS last_seen FROM events GROUP BY user_id ORDER BY last_seen DESC, session_id LIMIT 500")
def session_evict_live(spark, sf_dir):
    """The most recently used sessions of a stream; their number is the operator's feature."""
    out = files.scratch_path(spark, "recent")
    follow.keep_recent(fx.as_chunks(live.read_events(spark, sf_dir)), out)
    return follow.recent(spark, out)
