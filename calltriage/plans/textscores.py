"""The turns that text models learn from, their vocabulary, and a model whose coefficients SQL can make, too."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import heavyterms, scorers, termmodel, textmodel
from ..sources import files
from . import fixtures as fx


def turns(spark, sf_dir):
    """Turns of conversations as short texts: (id, text, label)."""
    c = fx.spread(fx.table(spark, sf_dir, "conversations"), "conv_id")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("text"), (F.col("role") == "assistant").cast("int").alias("label"))


def terms_sql(made: str, source: str, key: str) -> str:
    """CTEs that end with ``made``_terms(family, key, term, tf) of a table's (key, text).

    Words are matched without look-arounds, so both engines split alike on
    letters of any language.
    """
    return rf"""{made}_toks AS (SELECT {key}, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1) AS w FROM {source}),
{made}_grams AS (SELECT {key}, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM {made}_toks),
{made}_runs AS (SELECT {key}, substring(t, i, n) AS term FROM (SELECT {key}, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM (SELECT {key}, lower(text) AS t FROM {source}), (SELECT unnest([3, 4, 5]) AS n) WHERE length(t) >= n)),
{made}_terms AS (SELECT 'word' AS family, {key}, term, count(*) AS tf FROM {made}_grams GROUP BY ALL UNION ALL SELECT 'char', {key}, term, count(*) FROM {made}_runs GROUP BY ALL)"""


TURNS_SQL = f"""turns AS (SELECT conv_id * 1000 + turn AS id, coalesce(text, '') AS text, CAST(role = 'assistant' AS INT) AS label FROM conversations),
{terms_sql('turn', 'turns', 'id')},
terms AS (SELECT * FROM turn_terms),
vocab AS (SELECT family, term, df, total FROM (
  SELECT *, row_number() OVER (PARTITION BY family ORDER BY total DESC, term) AS r FROM (SELECT family, term, count(*) AS df, sum(tf)::BIGINT AS total FROM terms GROUP BY ALL HAVING count(*) >= 2)) WHERE r <= {textmodel.FAMILY_TERMS}),
idfs AS (SELECT family, term, ln((1 + (SELECT count(*) FROM turns)) / (1 + df)) + 1 AS idf FROM vocab),
raw AS (SELECT family, id, term, (1 + ln(tf)) * idf AS w FROM terms JOIN idfs USING (family, term)),
tfidf AS (SELECT family, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id, family)) AS w FROM raw)"""

_COEF = "((ascii(substring(term, 1, 1)) * 31 + length(term) * 17) % 41 - 20) / 10.0"
COEF_SQL = f"{TURNS_SQL}, coefs AS (SELECT family, term, CAST((ascii(substring(term, 1, 1)) * 31 + length(term) * 17) % 41 - 20 AS DOUBLE) / 10.0::DOUBLE AS coef FROM vocab)"
INTERCEPT = -0.5


def scores_sql(made: str, source: str, key: str, family: str | None = None) -> str:
    """CTEs that end with ``made``_scores(key, prob): the model's score of each text of a table; blank texts have none. COEF_SQL comes before."""
    only = f"WHERE family = '{family}'" if family else ""
    return f"""{terms_sql(made, source, key)},
{made}_raw AS (SELECT family, {key}, (1 + ln(tf)) * idf AS w, coef FROM {made}_terms JOIN idfs USING (family, term) JOIN coefs USING (family, term) {only}),
{made}_z AS (SELECT {key}, sum(z) AS z FROM (SELECT {key}, family, sum(w * coef) / sqrt(sum(w * w)) AS z FROM {made}_raw GROUP BY ALL) GROUP BY ALL),
{made}_scores AS (SELECT {key}, CASE WHEN trim(text) <> '' THEN 1 / (1 + exp(-(coalesce(z, 0) + {INTERCEPT}::DOUBLE))) END AS prob FROM {source} LEFT JOIN {made}_z USING ({key}))"""


def vocabulary(spark, sf_dir):
    """The vocabulary of both families, written out; only its terms are."""
    path = files.scratch_path(spark, "vocabulary")
    heavyterms.vocabulary(turns(spark, sf_dir), "text").write.parquet(path)
    return spark.read.parquet(path)


def coefficients(v):
    return v.select("family", "term", F.expr(f"cast({_COEF} as double)").alias("coef"))


def model(spark, sf_dir, family: str | None = None) -> termmodel.TermModel:
    """The model of COEF_SQL as a term dictionary."""
    v = vocabulary(spark, sf_dir)
    v = v.filter(F.col("family") == family) if family else v
    n = turns(spark, sf_dir).count()
    terms = v.join(coefficients(v), ["family", "term"]).withColumn("idf", textmodel.idf_smooth(F.col("df"), F.lit(n)))
    return termmodel.TermModel.of(terms, INTERCEPT)


def scorer(spark, sf_dir, family: str | None = None) -> scorers.TextScorer:
    """That model as a scorer of texts; null for blank ones."""
    m = model(spark, sf_dir, family)
    return scorers.TextScorer("terms", lambda text: m.column(spark, text))
