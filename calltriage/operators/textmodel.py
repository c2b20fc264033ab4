"""Word and character features, TF-IDF and a logistic model over term tables."""

from __future__ import annotations

import logging
from functools import reduce

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.risk import sigmoid

LOG = logging.getLogger(__name__)
FAMILIES = ("word", "char")
#: Terms of each family that a model learns from.
FAMILY_TERMS = 30_000
GRID = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0)


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def _dealt(docs: DataFrame, id_col: str) -> DataFrame:
    """Documents dealt out by id: their terms, many times as large, can then be counted where they are made."""
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)


def word_ngrams(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, term, tf) of words and word pairs, counted in each document."""
    d = _dealt(docs.select(id_col, F.col(text).alias("t")), id_col).select(id_col, word_tokens(F.col("t")).alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return d.select(id_col, F.explode(F.concat("w", pairs)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def char_ngrams(docs: DataFrame, id_col: str, text: str, low: int = 3, high: int = 5) -> DataFrame:
    """(id, term, tf) of character runs over the whole lower-cased text."""
    d = _dealt(docs.select(id_col, F.col(text).alias("t")), id_col).select(id_col, F.split(F.lower("t"), "").alias("c"))

    def runs(n: int) -> Column:
        # characters are put together from an array, as a place in a string has to be counted to
        made = F.transform(F.sequence(F.lit(0), F.greatest(F.size("c") - n, F.lit(0))), lambda i: F.concat(*[F.get("c", i + k) for k in range(n)]))
        return F.when(F.size("c") >= n, made).otherwise(F.array().cast("array<string>"))

    return d.select(id_col, F.explode(F.concat(*[runs(n) for n in range(low, high + 1)])).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def two_families(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(family, id, term, tf) of word grams and of character runs."""
    families = (("word", word_ngrams), ("char", char_ngrams))
    return reduce(DataFrame.unionByName, [make(docs, id_col, text).select(F.lit(name).alias("family"), id_col, "term", "tf") for name, make in families])


def vocabulary(terms: DataFrame, min_df: int = 2, size: int = FAMILY_TERMS) -> DataFrame:
    """(family, term, df, total): of each family, the most frequent terms of min_df documents or more, ``size`` at most."""
    v = terms.groupBy("family", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    return reduce(DataFrame.unionByName, [v.filter(F.col("family") == f).orderBy(F.desc("total"), "term").limit(size) for f in FAMILIES])


def tf_sublinear(tf: Column) -> Column:
    return 1 + F.log(tf)


def idf_smooth(df: Column, n: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def tfidf(terms: DataFrame, vocab: DataFrame, n_docs: int, id_col: str) -> DataFrame:
    """(family, id, term, w): a document's weights have length one in each family. The vocabulary is bounded by its size."""
    known = F.broadcast(vocab.select("family", "term", "df"))
    w = terms.join(known, ["family", "term"]).withColumn("w", tf_sublinear(F.col("tf")) * idf_smooth(F.col("df"), F.lit(n_docs)))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col, "family")))
    return w.select("family", id_col, "term", (F.col("w") / norm).alias("w"))


def logreg_score(docs: DataFrame, weights: DataFrame, coefficients: DataFrame, intercept: float, id_col: str, text: str) -> DataFrame:
    """(id, prob): null for blank texts; texts without a known term keep the intercept."""
    z = weights.join(F.broadcast(coefficients), ["family", "term"]).groupBy(id_col).agg(F.sum(F.col("w") * F.col("coef")).alias("z"))
    p = sigmoid(F.coalesce("z", F.lit(0.0)) + intercept)
    return docs.select(id_col, text).join(z, id_col, "left").select(id_col, F.when(F.trim(text) != "", p).alias("prob"))


def model_table(spark: SparkSession, vocab: pd.DataFrame, model: dict, c: float) -> DataFrame:
    """(kind, family, term, idf, value): a fitted model as a table; ``vocab`` has the terms in the order of its coefficients.

    kind ``term`` has idf and coefficient of each term; ``intercept`` and
    ``best_c`` are one row each.
    """
    terms = pd.DataFrame({"kind": "term", "family": vocab["family"], "term": vocab["term"], "idf": vocab["idf"], "value": model["coefficients"]})
    schema = "kind string, family string, term string, idf double, value double"
    scalars = [("intercept", None, None, None, model["intercept"]), ("best_c", None, None, None, float(c))]
    return spark.createDataFrame(terms, schema).unionByName(spark.createDataFrame(scalars, schema))


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, float, float | None] | None:
    """(terms, intercept, best C or None) of a written model; None if there is none that can be read.

    A table without kinds is taken as coefficients alone, with intercept 0.
    """
    try:
        t = spark.read.parquet(path)
        if "kind" not in t.columns:
            return t.select("family", "term", F.lit(None).cast("double").alias("idf"), F.col("coef").alias("coef")), 0.0, None
        scalars = {r["kind"]: r["value"] for r in t.filter("kind <> 'term'").select("kind", "value").collect()}  # two rows
        return t.filter("kind = 'term'").select("family", "term", "idf", F.col("value").alias("coef")), scalars["intercept"], scalars.get("best_c")
    except (AnalysisException, KeyError, Py4JJavaError) as e:
        LOG.warning("no model at %s: %s", path, e)
        return None


def token_windows(tokens: Column, s: Settings = Settings()) -> Column:
    """Overlapping windows if a text is longer than the model takes, else the text itself."""
    n, size, step = F.size(tokens), s.window_tokens, s.window_stride
    count = 1 + F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(tokens, i * step + 1, size))
    return F.when(n + 2 > s.max_tokens, windows).otherwise(F.array(tokens))


def train_windows(tokens: Column, s: Settings = Settings()) -> Column:
    """The text cut to the model's length, and all windows that aren't too short."""
    n, size, step = F.size(tokens), s.window_tokens, s.window_stride
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step).cast("int"), F.lit(0)))
    windows = F.transform(starts, lambda i: F.slice(tokens, i * step + 1, size))
    return F.concat(F.array(F.slice(tokens, 1, s.max_tokens)), F.filter(windows, lambda w: F.size(w) >= s.min_window_tokens))
