"""Toxicity: ordinal severity from the words of a text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordinal

_STRIP = b".,;:!?\"'()[]*#$%&|<>-"


def _names(word: bytes) -> list[bytes]:
    """The word in lower case (A-Z), without marks at its ends, and its beginnings."""
    word = word.lower().strip(_STRIP)
    return [word, *(b"%b~" % word[:n] for n in range(4, 10) if n <= len(word))]


def features(texts: list[str | None], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which words, and beginnings of words (4 to 9 bytes), a text holds."""
    return ordinal.of_words(texts, _names, keep)


def severity(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 harmless, 1 toxic, 2 toxic in a text of low quality."""
    grade = F.when(F.col("toxic") == 0, 0).when((F.col("toxic") == 1) & (F.col("quality") == 0), 2).when(F.col("toxic") == 1, 1)
    return labels.select("doc_id", grade.alias("grade"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = ordinal.SAMPLE) -> DataFrame:
    """Per row: doc_id, expected_severity, p_toxic = P(severity >= 1) and the verdict.

    Null and empty texts have no features and get the base rate. Without any
    usable label the severity is undecided (thresholds at one half).
    """
    model = ordinal.train(docs, severity(labels), features, sample)
    p = F.get("tails", F.lit(0))
    return ordinal.score(docs, model, features).select("doc_id", F.col("expected").alias("expected_severity"), p.alias("p_toxic"), (p >= threshold).alias("toxic"))
