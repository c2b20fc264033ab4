"""Quality classifier: expected rating and selection by a tail probability."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordinal

_SHAPES = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"9"))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)


def _shape(word: bytes) -> bytes:
    """Kinds of characters in order, runs cut to one: ``Word***`` is ``Aa*``."""
    for rx, by in _SHAPES:
        word = rx.sub(by, word)
    return _RUN.sub(rb"\1", word)[:12]


def features(texts: list[str | None], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A text's words, and how large a share of them has each shape, in steps of two.

    Also its number of words and its share of distinct ones, in such steps.
    """
    words, owner, token = ordinal.word_ids(texts)
    if not len(token):
        return owner.astype(np.int64), token
    n = np.bincount(owner, minlength=len(texts))
    plain = ordinal.hashed([b"w" + w.lower() for w in words])[token]
    shapes = [_shape(w) for w in words]
    kinds = {s: i for i, s in enumerate(dict.fromkeys(shapes))}
    kind = np.fromiter((kinds[s] for s in shapes), np.int64, len(shapes))[token]
    pair, count = np.unique(owner * len(kinds) + kind, return_counts=True)
    who, what = pair // len(kinds), pair % len(kinds)
    step = np.floor(-np.log2(count / n[who])).astype(int)
    names = list(kinds)
    share = ordinal.hashed([b"s%d%b" % (min(s, 8), names[k]) for s, k in zip(step, what, strict=True)])
    there = np.flatnonzero(n)
    distinct = np.bincount(np.unique(owner * len(words) + token) // len(words), minlength=len(texts))
    sizes = ordinal.hashed([b"n%d" % np.log2(x) for x in n[there]])
    fresh = ordinal.hashed([b"d%d" % (8 * d / x) for d, x in zip(distinct[there], n[there], strict=True)])
    owner, feature = np.concatenate((owner, who, there, there)), np.concatenate((plain, share, sizes, fresh))
    use = slice(None) if keep is None else keep[feature]
    return ordinal.distinct_pairs(owner[use], feature[use])


def rating(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 low quality, 1 fluent but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = ordinal.SAMPLE) -> DataFrame:
    """Per row: doc_id, expected_grade, p_fluent = P(grade >= 1), p_good = P(grade >= 2), kept.

    ``kept`` if p_fluent reaches the threshold. Null and empty texts have no
    features and get the base rate.
    """
    model = ordinal.train(docs, rating(labels), features, sample)
    p = F.get("tails", F.lit(0))
    return ordinal.score(docs, model, features).select("doc_id", F.col("expected").alias("expected_grade"), p.alias("p_fluent"), F.get("tails", F.lit(1)).alias("p_good"), (p >= threshold).alias("kept"))
