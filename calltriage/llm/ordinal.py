"""Cumulative-link ordinal regression on hashed text features.

P(grade >= k) = sigmoid(w.x - t_k): the weights are shared by all thresholds
t_1 < t_2 < ..., so one score orders the grades. Features are found and scored
in Spark tasks; the fit uses a bounded sample of labelled rows (SAMPLE), as
sparse rows, on the driver. Features that don't tell the grades apart on the
sample are left out, so long texts gather no noise.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Labelled rows that a model is fitted on, at most: the first by the hash of their id.
SAMPLE = 20_000
BUCKETS = 1 << 18
#: Standard errors by which a feature's share has to differ between grades.
MIN_Z = 5.0
#: Share of the rows of a grade (and those above, or below) that a feature has to reach.
MIN_SHARE = 0.02
PENALTY = 3e-5
STEPS = 600
CHUNK = 2 << 20
#: Numbers of words with the same feature that count as features of their own.
COUNTS = (2, 4, 8)

#: (texts, which buckets matter or None for all) -> (text number, feature) pairs, without repeats.
Features = Callable[[list[str | None], np.ndarray | None], tuple[np.ndarray, np.ndarray]]


def hashed(names: list[bytes]) -> np.ndarray:
    """The bucket of each feature name."""
    return np.fromiter((zlib.crc32(x) for x in names), np.int64, len(names)) % BUCKETS


def of_words(texts: list[str | None], names: Callable[[bytes], list[bytes]], keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts and the features that ``names`` gives to their words.

    A feature of two, four or eight words of a text also counts as one of its
    own for that number.
    """
    words, owner, token = word_ids(texts)
    each = [names(w) for w in words]
    word = np.repeat(np.arange(len(words)), [len(x) for x in each])
    bucket = hashed([x for xs in each for x in xs])
    if keep is not None:
        wanted = keep[bucket] | np.any([keep[often(bucket, c)] for c in COUNTS], axis=0)
        word, bucket = word[wanted], bucket[wanted]
    first = np.searchsorted(word, np.arange(len(words) + 1))
    n = np.diff(first)[token]
    owner, token, n = owner[n > 0], token[n > 0], n[n > 0]
    at = np.repeat(first[token] - np.cumsum(n) + n, n) + np.arange(n.sum())
    pair, count = np.unique(np.repeat(owner, n) * BUCKETS + bucket[at], return_counts=True)
    who, what = pair // BUCKETS, pair % BUCKETS
    owners, features = [who], [what]
    for c in COUNTS:
        owners.append(who[count >= c])
        features.append(often(what[count >= c], c))
    owner, feature = np.concatenate(owners), np.concatenate(features)
    use = slice(None) if keep is None else keep[feature]
    return distinct_pairs(owner[use], feature[use])


def often(bucket: np.ndarray, count: int) -> np.ndarray:
    """The bucket of "this feature, ``count`` times or more"."""
    return (bucket * 40_503 + count * 7_919 + 1) % BUCKETS


def distinct_pairs(owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(owner * BUCKETS + feature)
    return pair // BUCKETS, pair % BUCKETS


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...; one row for each score."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -500, 500)))


def _select(df: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The features that tell grades apart; ``df[g]`` counts them in the ``rows[g]`` rows of grade g."""
    keep = np.zeros(BUCKETS, bool)
    for k in range(1, len(rows)):
        n1, n0 = rows[k:].sum(), rows[:k].sum()
        if not n1 or not n0:
            continue
        d1, d0 = df[k:].sum(axis=0), df[:k].sum(axis=0)
        p = (d1 + d0 + 1) / (n1 + n0 + 2)
        tells = np.abs(d1 / n1 - d0 / n0) >= MIN_Z * np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        keep |= tells & (np.maximum(d1 / n1, d0 / n0) >= MIN_SHARE)
    return keep


def fit(owner: np.ndarray, feature: np.ndarray, grade: np.ndarray) -> Model:
    """Fits by Adam on all rows at once; grades are 0, 1, ..."""
    top = max(1, int(grade.max(initial=0)))
    df = np.bincount(grade[owner] * BUCKETS + feature, minlength=(top + 1) * BUCKETS).reshape(-1, BUCKETS)
    chosen = np.flatnonzero(_select(df, np.bincount(grade, minlength=top + 1)))
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))
    use = column[feature] >= 0
    row, col, n = owner[use], column[feature[use]], max(1, len(grade))
    counts = np.bincount(grade, minlength=top + 1) + 0.5
    tail = np.clip(counts[::-1].cumsum()[::-1][1:] / counts.sum(), 1e-6, 1 - 1e-6)
    start = -np.log(tail / (1 - tail))
    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    x = np.concatenate((np.zeros(len(chosen)), start[:1], gaps))
    m, v = np.zeros_like(x), np.zeros_like(x)
    sig = lambda a: 1 / (1 + np.exp(-np.clip(a, -500, 500)))
    for step in range(1, STEPS + 1):
        w, t0, gap = x[: len(chosen)], x[len(chosen)], np.exp(x[len(chosen) + 1 :])
        t = np.concatenate(([-np.inf], [t0], t0 + np.cumsum(gap), [np.inf]))
        z = np.bincount(row, weights=w[col], minlength=len(grade))[: len(grade)]
        hi, lo = sig(t[grade + 1] - z), sig(t[grade] - z)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_z = (d_hi - d_lo) / n
        g_t = (np.bincount(grade, weights=d_lo, minlength=top + 1)[1 : top + 1] - np.bincount(grade + 1, weights=d_hi, minlength=top + 2)[1 : top + 1]) / n
        g_gap = g_t[::-1].cumsum()[::-1][1:] * gap
        g = np.concatenate((np.bincount(col, weights=g_z[row], minlength=len(chosen))[: len(chosen)] + PENALTY * w, [g_t.sum()], g_gap))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    weights = np.zeros(BUCKETS, np.float32)
    weights[chosen] = x[: len(chosen)]
    return Model(weights, x[len(chosen)] + np.concatenate(([0], np.cumsum(np.exp(x[len(chosen) + 1 :])))))


def train(docs: DataFrame, graded: DataFrame, features: Features, sample: int = SAMPLE) -> Model:
    """Fits on the texts of up to ``sample`` rows of ``graded`` (doc_id, grade).

    Rows without an id or a grade are left out, and so are ids without a
    document. Of rows with the same id, the highest grade counts.
    """
    clean = graded.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    chosen = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # SAMPLE rows at most
    texts = texts.select(F.col("doc_id").cast("long"), F.col("grade").cast("int"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch, "text", CHUNK):
                grade = part.column("grade").to_numpy().astype(np.int64)
                owner, feature = features(part.column("text").to_pylist(), None)
                pair, n = np.unique(grade[owner] * BUCKETS + feature, return_counts=True)
                rows, m = np.unique(grade, return_counts=True)
                cells = np.concatenate((pair // BUCKETS, rows)), np.concatenate((pair % BUCKETS, np.full(len(rows), -1))), np.concatenate((n, m))
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cells, (np.int32, np.int32, np.int64), strict=True)], ["grade", "feature", "n"])

    # counts of features by grade (BUCKETS for each grade at most) choose what is sent to the fit
    cells = texts.mapInArrow(count, "grade int, feature int, n long").groupBy("grade", "feature").agg(F.sum("n").alias("n")).toArrow()
    g, f, n = (cells.column(c).to_numpy() for c in ("grade", "feature", "n"))
    df, total = np.zeros((max(2, int(g.max(initial=0)) + 1), BUCKETS), np.int64), np.zeros(max(2, int(g.max(initial=0)) + 1), np.int64)
    df[g[f >= 0], f[f >= 0]], total[g[f < 0]] = n[f >= 0], n[f < 0]
    keep = _select(df, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch, "text", CHUNK):
                owner, feature = features(part.column("text").to_pylist(), keep)
                ends = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), lists], ["doc_id", "grade", "features"])

    got = texts.mapInArrow(run, "doc_id long, grade int, features array<int>").toArrow().sort_by("doc_id").combine_chunks()
    lists = got.column("features").combine_chunks()
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())) if len(lists) else np.zeros(0, np.int64)
    return fit(owner, lists.values.to_numpy().astype(np.int64) if len(lists) else np.zeros(0, np.int64), got.column("grade").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: Model, features: Features) -> DataFrame:
    """Per row: doc_id, expected grade and the tail probabilities."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        keep = m.weights != 0
        for batch in batches:
            for _, part in slices(batch, "text", CHUNK):
                owner, feature = features(part.column("text").to_pylist(), keep)
                tails = m.tails(np.bincount(owner, weights=m.weights[feature], minlength=part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))], ["doc_id", "expected", "tails"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, expected double, tails array<double>")


def word_ids(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, text number of each word, its place among the distinct ones)."""
    docs = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    flat = [w for d in docs for w in d]
    ids = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    return list(ids), np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat))
