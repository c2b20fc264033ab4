"""The most frequent terms of a corpus by mergeable sketches and an exact recount of what survives them.

A first pass keeps, in each task and of each family, a bounded summary of
counts by a term's hash (Misra-Gries: when it is full, all counts go down by the
first one that has no place, and what they went down by is the summary's
loss). Summaries are added up. A hash's count and the sum of all losses enclose
the total of its terms, so that whatever stays below a threshold provably can't
be among the most frequent terms. A second pass counts the terms of the
remaining hashes, strings and all; only these are shuffled. Two terms with one
hash only make that hash's bound higher.

Where the bounds prove nothing (losses too high, too many survivors), all terms
are counted as rows; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from . import textmodel
from .termmodel import _find, _flat, _slices

#: Counts that a task keeps of each family: 16 bytes each.
SUMMARY = 1 << 20
#: Hashes that go to all tasks for the recount: 8 bytes each.
SURVIVORS = 1 << 22
RUNS = (3, 4, 5)
_CHAR = 21  # bits of a character
_ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: the odd number next to 2^64 over the golden ratio


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    return x ^ (x >> np.uint64(29))


def _words(tokens: pa.ListArray) -> tuple[tuple[np.ndarray, ...], list[str]]:
    """((hash, text, first, second) of all words and word pairs, the strings that first and second number; a word has no second)."""
    row, flat = np.asarray(pc.list_parent_indices(tokens)).astype(np.int64), pc.list_flatten(tokens)
    encoded = flat.dictionary_encode()
    names, at = encoded.dictionary.to_pylist(), np.asarray(encoded.indices).astype(np.int64)
    h = pd.util.hash_array(np.array(names, object), categorize=False)[at] if names else np.zeros(0, np.uint64)
    both = row[1:] == row[:-1]
    pair = _mixed(h[:-1][both] * _ODD + h[1:][both])
    found = np.concatenate([h, pair]), np.concatenate([row, row[:-1][both]]), np.concatenate([at, at[:-1][both]]), np.concatenate([np.full(len(at), -1), at[1:][both]])
    return found, names


def _runs(texts: pa.StringArray) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, text, first three characters, the others) of all runs of characters, as numbers; of each length apart, so that only one is at hand."""
    size = np.asarray(pc.fill_null(pc.utf8_length(texts), 0)).astype(np.int64)
    row, rest = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size), size) - np.arange(size.sum())
    c = np.frombuffer("".join(t or "" for t in texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    for n in RUNS:
        at = np.flatnonzero(rest >= n)
        first, others = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for i in range(3):
            first = first << _CHAR | c[at + i]
        for i in range(3, n):
            others = others << _CHAR | c[at + i] + 1
        yield _mixed(_mixed(first.astype(np.uint64) + _ODD) + others.astype(np.uint64)), row[at], first, others


def _run(first: int, others: int) -> str:
    mask = (1 << _CHAR) - 1
    tail = [others >> _CHAR, others & mask] if others >> _CHAR else [others] if others else []
    return "".join(map(chr, (first >> 2 * _CHAR, first >> _CHAR & mask, first & mask, *(x - 1 for x in tail))))


def _terms(batch: pa.RecordBatch):
    """(family, (hash, text, key, key), how a key is written) of the batch's texts, a slice at a time."""
    texts, tokens = batch.column("text"), batch.column("tokens")
    for at, n in _slices(texts):
        found, names = _words(_flat(tokens.slice(at, n)))
        yield "word", found, lambda a, b, names=names: names[a] if b < 0 else f"{names[a]} {names[b]}"
        for found in _runs(texts.slice(at, n)):
            yield "char", found, _run


class Summary:
    """Counts by hash, ``size`` at most. A hash's true count is its count here (or 0) at least, and ``lost`` more at most."""

    def __init__(self, size: int):
        self.size, self.lost = size, 0
        self.h, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, hashes: np.ndarray) -> None:
        h, n = np.unique(hashes, return_counts=True)
        at = np.searchsorted(self.h, h)
        known = np.zeros(len(h), bool)
        inside = at < len(self.h)
        known[inside] = self.h[at[inside]] == h[inside]
        self.n[at[known]] += n[known]
        # new ones go where they belong: nothing as long as the summary is sorted
        self.h, self.n = np.insert(self.h, at[~known], h[~known]), np.insert(self.n, at[~known], n[~known])
        if len(self.h) > self.size:
            cut = int(np.partition(self.n, len(self.n) - self.size - 1)[len(self.n) - self.size - 1])
            self.lost += cut
            self.h, self.n = self.h[self.n > cut], self.n[self.n > cut] - cut


def _input(docs: DataFrame, text: str) -> DataFrame:
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return docs.select(low.alias("text")).withColumn("tokens", textmodel.word_tokens(F.col("text")))


def summaries(docs: DataFrame, text: str, size: int = SUMMARY) -> DataFrame:
    """(family, h, n): of each family, counts by hash of all tasks' summaries; ``h`` null has the sum of what they lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {f: Summary(size) for f in textmodel.FAMILIES}
        for batch in batches:
            for family, found, _ in _terms(batch):
                kept[family].add(found[0])
        for family, s in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([family]), pa.array([None], pa.int64()), pa.array([s.lost], pa.int64())], ["family", "h", "n"])
            for at in range(0, len(s.h), 1 << 16):
                h, n = (pa.array(x[at : at + (1 << 16)]) for x in (s.h.view(np.int64), s.n))
                yield pa.RecordBatch.from_arrays([pa.array([family] * len(h)), h, n], ["family", "h", "n"])

    return _input(docs, text).mapInArrow(run, "family string, h long, n long").groupBy("family", "h").agg(F.sum("n").alias("n"))


def recount(docs: DataFrame, text: str, hashes: dict[str, np.ndarray]) -> DataFrame:
    """(family, term, df, total) of all terms with one of the hashes (sorted, of each family)."""
    sent = docs.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for family, (h, row, a, b), written in _terms(batch):
                known = _find(sent.value[family], h) >= 0
                row, a, b = row[known], a[known], b[known]
                order = np.lexsort((row, b, a))
                row, a, b = row[order], a[order], b[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                starts = np.flatnonzero(new)
                other = new.copy()
                other[1:] |= row[1:] != row[:-1]
                total = np.diff(np.append(starts, len(a)))
                df = np.add.reduceat(other.astype(np.int64), starts) if len(starts) else total
                names = [written(int(x), int(y)) for x, y in zip(a[starts], b[starts], strict=True)]
                columns = [pa.array([family] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(df, pa.int64()), pa.array(total, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["family", "term", "df", "total"])

    found = _input(docs, text).mapInArrow(run, "family string, term string, df long, total long")
    return found.groupBy("family", "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _first(rows: DataFrame, family: str, size: int) -> DataFrame:
    return rows.filter(F.col("family") == family).orderBy(F.desc("total"), "term").limit(size)


def vocabulary(docs: DataFrame, text: str, min_df: int = 2, size: int = textmodel.FAMILY_TERMS, summary: int = SUMMARY, survivors: int = SURVIVORS) -> DataFrame:
    """(family, term, df, total): of each family, the most frequent terms of ``min_df`` texts or more, ``size`` at most; equal totals by term.

    Each row of ``docs`` is a text; null has no terms, an empty table gives no
    rows. The documents are read twice, and once more for each time that
    too few survivors are in ``min_df`` texts.
    """
    spark = docs.sparkSession
    path = files.scratch_path(spark, "term-summaries")
    summaries(docs, text, summary).write.parquet(path)
    counts = spark.read.parquet(path)
    lost = {r["family"]: r["n"] for r in counts.filter("h is null").collect()}  # a row for each family
    done: dict[str, DataFrame] = {}
    rank = 2 * size
    while len(done) < len(textmodel.FAMILIES):
        floors, hashes = {}, {f: np.zeros(0, np.uint64) for f in textmodel.FAMILIES}
        for family in set(textmodel.FAMILIES) - set(done):
            own = counts.filter((F.col("family") == family) & F.col("h").isNotNull())
            ranked = own.orderBy(F.desc("n")).limit(rank).agg(F.count("*").alias("n"), F.min("n").alias("least")).first()
            # terms with this total or more are among the survivors, whatever was lost
            floor = ranked["least"] if ranked["n"] == rank else 0
            if floor <= lost.get(family, 0) and lost.get(family, 0):
                done[family] = _counted_as_rows(docs, text, family, min_df, size)
                continue
            some = own.filter(F.col("n") + lost.get(family, 0) >= max(floor, min_df)).select("h")
            if some.count() > survivors:
                done[family] = _counted_as_rows(docs, text, family, min_df, size)
                continue
            floors[family] = floor
            hashes[family] = np.sort(some.toPandas()["h"].to_numpy(np.int64).view(np.uint64))  # ``survivors`` at most
        if not floors:
            break
        out = files.scratch_path(spark, "term-counts")
        recount(docs, text, hashes).filter(F.col("df") >= min_df).write.parquet(out)
        found = spark.read.schema("family string, term string, df long, total long").parquet(out)
        for family, floor in floors.items():
            top = _first(found, family, size)
            r = top.agg(F.count("*").alias("n"), F.min("total").alias("least")).first()
            if floor <= min_df or (r["n"] == size and r["least"] >= floor):
                done[family] = top
        rank *= 4
    files.drop(spark, path)
    return reduce(DataFrame.unionByName, [done[f] for f in textmodel.FAMILIES])


def _counted_as_rows(docs: DataFrame, text: str, family: str, min_df: int, size: int) -> DataFrame:
    """The same with a row for each term of each text."""
    made = {"word": textmodel.word_ngrams, "char": textmodel.char_ngrams}[family]
    rows = made(docs.select(F.monotonically_increasing_id().alias("id"), F.col(text).alias("text")), "id", "text")
    v = rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    return _first(v.select(F.lit(family).alias("family"), "term", "df", "total"), family, size)
