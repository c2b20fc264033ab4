"""Ranked lexical search with hashed max-sketches.

Queries become blocks of bounded size. One pass over the documents counts what
a block's term weights need. A second pass folds every document's impacts, the
weighted scores of its terms, into a sketch: terms are hashed to slots and a
slot keeps the largest impact. A query's slots, looked up for a batch of
documents at once, add up to a bound that no document's score exceeds. Each
task rescores exactly, by descending bound, until its k-th score is above the
next bound; the tasks' best k are ranked together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_table
from .token_counts import byte_slices

K = 20
#: Slots of a document's sketch.
SLOTS = 1024
#: Bytes of query texts that go to the tasks at a time, and of document texts that are scored at a time.
BLOCK_BYTES, SLICE_BYTES = 8 << 20, 4 << 20
#: Queries whose bounds are looked up at a time, and documents of a query that are rescored first.
TILE, FIRST = 512, 32

# every byte that separates terms becomes a space; A-Z become a-z; what isn't ASCII stays
_BYTES = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


class Block:
    """The queries of a block: their terms as numbers, and how often each holds which."""

    def __init__(self, queries: list[tuple[int, str | None]], slots: int = SLOTS):
        self.ids, self.slots, number = [], slots, {}
        self.at, self.times = [], []
        for qid, text in queries:
            ts = [number.setdefault(t, len(number)) for t in terms(text)]
            if ts:
                at, times = np.unique(ts, return_counts=True)
                self.ids.append(qid)
                self.at.append(at)
                self.times.append(times)
        self.number = number
        # a multiplicative hash, so that which terms share a slot doesn't follow their order
        self.slot = (np.arange(len(number), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % slots

    def tile(self, first: int) -> np.ndarray:
        """A row for each of TILE queries: the sum of the times of its terms in each slot."""
        out = np.zeros((min(TILE, len(self.ids) - first), self.slots))
        for i in range(len(out)):
            np.add.at(out[i], self.slot[self.at[first + i]], self.times[first + i])
        return out

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each text, and for each text and term of the block in it: text, term, times), in order."""
        words = [terms(t) for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        found = np.fromiter(map(self.number.get, (t for w in words for t in w), repeat(-1)), np.int64, int(n.sum()))
        text = np.repeat(np.arange(len(texts)), n)[found >= 0]
        key, times = np.unique(text * max(1, len(self.number)) + found[found >= 0], return_counts=True)
        return n, *np.divmod(key, max(1, len(self.number))), times


def _statistics(docs: DataFrame, block) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, documents with each of the block's terms)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        df, total = np.zeros(len(b.number), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                n, _, term, _ = b.read(part.column("text").to_pylist())
                total += [int((n > 0).sum()), int(n.sum())]
                df += np.bincount(term, minlength=len(df))
        keys = np.concatenate([[-2, -1], np.flatnonzero(df)])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate([total, df[df > 0]]), pa.int64())], ["key", "n"])

    # a row for each term of the block, and two
    found = {r["key"]: r["n"] for r in docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(i, 0) for i in range(len(block.value.number))], np.int64)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


class Scorer:
    """The best k documents of each query among those that one task has seen."""

    def __init__(self, block: Block, w: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.block, self.w, self.n_docs, self.n_terms, self.k = block, w, n_docs, n_terms, k
        self.best: list[list[tuple]] = [[] for _ in block.ids]  # (-score, whether the id is null, id), best first
        self.least = np.ones(len(block.ids), np.int64)  # scores from here on can be among the best
        self.tiles = [(i, block.tile(i)) for i in range(0, len(block.ids), TILE)]

    def add(self, ids: list, texts: list[str | None]) -> None:
        n, text, term, times = self.block.read(texts)
        if not len(text):
            return
        m = np.array([75 + 25 * x * self.n_docs // self.n_terms for x in n.tolist()], np.int64)
        impact = self.w[term] * (1_000_000_000 * times // (1000 * times + 12 * m[text]))
        sketch = np.zeros((self.block.slots, len(texts)))
        np.maximum.at(sketch, (self.block.slot[term], text), impact)
        key = text * len(self.w) + term
        for first, tile in self.tiles:
            # sums below 2^53 are exact; the factor is above what larger ones lose
            bounds = tile @ sketch * (1 + 1e-9)
            hopeful = bounds >= self.least[first : first + len(tile), None]
            for i in np.flatnonzero(hopeful.any(axis=1)).tolist():
                docs = np.flatnonzero(hopeful[i])
                self._rescore(first + i, docs, bounds[i, docs], ids, key, impact)

    def _rescore(self, q: int, docs: np.ndarray, bound: np.ndarray, ids: list, key: np.ndarray, impact: np.ndarray) -> None:
        """Exact scores by descending bound, until no bound reaches the k-th best."""
        order = np.argsort(-bound, kind="stable")
        docs, bound, at, size = docs[order], bound[order], 0, FIRST
        while at < len(docs) and bound[at] >= self.least[q]:
            some = docs[at : at + size]
            wanted = some[:, None] * len(self.w) + self.block.at[q]
            place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            score = (np.where(key[place] == wanted, impact[place], 0) * self.block.times[q]).sum(axis=1)
            good = np.flatnonzero(score >= self.least[q])
            best = self.best[q] + [(-s, ids[d] is None, ids[d]) for s, d in zip(score[good].tolist(), some[good].tolist(), strict=True)]
            best.sort(key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))
            self.best[q] = best = best[: self.k]
            if len(best) == self.k:
                self.least[q] = -best[-1][0]
            at, size = at + size, 2 * size


def _rank(docs: DataFrame, block, w: np.ndarray, n_docs: int, n_terms: int, k: int, id_type) -> DataFrame:
    """(qid, id, score): the best k of each task, and of these the best k with their rank."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = None
        for batch in batches:
            s = s or Scorer(block.value, w, n_docs, n_terms, k)
            for part in byte_slices(batch, "text", SLICE_BYTES):
                s.add(part.column("id").to_pylist(), part.column("text").to_pylist())
            kind = batch.schema.field("id").type
        if s:
            rows = [(q, x[2], -x[0]) for q, best in zip(s.block.ids, s.best, strict=True) for x in best]
            for at in range(0, len(rows), 100_000):
                q, i, n = zip(*rows[at : at + 100_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, kind), pa.array(n, pa.int64())], ["qid", "id", "score"])

    found = docs.mapInArrow(score, f"qid long, id {id_type}, score long")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per query: its ``k`` best documents with a score above 0, as (item, rank, doc, score); equal scores by ascending id, a null id last.

    All documents are ranked for all queries. Null or empty texts have no terms:
    such documents aren't counted and such queries find nothing. Every row is a
    document or query of its own, also if it repeats another or its id, so
    queries that share an id have their ranks each. Empty tables give no rows.
    Further columns, whatever their names, don't matter. The documents are read
    twice for each BLOCK_BYTES of query texts.
    """
    spark = docs.sparkSession
    items = scratch_table(queries.select(F.monotonically_increasing_id().alias("qid"), F.col(item_col).alias("item"), F.col(item_text).alias("text")), "search-queries")
    total = items.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = d.schema["id"].dataType.simpleString()
    out = None
    for i in range(blocks):
        # about BLOCK_BYTES
        rows = items.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).select("qid", "text").collect()
        block = spark.sparkContext.broadcast(Block([(r["qid"], r["text"]) for r in rows]))
        n_docs, n_terms, df = _statistics(d, block)
        found = _rank(d, block, weights(n_docs, df), n_docs, max(1, n_terms), k, id_type)
        out = found if out is None else out.unionByName(found)
    return out.join(items.select("qid", "item"), "qid").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
