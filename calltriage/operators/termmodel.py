"""TF-IDF features and logistic scores of texts in one pass, by a term dictionary that all tasks have.

The dictionary is bounded by the vocabulary's size. Its words are looked up in a
whole batch at once; word pairs and runs of characters are numbers in sorted
arrays, the runs as a tree in which each step adds a character. Terms are never
rows: nothing is exploded or shuffled, so batch tables and streams are scored
alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textmodel import word_tokens

#: Characters of texts that are looked up at a time; what is at hand in a worker takes some 200 bytes for each.
CHUNK = 1 << 18
#: The same where the terms themselves are handed on.
FEATURES_CHUNK = 1 << 18
#: Entries of a table of the steps from character to character: 4 bytes each; with larger ones, steps are looked up in sorted arrays.
TABLE = 1 << 23
_CHAR = 21  # bits of a character


def _find(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted array, or -1."""
    if not len(known):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


class Dictionary:
    """Terms of both families, numbered from 0, with their idf."""

    def __init__(self, families: list[str], terms: list[str], idf: np.ndarray):
        self.idf, self.family = np.asarray(idf, float), np.array([f == "char" for f in families], np.int8)
        words = [(i, t.split(" ")) for i, (f, t) in enumerate(zip(families, terms, strict=True)) if f == "word"]
        self.words = pa.array(sorted({w for _, ws in words for w in ws}), pa.string())
        number = {w: k for k, w in enumerate(self.words.to_pylist())}
        self.single = np.full(len(number) + 1, -1)  # the last place stands for words that aren't known
        pairs = []
        for i, ws in words:
            if len(ws) == 1:
                self.single[number[ws[0]]] = i
            else:
                pairs.append((number[ws[0]] * len(number) + number[ws[1]], i))
        self.pairs, self.pair_terms = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        # the tree: of each depth, the keys (node one step up, character) and the terms that end there
        runs = [(i, t) for i, (f, t) in enumerate(zip(families, terms, strict=True)) if f == "char"]
        self.low = min((len(t) for _, t in runs), default=1)
        if self.low > 3:
            raise ValueError("runs of more than three characters need shorter ones beside them")
        self.runs, self._steps = runs, None
        self.tree = []
        nodes: dict[str, int] = {}
        for n in range(self.low, max((len(t) for _, t in runs), default=0) + 1):
            keys = {}
            for _, t in runs:
                if len(t) >= n:
                    keys[t[:n]] = self._packed(t[:n]) if n == self.low else nodes[t[: n - 1]] << _CHAR | ord(t[n - 1])
            known = np.array(sorted(keys.values()), np.int64)
            nodes = {t: int(np.searchsorted(known, k)) for t, k in keys.items()}
            ends = np.full(len(known), -1)
            for i, t in runs:
                if len(t) == n:
                    ends[nodes[t]] = i
            self.tree.append((known, ends))

    @staticmethod
    def _packed(t: str) -> int:
        k = 0
        for c in t:
            k = k << _CHAR | ord(c)
        return k

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_steps": None}  # made again where it is used

    def _tables(self) -> tuple:
        """(codes of characters, their number, of each depth a table by node and code of the nodes one step down and their terms); no tables if they were too large.

        Code and node 0 stand for what isn't known.
        """
        if self._steps is None:
            known = sorted({c for _, t in self.runs for c in t})
            size = len(known) + 1
            codes = np.zeros(max(map(ord, known), default=0) + 2, np.int32)
            codes[[ord(c) for c in known]] = np.arange(1, size)
            levels, nodes = [], {"": 1}
            for n in range(1, max((len(t) for _, t in self.runs), default=0) + 1):
                nxt = {p: k for k, p in enumerate(sorted({t[:n] for _, t in self.runs if len(t) >= n}), 1)}
                if (len(nodes) + 1) * size > TABLE:
                    levels = []
                    break
                table, ends = np.zeros((len(nodes) + 1) * size, np.int32), np.full(len(nxt) + 1, -1)
                table[[nodes[p[:-1]] * size + codes[ord(p[-1])] for p in nxt]] = list(nxt.values())
                for i, t in self.runs:
                    if len(t) == n:
                        ends[nxt[t]] = i
                levels.append((table, ends))
                nodes = nxt
            self._steps = codes, size, levels
        return self._steps

    def __len__(self) -> int:
        return len(self.idf)

    def _words(self, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) of each known word and word pair."""
        row, flat = np.asarray(pc.list_parent_indices(tokens)), pc.list_flatten(tokens)
        at = np.asarray(pc.fill_null(pc.index_in(flat, value_set=self.words), -1)).astype(np.int64)
        both = (row[1:] == row[:-1]) & (at[1:] >= 0) & (at[:-1] >= 0)
        pair = _find(self.pairs, at[:-1][both] * len(self.words) + at[1:][both])
        pair_terms = self.pair_terms[pair[pair >= 0]]
        term = np.concatenate([self.single[at], pair_terms])
        row = np.concatenate([row, row[:-1][both][pair >= 0]])
        return row[term >= 0], term[term >= 0]

    def _runs(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) of each known run of characters."""
        if not self.tree:  # a model of words alone
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = np.asarray(pc.fill_null(pc.utf8_length(texts), 0)).astype(np.int64)
        row, rest = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size), size) - np.arange(size.sum())
        c = np.frombuffer("".join(t or "" for t in texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        rows, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at, node = np.flatnonzero(rest >= self.low), None
        codes, size, levels = self._tables()
        if levels:
            c, node = codes[np.minimum(c, len(codes) - 1)], np.ones(len(at), np.int32)
            for n, (table, ends) in enumerate(levels, 1):
                if n > self.low:
                    longer = rest[at] >= n
                    at, node = at[longer], node[longer]
                node = table[node * size + c[at + n - 1]]
                at, node = at[node > 0], node[node > 0]
                if n >= self.low:
                    term = ends[node]
                    rows.append(row[at[term >= 0]])
                    terms.append(term[term >= 0])
            return np.concatenate(rows), np.concatenate(terms)
        for depth, (known, ends) in enumerate(self.tree):
            n = self.low + depth
            if node is None:
                key = np.zeros(len(at), np.int64)
                for i in range(n):
                    key = key << _CHAR | c[at + i]
            else:
                longer = rest[at] >= n
                at, node = at[longer], node[longer]
                key = node << _CHAR | c[at + n - 1]
            node = _find(known, key)
            at, node = at[node >= 0], node[node >= 0]
            term = ends[node]
            rows.append(row[at[term >= 0]])
            terms.append(term[term >= 0])
        return np.concatenate(rows), np.concatenate(terms)

    def weigh(self, texts: pa.StringArray, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight) in this order; the weights of a family in a text have length one."""
        parts = [self._words(tokens), self._runs(texts)]
        row, term = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(2))
        key, tf = np.unique(row * max(1, len(self)) + term, return_counts=True)
        row, term = np.divmod(key, max(1, len(self)))
        w = (1 + np.log(tf)) * self.idf[term]
        group = 2 * row + self.family[term]
        length = np.sqrt(np.bincount(group, w * w, 2 * len(texts)))
        return row, term, w / length[group]


def _slices(texts: pa.StringArray, chars: int = CHUNK):
    """(first, rows) of consecutive texts of about so many characters."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(texts), 0)).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars)))
        yield at, end - at
        at = end


def _flat(tokens: pa.Array) -> pa.ListArray:
    """A list array without nulls, whatever slice of a larger one it is."""
    return pa.array(tokens.to_pylist(), tokens.type) if tokens.null_count else tokens


class TermModel:
    """A dictionary with a logistic model's coefficients."""

    def __init__(self, dictionary: Dictionary, coefficients: np.ndarray, intercept: float):
        self.dictionary, self.coefficients, self.intercept = dictionary, np.asarray(coefficients, float), float(intercept)

    @classmethod
    def of(cls, terms: DataFrame, intercept: float) -> TermModel:
        """From a table (family, term, idf, coef), as ``textmodel.load_model`` gives it; the vocabulary's size bounds it."""
        t = terms.select("family", "term", "idf", "coef").toPandas().sort_values(["family", "term"], kind="stable")
        return cls(Dictionary(t["family"].tolist(), t["term"].tolist(), t["idf"].to_numpy()), t["coef"].to_numpy(), intercept)

    def score(self, texts: pa.StringArray, tokens: pa.ListArray) -> np.ndarray:
        row, term, w = self.dictionary.weigh(texts, tokens)
        z = np.bincount(row, w * self.coefficients[term], len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

    def column(self, spark: SparkSession, text: Column) -> Column:
        """The probability of a text, for tables and streams; texts without a known term keep the intercept."""
        sent = spark.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def run(texts: pa.Array, tokens: pa.Array) -> pa.Array:
            p = [sent.value.score(texts.slice(at, n), _flat(tokens.slice(at, n))) for at, n in _slices(texts)]
            return pa.array(np.concatenate(p) if p else np.zeros(0), pa.float64())

        low = F.lower(F.coalesce(text, F.lit("")))
        return run(low, word_tokens(low))


def features(docs: DataFrame, dictionary: Dictionary, id_col: str, text: str, *kept: str) -> DataFrame:
    """(id, kept columns, i, w): of each text the numbers of its terms and their weights, as two arrays; made where the text is."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionary)
    own = [id_col, *kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, tokens = batch.column("__low"), batch.column("__tokens")
            # handed on slice by slice, as terms take many times as much as their texts
            for at, n in _slices(texts, FEATURES_CHUNK):
                row, term, w = sent.value.weigh(texts.slice(at, n), _flat(tokens.slice(at, n)))
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(w))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(at, n) for c in own], *lists], [*own, "i", "w"])

    fields = T.StructType([*docs.select(*own).schema.fields, T.StructField("i", T.ArrayType(T.IntegerType())), T.StructField("w", T.ArrayType(T.DoubleType()))])
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return docs.select(*own, low.alias("__low")).withColumn("__tokens", word_tokens(F.col("__low"))).mapInArrow(run, fields)


def dictionary(vocab: DataFrame, n_docs: int) -> tuple[Dictionary, pd.DataFrame]:
    """(the vocabulary with idf as a dictionary, its table in the dictionary's order): words first, by falling frequency."""
    v = vocab.toPandas().sort_values(["family", "total", "term"], ascending=[False, False, True], kind="stable").reset_index(drop=True)
    v["idf"] = np.log((1 + n_docs) / (1 + v["df"].to_numpy(float))) + 1
    return Dictionary(v["family"].tolist(), v["term"].tolist(), v["idf"].to_numpy()), v
