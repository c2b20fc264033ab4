"""Substring dedup by hashing lines and paragraphs that begin at content-defined cuts.

A line is cut after word pairs whose hash says so (one in CUT) or that were just
said before, so that a passage is cut alike wherever it stands. A unit is a whole line, or the
paragraph of MIN_WORDS words from any cut on, or before a text's end. The units'
words are normalised (A-Z in lower case, white space dropped) and hashed.
Digests are grouped over all documents: a unit stays in the document with the
smallest id that holds it, at its first place there, and is repeated everywhere
else. What repeated units cover is removed; it is reported with offsets into
the original text. As every unit is hashed whole, nothing is removed that does
not stand in one earlier place as it is; of a passage, the few words before its
first cut stay, and as many at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, renamed, scratch_table, slices
from .near_dedup import _BASE, _BYTE_VALUES, _INVERSE, _mix

CUT = 4
MIN_WORDS = 25
CHUNK = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def units(texts: list[str | None], min_words: int = MIN_WORDS, line_words: int = 1) -> tuple[np.ndarray, ...]:
    """(text number, digest, start, end, first word, word after the last) of all units; start and end are code points."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    buf = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[buf]
    begins = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if not len(begins):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    stops = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    power = np.cumprod(np.full(len(buf), _BASE), dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[buf] * power, dtype=np.uint64)))
    back = np.cumprod(np.full(len(buf), _INVERSE), dtype=np.uint64)
    word = _mix((total[stops] - total[begins]) * back[begins])
    line = np.ones(len(word), bool)
    lines = np.cumsum(buf == 10)
    line[1:] = lines[begins[1:]] != lines[stops[:-1] - 1]
    cut = line.copy()
    pair = _mix(word[1:-1] ^ (word[:-2] >> np.uint64(1)))
    cut[2:] |= pair % np.uint64(CUT) == 0
    for p in range(1, 5):  # words said over and over may have no such pair
        cut[2 + p :] |= pair[p:] == pair[:-p]
    doc_begin = np.cumsum([1] + [len(r) + 1 for r in raw[:-1]])
    first_word = np.searchsorted(begins, doc_begin)

    def spans(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.flatnonzero(marks)
        return np.searchsorted(doc_begin, begins[a], side="right") - 1, a, np.concatenate((a[1:], [len(word)]))

    # the paragraph of min_words words from each cut on, and the one that ends with the text
    doc, a, _ = spans(cut)
    stop = np.append(first_word[1:], len(word))
    doc, a = np.concatenate((doc, np.arange(len(raw)))), np.concatenate((a, stop - min_words))
    fits = (a >= first_word[doc]) & (a + min_words <= stop[doc])
    doc, a, b = doc[fits], a[fits], a[fits] + min_words
    of, c, d = spans(line)
    whole = d - c >= line_words
    key, at = np.unique(np.concatenate((a, c[whole])) * (len(word) + 1) + np.concatenate((b, d[whole])), return_index=True)
    doc, a, b = np.concatenate((doc, of[whole]))[at], key // (len(word) + 1), key % (len(word) + 1)
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word * power[: len(word)], dtype=np.uint64)))
    digest = _mix((run[b] - run[a]) * back[a]).view(np.int64)
    chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    at = chars[doc_begin[doc]]
    return doc, digest, chars[begins[a]] - at, chars[stops[b - 1]] - at, a - first_word[doc], b - first_word[doc]


def _again(doc: np.ndarray, digest: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which units the same text holds before, without a word in common."""
    order = np.lexsort((a, digest, doc))
    doc, digest, a, b = doc[order], digest[order], a[order], b[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])
    group = np.cumsum(fresh) - 1
    out = np.zeros(len(doc), bool)
    out[order] = ~fresh & (a >= b[fresh][group])
    return out


def _unit_rows(docs: DataFrame, min_words: int, line_words: int) -> DataFrame:
    """One row per unit. ``chars`` is start and end; ``words`` is first word, word after the last, and whether it is ``again``."""
    schema = "rid long, doc_id long, digest long, chars long, words long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, ids = batch.column("rid"), batch.column("doc_id")
            for at, part in slices(batch, "text", CHUNK):
                doc, digest, a, b, w, x = units(part.column("text").to_pylist(), min_words, line_words)
                chars, words = a << 32 | b, w << 32 | x << 1 | _again(doc, digest, w, x)
                for i in range(0, len(doc), 100_000):
                    s = slice(i, i + 100_000)
                    who = pa.array(doc[s] + at)
                    yield pa.RecordBatch.from_arrays([rids.take(who), ids.take(who), *[pa.array(x[s]) for x in (digest, chars, words)]], ["rid", "doc_id", "digest", "chars", "words"])

    return docs.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, line_words: int = 1, rid: str | None = None) -> DataFrame:
    """One row per removed run: doc_id, start, end (code points, exclusive), n_words, n_units.

    Whole lines count as units from ``line_words`` words on. Rows are ranked by id;
    of rows that share an id, each keeps what the others of that id hold. Null
    ids rank last. Null and empty texts have no units. An empty table gives no
    rows; other columns don't matter. ``rid`` names a column that tells rows
    apart and is returned as well.
    """
    d = docs.select((F.col(rid) if rid else F.monotonically_increasing_id()).cast("long").alias("rid"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.col(text_col).alias("text"))
    rows = _unit_rows(d, min_words, line_words)
    again = F.col("words").bitwiseAND(1) == 1
    owners = rows.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.max(again).alias("twice")).filter("owner <> last or twice")
    # written out, so that the join has nothing else to do and Spark can split a digest that many documents hold
    owners = scratch_table(owners.select("digest", "owner"), "substring-owners")
    found = rows.join(owners, "digest").filter(again | (F.col("doc_id") != F.col("owner")))
    a, b = F.shiftright("words", 32), F.shiftright("words", 1).bitwiseAND((1 << 31) - 1)
    found = found.select("rid", "doc_id", F.shiftright("chars", 32).alias("start"), F.col("chars").bitwiseAND((1 << 32) - 1).alias("end"), a.alias("a"), b.alias("b"))
    # units of a document that overlap or touch form a run
    w = Window.partitionBy("rid").orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.withColumn("fresh", F.when(F.col("a") > before, 1).otherwise(0))
    runs = apart.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("rid", "run").agg(
        F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), (F.max("b") - F.min("a")).alias("n_words"), F.count("*").alias("n_units")
    )
    ids = F.when(F.col("doc_id") < (1 << 63) - 1, F.col("doc_id")).alias("doc_id")
    return runs.select(*(["rid"] if rid else []), ids, "start", "end", "n_words", "n_units")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, line_words: int = 1) -> DataFrame:
    """``docs`` without their repeated runs. All rows and columns stay, whatever the columns are named."""
    own = scratch_table(numbered(docs), "substring-rows")
    i, t = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    spans = repeated_spans(own, i, t, min_words, line_words, "rid").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    text = F.col(t)
    cut = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(F.concat(acc["kept"], text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).alias("kept"), s["end"].alias("at")),
        lambda acc: F.concat(acc["kept"], text.substr((acc["at"] + 1).cast("int"), F.length(text))),
    )
    return renamed(own.join(spans, "rid", "left").withColumn(t, F.when(F.col("spans").isNotNull(), cut).otherwise(text)), docs)
