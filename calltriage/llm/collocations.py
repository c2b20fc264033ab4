"""Collocations by best-first branch-and-bound growth.

A phrase's score is that of its lowest cut, ``2000000 * a / (l + r)`` with the
counts of the phrase and of both parts. No phrase that begins with a prefix p
can pass ``2000000 * f(p) / (f(first word) + f(p))``, as both its own count
and the rest's are bounded by f(p) and its own; for phrases that end with a
suffix the same holds with the last word. So, language by language, only
prefixes and suffixes are grown whose bound reaches a threshold tau. Growth
begins with a tau that enough word pairs reach. Of all phrases with a score of
tau or more, counts, cuts and longer candidates are then known; if at least
``top`` of them survive, nothing with a lower bound can be among the first. Other
languages go on with a lower tau, down to 0.

Counts are made from the texts for one length at a time. Which shorter phrases
are frequent or are grown goes to the tasks as a bitmap of their hashes, of
bounded size: if it gets full more phrases are counted, and none is lost.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, scratch_table

TOP = 2000
#: Words of the longest phrases, and occurrences that make a phrase a candidate.
LONGEST, LEAST = 4, 30
#: A longer candidate with this share (of 100) of the occurrences takes a phrase's place.
SHARE = 80
#: Bytes of one language's texts that are counted at a time, and of all that wait in a task.
CHUNK, WAITING = 4 << 20, 8 << 20
#: Bits of a bitmap for each phrase in it, and at most.
BITS_EACH, MAX_BITS = 32, 1 << 27
#: ``top`` times this many word pairs reach tau in the first round, and this many times as many in each round after it.
WIDER = 8
#: Scores that one step of tau takes together.
STEP = 100

# fixed values: what ends a piece; A-Z in lower case
_BYTES = bytes(0x2E if b in b".,;:!?\x0a\x0b\x0c\x0d" else b for b in range(256)).lower()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def read(texts: list[str]) -> list[bytes]:
    """The words of texts of one language; "." stands between pieces."""
    raw = "\n".join(texts).encode("utf-8", "surrogatepass")
    return raw.translate(_BYTES).replace(b".", b" . ").split()


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    import xxhash

    seed = zlib.crc32(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each run of hashed words."""
    h = parts[0]
    for p in parts[1:]:
        h = (h ^ h >> np.uint64(29)) * _MIX + p
    return (h ^ h >> np.uint64(32)) * _MIX


class Bitmap:
    """A set of hashes that may hold more than was put in."""

    def __init__(self, bits: bytes, size: int):
        self.bits, self.shift = np.frombuffer(bits, np.uint8), np.uint64(64 - size.bit_length() + 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _grown(h: np.ndarray, k: int, maps: dict[tuple[str, int], Bitmap]) -> np.ndarray:
    """The places at which a phrase of ``k`` words is counted; ``h`` are the words' hashes. Ends of pieces are not looked at."""
    n = len(h) - k + 1
    shorter = _joined([h[i : i + n + 1] for i in range(k - 1)])
    wanted = maps["head", k - 1].has(shorter[:-1]) | maps["tail", k - 1].has(shorter[1:])
    if k == 2:
        return wanted & maps["tail", 1].has(shorter[1:]) & maps["head", 1].has(shorter[:-1])
    # all word pairs have been counted, so what holds a rare one is rare
    often = maps["often", 2].has(_joined([h[i : i + n + k - 2] for i in range(2)]))
    for i in range(k - 1):
        wanted &= often[i : i + n]
    return wanted


def counted(lang: str, texts: list[str], k: int, maps: dict) -> tuple[pa.Array, np.ndarray]:
    """(phrases of k words in the texts, their counts); for k = 1 also "" with the number of all words."""
    words = read(texts)
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    end = number[b"."]
    ids = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
    del words
    names = pa.array(list(number), pa.binary()).cast(pa.string())
    if k == 1:
        n = np.bincount(ids, minlength=1)
        n[end] = 0
        return pa.concat_arrays([pa.array([""]), names[1:]]), np.concatenate([[n.sum()], n[1:]])
    if len(ids) < k:
        return names[:0], np.zeros(0, np.int64)
    wanted = _grown(_word_hashes(lang, list(number))[ids], k, maps)
    for i in range(k):
        wanted &= ids[i : len(ids) - k + 1 + i] != end
    at = np.flatnonzero(wanted)
    code, size, numbered = ids[at].astype(np.int64), len(number), []
    for i in range(1, k):
        code = code * size + ids[at + i]
        if i < k - 1:  # numbered anew, so that the next product stays below 64 bits
            numbered.append(np.unique(code))
            code = np.searchsorted(numbered[-1], code)
    code, n = np.unique(code, return_counts=True)
    parts = []
    for shorter in [*numbered[::-1], None]:
        code, last = np.divmod(code, size)
        parts.append(names.take(pa.array(last)))
        code = code if shorter is None else shorter[code]
    parts.append(names.take(pa.array(code)))
    return pc.binary_join_element_wise(*parts[::-1], " "), n


def _count(docs: DataFrame, k: int, maps=None) -> DataFrame:
    """(lang, phrase, f) of the phrases of ``k`` words with LEAST occurrences or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = maps.value if maps else {}
        held: dict[str, list[str]] = defaultdict(list)
        size: dict[str, int] = defaultdict(int)

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            phrases, n = counted(lang, held.pop(lang), k, sets)
            size.pop(lang)
            for i in range(0, len(phrases), 200_000):
                part = phrases[i : i + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, pa.array(n[i : i + 200_000], pa.int64())], ["lang", "phrase", "f"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held[lang].append(text)
                size[lang] += len(text)
                if size[lang] >= CHUNK:
                    yield from flush(lang)
                elif sum(size.values()) >= WAITING:
                    yield from flush(max(size, key=size.get))
        for lang in list(held):
            yield from flush(lang)

    found = docs.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return found.filter((F.col("f") >= LEAST) | (F.col("phrase") == ""))


def _bitmaps(phrases: DataFrame, k: int, kinds: dict[str, Column]) -> dict[tuple[str, int], Bitmap]:
    """Bitmaps of the phrases of ``k`` words for which each condition holds."""
    counts = phrases.agg(*[F.count_if(c).alias(name) for name, c in kinds.items()]).first()
    bits = {name: min(MAX_BITS, 1 << max(15, (BITS_EACH * counts[name] - 1).bit_length())) for name in kinds}
    names = list(kinds)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words = np.array(batch.column("lang").to_pylist(), object), [p.encode("utf-8", "surrogatepass").split(b" ") for p in batch.column("phrase").to_pylist()]
            h = np.zeros((len(words), k), np.uint64)
            for lang in set(langs):
                rows = np.flatnonzero(langs == lang)
                h[rows] = _word_hashes(lang, [w for r in rows for w in words[r]]).reshape(-1, k)
            h = _joined([h[:, i] for i in range(k)])
            for i, name in enumerate(names):
                at = (h[np.array(batch.column(name), bool)] >> np.uint64(64 - bits[name].bit_length() + 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at)], ["kind", "place"])

    rows = phrases.select("lang", "phrase", *[c.alias(name) for name, c in kinds.items()]).mapInArrow(places, "kind int, place long")
    rows = rows.groupBy("kind", F.bitmap_bucket_number(F.col("place") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("bits"))
    full = {name: bytearray(bits[name] // 8) for name in names}
    for r in rows.toLocalIterator():  # MAX_BITS a kind at most
        start = (r["bucket"] - 1) * 4096
        full[names[r["kind"]]][start : start + 4096] = r["bits"]
    return {(name, k): Bitmap(bytes(full[name]), bits[name]) for name in names}


def _ratio(a: Column, parts: Column) -> Column:
    """2000000 * a / parts, rounded down; in decimals, as products may pass 64 bits."""
    return F.call_function("div", F.lit(2_000_000).cast("decimal(10,0)") * a.cast("decimal(20,0)"), parts.cast("decimal(21,0)"))


def _longs(*cs: Column) -> Column:
    return F.array(*cs).cast("array<bigint>")


def _with_parts(phrases: DataFrame, shorter: DataFrame, k: int) -> DataFrame:
    """Adds to phrases of ``k`` words the counts of their first words, ``ls``, and of what is left after those, ``rs``.

    A phrase of which a part wasn't counted gets nulls; it can't reach tau.
    """
    heads = shorter.select("lang", F.col("phrase").alias("head"), F.concat("ls", _longs(F.col("f"))).alias("ls"))
    tails = shorter.select("lang", F.col("phrase").alias("tail"), F.concat(_longs(F.col("f")), F.col("rs")).alias("rs"))
    d = phrases.withColumns({"head": F.substring_index("phrase", " ", k - 1), "tail": F.substring_index("phrase", " ", 1 - k)})
    d = d.join(heads, ["lang", "head"], "left").join(tails, ["lang", "tail"], "left")
    cut = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(k - 2)), lambda i: F.struct(_ratio(F.col("f"), F.get("ls", i) + F.get("rs", i)).alias("score"), i.alias("at"))))
    d = d.withColumn("cut", F.when(F.col("ls").isNotNull() & F.col("rs").isNotNull(), cut))
    return d.select(
        "lang", "phrase", "head", "tail", "f", "ls", "rs", F.col("cut.score").alias("score"), F.get("ls", F.col("cut.at")).alias("l"), F.get("rs", F.col("cut.at")).alias("r"),
        # the highest score that a longer phrase can have which begins or ends with this one
        _ratio(F.col("f"), F.get("ls", F.lit(0)) + F.col("f")).alias("head_bound"), _ratio(F.col("f"), F.get("rs", F.lit(k - 2)) + F.col("f")).alias("tail_bound"),
    )


def _thresholds(pairs: DataFrame, langs: DataFrame, wanted: int) -> DataFrame:
    """(lang, tau): a score that ``wanted`` word pairs reach; 0 if there are fewer."""
    steps = pairs.groupBy("lang", F.floor(F.col("score") / STEP).alias("b")).agg(F.count("*").alias("c"))
    # a language has 1,000,000 / STEP steps at most
    steps = steps.withColumn("reach", F.sum("c").over(Window.partitionBy("lang").orderBy(F.desc("b"))))
    tau = steps.filter(F.col("reach") >= wanted).groupBy("lang").agg(F.max("b").alias("b"))
    return langs.join(tau, "lang", "left").select("lang", (F.coalesce("b", F.lit(0)) * STEP).alias("tau"))


def _surviving(phrases: DataFrame, longer: DataFrame | None) -> DataFrame:
    """Phrases that no longer candidate takes the place of; one with one word more is enough, as what is longer occurs in it."""
    if longer is None:
        return phrases
    most = longer.select("lang", F.col("head").alias("phrase"), F.col("f").alias("longer")).unionByName(longer.select("lang", F.col("tail").alias("phrase"), F.col("f").alias("longer")))
    most = most.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = 100 * F.col("longer").cast("decimal(20,0)") < SHARE * F.col("f").cast("decimal(20,0)")
    return phrases.join(most, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | kept).drop("longer")


def _best(phrases: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their rank; parts of a language are cut first, so that no task sorts all of it."""
    order = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    first = phrases.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def _round(docs: DataFrame, pairs: DataFrame, often: dict, tau: DataFrame, left: list) -> DataFrame:
    """(lang, tau, phrase, f, l, r, score): the surviving phrases with a score of tau or more, written out."""
    spark, levels = docs.sparkSession, [pairs]
    for k in range(3, LONGEST + 1):
        grown = levels[-1].join(tau, "lang")
        maps = often | _bitmaps(grown, k - 1, {"head": F.coalesce(F.col("head_bound") >= F.col("tau"), F.lit(False)), "tail": F.coalesce(F.col("tail_bound") >= F.col("tau"), F.lit(False))})
        sent = spark.sparkContext.broadcast(maps)
        levels.append(scratch_table(_with_parts(_count(docs, k, sent), levels[-1], k), f"phrases-{k}"))
        left.append(levels[-1])
        sent.destroy()
    parts = []
    for phrases, longer in zip(levels, [*levels[1:], None], strict=True):
        good = phrases.join(tau, "lang").filter(F.col("score") >= F.col("tau"))
        parts.append(_surviving(good, longer).select("lang", "tau", "phrase", "f", "l", "r", "score"))
    return scratch_table(reduce(DataFrame.unionByName, parts), "phrases-surviving")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> DataFrame:
    """Per language, its ``top`` best phrases of 2 to 4 words: lang, rank, phrase, a, l, r, n, score.

    Only A-Z are lower-cased. Pieces end at ``.,;:!?`` and line ends, words at
    spaces and tabs. Null texts are empty; documents without a language, and
    those of language ``und``, are one language. Every row counts, repeated ones
    included. A table without candidates gives no rows; further columns,
    whatever their names, don't matter. Equal scores go by the phrase's count,
    then by the phrase in byte order.
    """
    spark = docs.sparkSession
    d = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    words = scratch_table(_count(d, 1), "phrases-1")
    none = _longs()
    single = words.filter("phrase <> ''").select("lang", "phrase", "f", none.alias("ls"), none.alias("rs"))
    every = F.lit(True)
    sent = spark.sparkContext.broadcast(_bitmaps(single, 1, {"head": every, "tail": every}))
    pairs = scratch_table(_with_parts(_count(d, 2, sent), single, 2), "phrases-2")
    sent.destroy()
    often = _bitmaps(pairs, 2, {"often": every})
    total = words.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    found, wanted, todo = [], WIDER * top, None
    while todo is None or todo:
        mine_, of = (d, pairs) if todo is None else (d.filter(F.col("lang").isin(todo)), pairs.filter(F.col("lang").isin(todo)))
        langs = total.select("lang") if todo is None else total.select("lang").filter(F.col("lang").isin(todo))
        tau, left = scratch_table(_thresholds(of, langs, wanted), "phrases-tau"), []
        kept = _round(mine_, of, often, tau, left)
        # a row for each language
        n = kept.groupBy("lang").agg(F.count("*").alias("kept"))
        todo = [r["lang"] for r in tau.join(n, "lang", "left").filter((F.col("tau") > 0) & (F.coalesce("kept", F.lit(0)) < top)).select("lang").collect()]
        found.append(kept.filter(~F.col("lang").isin(todo)) if todo else kept)
        wanted *= WIDER
        for t in [*left, tau]:
            drop_scratch(t)
    drop_scratch(pairs)
    best = _best(reduce(DataFrame.unionByName, found), top)
    return best.join(total, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
