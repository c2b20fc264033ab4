"""Benchmark decontamination with DataFrame functions only.

Test items become windows of consecutive words, and documents blocks of words,
so that a row stays small however long a text is. The hashes of all windows of
a block are looked up in the set of the items' hashes, which goes to all tasks;
only windows of blocks with a hit become rows. A set too large for that is
looked up as a Bloom filter, whose size is bounded, and only windows that pass
it go on. They are joined to the items' windows and verified on the words
themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, numbered, renamed, run_hash, scratch_table, with_window_hashes, with_words

#: Separators of words: ASCII without digits and letters (after lower-casing).
SEPARATOR_CLASS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
NGRAM = 10
BLOCK = 32
#: The set of hashes goes to all tasks up to this many; with more, its Bloom filter does.
HASH_SET = 50_000
#: What is broadcast to a join has this many bytes at most; more is joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: As an estimate: what a row of a broadcast holds besides its strings.
ROW_BYTES = 100
#: The Bloom filter has a long for this many windows, each of which sets up to 4 of its bits.
FILTER_KEYS = 4
#: As an estimate: what a long of the filter takes in a broadcast. It has BROADCAST_BYTES at most; a fuller one lets more windows pass.
FILTER_ROW_BYTES = 50


def add_words(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Adds the words of a text, lower-cased A-Z; null gives none."""
    low = df.withColumn("__low", ascii_lower(F.coalesce(F.col(text_col), F.lit(""))))
    return with_words(low, "__low", out, SEPARATOR_CLASS).drop("__low")


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = NGRAM) -> DataFrame:
    """(gram, len, items): the distinct windows of all items.

    An item of fewer than ``n`` words, but not none, is one window. ``items``
    lists the ids, as strings, of the items that hold the window. Items
    without words or with a null id have no windows.
    """
    b = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("t"))
    b = add_words(b, "t", "w").filter(F.col("item").isNotNull() & (F.size("w") > 0))
    b = b.withColumn("starts", F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))))
    b = b.select("item", F.explode(F.transform("starts", lambda i: F.slice("w", i, n))).alias("gram"))
    b = b.groupBy("gram").agg(F.collect_set("item").alias("items"))
    return b.select("gram", F.size("gram").alias("len"), "items")


def _hashed(windows: DataFrame, n: int) -> DataFrame:
    """Adds ``h``, the hash that a document's window of the same words has."""
    w = windows.withColumn("hw", F.transform("gram", lambda x: F.xxhash64(x)))
    return w.select(F.coalesce(*[F.when(F.col("len") == k, run_hash(F.col("hw"), k)) for k in range(n, 0, -1)]).alias("h"), "gram", "len", "items")


def _windows_of(n: int) -> Column:
    return F.transform(F.slice(f"h{n}", 1, BLOCK), lambda h, i: F.struct((i + 1).alias("k"), F.lit(n).alias("len"), h.alias("h")))


def _probes(docs: DataFrame, text_col: str, lengths: list[int], known: dict[int, list[int]] | None) -> DataFrame:
    """(rid, n_words, pos, k, plen, ph, block): the windows of all documents, or of the blocks with a ``known`` hash.

    ``pos`` is the window's first word, from 0. Each document also has one row
    with length 0 and a hash of its row alone, so that documents without a hit stay.
    """
    over = max(lengths) - 1
    d = add_words(docs.select("rid", F.col(text_col).alias("t")), "t", "w")
    d = d.select("rid", F.size("w").alias("n_words"), F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(BLOCK)), lambda s: F.struct(s.alias("at"), F.slice("w", s + 1, BLOCK + over).alias("block")))).alias("b"))
    d = d.select("rid", "n_words", "b.at", "b.block").withColumn("hw", F.transform("block", lambda w: F.xxhash64(w)))
    kind = "array<struct<k:int,len:int,h:bigint>>"
    none = F.array().cast(kind)
    parts, hit = [], F.lit(False)
    for n in lengths:
        d = with_window_hashes(d, "hw", f"h{n}", n)
        parts.append(_windows_of(n))
        if known and known.get(n):
            hit = hit | F.expr(f"exists(h{n}, h -> h in ({', '.join(f'{h}L' for h in known[n])}))")
    windows = F.concat(*parts)
    # inside the explode, as a filter on the hashes would be pushed below them and make them anew
    windows = windows if known is None else F.when(hit, windows).otherwise(none)
    own = F.when(F.col("at") == 0, F.array(F.struct(F.lit(1).alias("k"), F.lit(0).alias("len"), F.xxhash64("rid").alias("h")))).otherwise(F.array()).cast(kind)
    d = d.select("rid", "n_words", "at", "block", F.explode(F.concat(own, windows)).alias("p"))
    return d.select("rid", "n_words", (F.col("at") + F.col("p.k") - 1).alias("pos"), F.col("p.k").alias("k"), F.col("p.len").alias("plen"), F.col("p.h").alias("ph"), "block")


def _bits(h: Column) -> Column:
    """The bits of a hash in its long of the filter, from the hash's upper bits."""
    one = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(63).cast("int"))
    return one(40).bitwiseOR(one(46)).bitwiseOR(one(52)).bitwiseOR(one(58))


def _filtered(probes: DataFrame, wins: DataFrame, n_windows: int) -> DataFrame:
    """The probes that may be one of ``wins``, with ``block`` cut to the window's words, and those of length 0.

    The filter is a table of longs joined by number, so a window's row takes
    one long from it and no document moves.
    """
    longs = max(1, min(-(-n_windows // FILTER_KEYS), BROADCAST_BYTES // FILTER_ROW_BYTES))
    slot = lambda h: F.pmod(h, F.lit(longs).cast("long"))
    f = wins.groupBy(slot(F.col("h")).alias("slot")).agg(F.bit_or(_bits(F.col("h"))).alias("bits"))
    p = probes.join(F.broadcast(f), slot(probes.ph) == f.slot, "left")
    p = p.filter((F.col("plen") == 0) | (F.col("bits").bitwiseAND(_bits(F.col("ph"))) == _bits(F.col("ph"))))
    return p.withColumn("block", F.slice("block", "k", "plen")).withColumn("k", F.lit(1)).drop("slot", "bits")


def _probed(docs: DataFrame, benchmark: DataFrame, text_col: str, n: int) -> DataFrame:
    """``_probes`` with the items of each verified window; windows without items are left out."""
    wins = scratch_table(_hashed(item_windows(benchmark, n=n), n), "leak-windows")
    # the lengths are n values at most
    stats = wins.groupBy("len").agg(F.count("*").alias("n"), F.sum(F.length(F.array_join("gram", " ")) + F.length(F.array_join("items", " ")) + ROW_BYTES).alias("bytes")).collect()
    lengths = sorted({r["len"] for r in stats} | {n})
    known, n_windows = None, sum(r["n"] for r in stats)
    if n_windows <= HASH_SET:
        found = wins.select("len", "h").collect()  # HASH_SET rows at most
        known = {m: sorted({r["h"] for r in found if r["len"] == m}) for m in lengths}
    side = F.broadcast(wins) if sum(r["bytes"] for r in stats) <= BROADCAST_BYTES else wins
    p = _probes(docs, text_col, lengths, known)
    if known is None:
        p = _filtered(p, wins, n_windows)
    return p.join(side, (p.ph == side.h) & (p.plen == side.len) & (F.slice(p.block, p.k, p.plen) == side.gram), "left").filter("plen = 0 or items is not null")


def hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n: int = NGRAM) -> DataFrame:
    """One row per row of ``docs``: rid, n_words, n_hit, spans, items.

    ``docs`` needs a unique ``rid``. ``items`` are the ids of the items with a
    window in the text, sorted as strings; ``spans`` the verified windows as
    (first word, words). An empty benchmark gives documents without hits.
    """
    g = _probed(docs, benchmark, text_col, n).groupBy("rid").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_list(F.when(F.col("items").isNotNull(), F.struct(F.col("pos"), F.col("plen").alias("len")))).alias("spans"),
        F.flatten(F.collect_set("items")).alias("items"),
    )
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["pos"], s["pos"] + s["len"] - 1)))
    return g.select("rid", "n_words", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), "spans", F.sort_array(F.array_distinct("items")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM) -> DataFrame:
    """Per row of ``docs``: its id and how much of it occurs in the benchmark.

    Null or empty texts have no words and are clean. Rows that share an id are
    reported one by one. An empty table gives no rows; other columns don't
    matter, whatever their names.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    d = d.withColumn("rid", F.struct(F.monotonically_increasing_id().alias("m"), "id"))
    return hits(d, benchmark, "t", n).select(
        F.col("rid.id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", n: int = NGRAM) -> DataFrame:
    """The rows of ``docs`` without any benchmark window; all columns stay, whatever their names.

    Null or empty texts stay. Whether a row goes follows from its text alone,
    so what is shuffled is the digests of contaminated texts.
    """
    d = numbered(docs).drop("rid")
    text = f"c{docs.columns.index(text_col)}"
    digest = F.unhex(F.md5(F.coalesce(text, F.lit(""))))
    found = _probed(d.select(digest.alias("rid"), F.col(text).alias("t")), benchmark, "t", n).filter("plen > 0")
    dirty = scratch_table(found.select("rid").distinct(), "leak-texts")
    few = dirty.count() <= BROADCAST_BYTES // ROW_BYTES
    return renamed(d.withColumn("md5", digest).join(F.broadcast(dirty) if few else dirty, F.col("md5") == F.col("rid"), "left_anti"), docs)
