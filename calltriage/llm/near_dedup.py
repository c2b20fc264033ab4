"""Near duplicates by SuperMinHash signatures, banding and exact verification.

1. Each text's set of word shingles is hashed; texts of equal sets form a class
   that goes on as one node.
2. SuperMinHash: an element walks through a permutation of the slots that its
   own hash seeds, proposing step + fraction to one slot a step; a document
   stops as soon as all of its slots are taken. Bands of slots give buckets.
3. Each bucket is tied to its most connected node, so a bucket of n nodes
   gives n - 1 candidates, not all pairs. The candidates of one such node are
   verified on their full sets, in blocks of bounded size: each text once,
   against that node, and those that fail against the others of their block.
   Only what failed in groups of several blocks meets the other blocks as well,
   those that failed there included.
   So every two nodes that share a bucket are either compared or already linked.
4. Links are joined to components by spreading the smallest label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_scratch, numbered, renamed, scratch_table, slices

#: Slots of a signature; BANDS bands of ROWS slots. Texts of similarity 0.8
#: share no bucket with probability (1 - 0.8^6)^42 = 3e-6, more similar ones less.
ROWS, BANDS = 6, 42
SLOTS = ROWS * BANDS
#: Shingles of a verified block of a group.
BLOCK_SHINGLES = 100_000
#: The ids of texts to compare, and of large groups, are broadcast up to this many; more are joined by a shuffle.
BROADCAST_NODES = 1 << 21
CHUNK = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit value of each 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = _mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's k-word shingles.

    Words are lower-cased (A-Z only); a text of fewer than k words, but not
    none, is one shingle. Hashes are sums over byte positions, so all shingles
    of many texts are cut from one running sum.
    """
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    buf = np.frombuffer(b" ".join(b" ".join(w) for w in words if w) + b" ", np.uint8)
    power = np.cumprod(np.full(len(buf), _BASE), dtype=np.uint64)
    back = np.cumprod(np.full(len(buf), _INVERSE), dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[buf] * power, dtype=np.uint64)))
    stops = np.flatnonzero(buf == 32)
    starts = np.concatenate(([0], stops[:-1] + 1))
    out, at = [], 0
    for w in words:
        n = len(w)
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        m = max(1, n - k + 1)
        a, b = starts[at : at + m], stops[at + min(n, k) - 1 : at + n]
        out.append(np.unique(_mix((total[b] - total[a]) * back[a])))
        at += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SLOTS values for each non-empty set."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    element = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    free = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n * SLOTS, free)
    swaps: list[np.ndarray] = []
    for j in range(SLOTS):
        r = _mix(element + np.uint64((j + 1) * int(_MULTIPLIER) % (1 << 64)))
        position = j + ((r >> np.uint64(32)) % np.uint64(SLOTS - j)).astype(np.int16)
        # what a swap at an earlier step has put to this position
        slot = position.copy()
        for i in range(j - 1, -1, -1):
            slot[swaps[i] == slot] = i
        swaps.append(position)
        value = (np.uint64(j) << np.uint64(32)) | (r & np.uint64(0xFFFFFFFF))
        at = owner * SLOTS + slot
        np.minimum.at(sig, at, value)
        # documents without a free slot are done: later steps only give larger values
        open_ = (sig.reshape(n, SLOTS) == free).any(axis=1)[owner]
        if not open_.all():
            if not open_.any():
                break
            owner, element, swaps = owner[open_], element[open_], [s[open_] for s in swaps]
    return sig.reshape(n, SLOTS)


def bucket_ids(sig: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band of each signature."""
    x = sig.reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MULTIPLIER, x.shape[:2]).copy()
    for i in range(ROWS):
        h = _mix(h ^ x[:, :, i]) * _MULTIPLIER
    return h.view(np.int64)


def _hashed(docs: DataFrame, text: str, k: int) -> DataFrame:
    """Adds n, digest and buckets to every row; empty sets have no digest."""
    schema = T.StructType([*docs.schema.fields, T.StructField("n", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("buckets", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch, text, CHUNK):
                sets = shingle_sets(part.column(text).to_pylist(), k)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                found = [i for i, s in enumerate(sets) if len(s)]
                buckets: list = [None] * len(sets)
                if found:
                    for i, b in zip(found, bucket_ids(signatures([sets[i] for i in found])), strict=True):
                        buckets[i] = b
                columns = [*part.columns, pa.array([len(s) for s in sets], pa.int32()), pa.array(digests, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "n", "digest", "buckets"])

    return docs.mapInArrow(run, schema)


def _candidates(nodes: DataFrame) -> DataFrame:
    """(hub, node, n): every bucket's nodes tied to its most connected node, without repeats."""
    rows = nodes.select("node", "n", F.explode("buckets").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    inside = scratch_table(rows.join(shared, "bucket"), "near-buckets")
    degree = inside.groupBy("node").agg(F.sum("size").alias("degree"))
    hubs = inside.join(degree, "node").groupBy("bucket").agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("hub"))
    return inside.join(hubs, "bucket").filter("node <> hub").select("hub", "node", "n").distinct()


class _Sets:
    """Full sets of one block of a group, with their inverted index."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.size = sets, np.array([len(s) for s in sets])
        self.shingle, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        self.holder = np.repeat(np.arange(len(sets)), self.size)[order]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(inverse))))
        self.of = np.split(inverse, np.cumsum(self.size)[:-1])

    def links(self, i: int, percent: int) -> np.ndarray:
        """All sets that are similar enough to set i."""
        parts = [self.holder[self.first[x] : self.first[x + 1]] for x in self.of[i]]
        common = np.bincount(np.concatenate(parts), minlength=len(self.sets))
        return np.flatnonzero(100 * common >= percent * (self.size + self.size[i] - common))


def _linked(ids: list[int], sets: list[np.ndarray], checked: list[bool], percent: int) -> tuple[list[tuple[int, int]], list[int]]:
    """((node, smallest node linked to it in this block), the checked nodes that aren't linked to the first).

    The first is compared with all, and so are the ``checked`` ones that are not linked to it.
    """
    index = _Sets(sets)
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for j in index.links(0, percent):
        root[find(int(j))] = find(0)
    failed = [i for i in range(1, len(ids)) if checked[i] and find(i) != find(0)]
    for i in failed:
        for j in index.links(i, percent):
            root[find(int(j))] = find(i)
    least: dict[int, int] = {}
    for i, node in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, node), node)
    return [(node, least[find(i)]) for i, node in enumerate(ids) if least[find(i)] != node], failed


def _verified(tasks: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, hub, n) from (hub, i, j, node, first, checked): links (a, b), or nodes a with n shingles that failed at their hub.

    The rows of one (hub, i, j) are compared in one task; of those, the one that is ``first`` and the ``checked`` ones with all.
    """
    rows = tasks.hint("merge").join(texts.select("node", "text"), "node").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", F.desc("first"), F.desc("checked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chars, found = None, 0, []
        ids, texts, checked, sets = [], [], [], []

        def hash_texts() -> None:
            sets.extend(shingle_sets(texts, k))
            texts.clear()

        def finish() -> None:
            hash_texts()
            if len(ids) > 1:
                links, failed = _linked(ids, sets, checked, percent)
                found.extend((a, b, None, None) for a, b in links)
                found.extend((ids[i], None, key[0], len(sets[i])) for i in failed)
            for x in (ids, checked, sets):
                x.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b", "hub", "n"])
                found.clear()

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("hub", "i", "j", "node", "checked", "text")]
            for hub, i, j, node, is_checked, text in zip(*cols, strict=True):
                if key != (hub, i, j):
                    finish()
                    key, chars = (hub, i, j), 0
                ids.append(node)
                checked.append(is_checked)
                texts.append(text)
                chars += len(text)
                if chars > CHUNK:
                    hash_texts()
                    chars = 0
            yield from flush()
        finish()
        yield from flush()

    return rows.select("hub", "i", "j", "node", "checked", "text").mapInArrow(run, "a long, b long, hub long, n long")


def _blocks(rows: DataFrame, label: str) -> DataFrame:
    """(hub, blocks): how many blocks the rows of a hub need, where it is more than one."""
    return scratch_table(rows.groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")).filter("blocks > 1"), label)


def _links(candidates: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links that tie together all nodes that are linked within a group."""
    one, dealt_to = F.lit(1), lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    large = _blocks(candidates, "near-blocks")  # a table of its own, so that the rows of a hub that many nodes have need not meet
    large = F.broadcast(large) if large.count() <= BROADCAST_NODES else large
    dealt = candidates.join(large, "hub", "left").withColumn("blocks", F.coalesce("blocks", one)).withColumn("i", dealt_to(F.col("blocks")))
    members = dealt.select("hub", "i", F.lit(0).alias("j"), "node", F.lit(False).alias("first"), F.lit(True).alias("checked"), "blocks")
    hubs = members.select("hub", "i", "j", F.col("hub").alias("node"), F.lit(True).alias("first"), F.lit(True).alias("checked"), "blocks").distinct()
    found = scratch_table(_verified(members.unionByName(hubs), texts, k, percent), "near-verified")
    links = found.filter("hub is null").select("a", "b")
    several = dealt.filter("blocks > 1")
    failed = found.filter("hub is not null").select("hub", F.col("a").alias("node"), "n").join(large, "hub", "left_semi")
    if not failed.isEmpty():
        failed = scratch_table(failed, "near-failed")
        parts = failed.select("hub").distinct().join(_blocks(failed, "near-failed-blocks"), "hub", "left").select("hub", F.coalesce("blocks", one).alias("parts"))
        parts = scratch_table(parts, "near-parts")
        each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        own = failed.join(parts, "hub").select("hub", "node", dealt_to(F.col("parts")).alias("part"))
        again = own.join(several.select("hub", "node", "blocks"), ["hub", "node"])
        again = again.select("hub", F.col("part").alias("i"), each(F.col("blocks")).alias("j"), "node", F.lit(True).alias("checked"))
        # every part meets all nodes of a block but its own ones, so the failed ones of other parts as well
        others = several.join(parts, "hub").join(own, ["hub", "node"], "left")
        others = others.select("hub", each(F.col("parts")).alias("in"), F.col("i").alias("block"), "node", "part").filter("part is null or part <> in")
        others = others.select("hub", F.col("in").alias("i"), F.col("block").alias("j"), "node", F.lit(False).alias("checked"))
        more = again.unionByName(others).withColumn("first", F.lit(False))
        links = links.unionByName(_verified(more, texts, k, percent).filter("b is not null").select("a", "b"))
    return links.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each linked node can reach.

    Every round takes the smallest label of the neighbours and then the label's
    own label, so long chains shorten quickly. Rounds are written out and end
    when no label has changed.
    """
    links = scratch_table(links.filter("a <> b"), "near-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = rounds = scratch_table(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "near-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nxt = labels.join(seen, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        nxt = nxt.join(jump, "label", "left").select("node", F.least("label", "far").alias("label"), "was")
        nxt = scratch_table(nxt, "near-labels")
        drop_scratch(rounds)
        rounds, labels = nxt, nxt.select("node", "label")
        if nxt.filter("label <> was").isEmpty():
            return labels


def _grouped(docs: DataFrame, i: str, t: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(the rows of numbered columns with doc_id, n and digest, as written out; (digest, node, label, component_id) of those with shingles)."""
    rows = scratch_table(_hashed(docs.withColumn("doc_id", F.col(i).cast("long")), t, shingle), "near-rows")
    # equal sets have equal buckets, so any row of a class stands for it
    classes = rows.filter("digest is not null").groupBy("digest").agg(F.min("rid").alias("node"), F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    classes = scratch_table(classes, "near-classes")
    candidates = scratch_table(_candidates(classes), "near-candidates")
    # of the texts, only those that are compared are moved
    wanted = scratch_table(candidates.select("node").unionByName(candidates.select(F.col("hub").alias("node"))).distinct(), "near-wanted")
    few = wanted.count() <= BROADCAST_NODES
    texts = rows.select(F.col("rid").alias("node"), F.col(t).alias("text")).join(F.broadcast(wanted) if few else wanted, "node", "left_semi")
    labels = components(_links(candidates, texts, shingle, percent))
    named = classes.select("digest", "node", "least_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    return rows, named.join(ids, "label").select("digest", "node", "label", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept.

    Rows are linked if 100 * |A and B| >= percent * |A or B| for their sets of
    ``shingle``-word shingles. ``component_id`` is the smallest id reachable.
    Texts without words (null, empty) have no shingles and no links. Rows of
    equal texts are linked, those that share an id included. Rows with a null
    id take part, but are never kept and give no id to a component. An empty
    table gives no rows; other columns don't matter.
    """
    rows, groups = _grouped(numbered(docs.select(F.col(id_col), F.col(text_col))), "c0", "c1", shingle, percent)
    out = rows.select("rid", "doc_id", "n", "digest")
    # rows without a digest join nothing; a value of their own keeps them apart
    out = out.withColumn("key", F.coalesce("digest", F.col("rid").cast("string").cast("binary"))).join(groups.select(F.col("digest").alias("key"), "component_id"), "key", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near duplicates, all columns, whatever their names.

    The row with the smallest id stays (a null id counts as the largest; of
    rows that share the id, the first). Rows without words all stay.
    """
    i, t = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    rows, groups = _grouped(numbered(docs), i, t, shingle, percent)
    found = rows.filter("digest is not null").select("rid", "doc_id", "digest").join(groups.select("digest", "label"), "digest")
    first = found.groupBy("label").agg(F.min_by("rid", F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("rid"))
    stay = first.select("rid").unionByName(rows.filter("digest is null").select("rid"))
    return renamed(rows.join(stay, "rid", "left_semi"), docs)
