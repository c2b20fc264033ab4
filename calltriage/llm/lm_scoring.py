"""Context-tree weighting over the bytes of normalised texts.

A text becomes the stream of its words' bytes, each word followed by a space
and the text by a line end. Every byte is
decomposed into eight binary decisions; each decision has a context tree over
the preceding bytes, whose nodes hold Krichevsky-Trofimov estimates. A node
weighs its own estimate and that of its children half and half, which mixes
all depths by how well each has predicted the training stream.

Spark counts the grams (DEPTH bytes and the one after them) of all documents,
and no context is dropped. A byte's node shares counts only with the same node
of longer and shorter contexts, so the grams are dealt out by their nearest two
bytes, and each such subtree is weighed by itself. Only sums for the contexts of
one byte (256 x 255 rows at most) reach the driver, which mixes depths 0 and 1;
a second pass goes on from there and writes the log probability of every gram.
The most frequent grams, COMMON_GRAMS at most, are sent to the tasks that score
documents; all others are joined. Word counts are handled alike: only words that
make up at least 2^-COMMON_WORDS of all tokens, at most 2^COMMON_WORDS of them,
are sent to the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_table, slices

DEPTH = 5
#: Grams whose log probabilities are sent to the tasks; the others are joined.
COMMON_GRAMS = 1 << 20
#: Grams that are weighed at a time, if no two nearest bytes have more.
BLOCK = 500_000
COMMON_WORDS = 22
#: A document is learned from unless crc32 of its id modulo FOLDS is HELD_OUT.
FOLDS, HELD_OUT = 7, 2
END = b"\n"
CHUNK = 1 << 20
FLUSH = 1_500_000


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z only) and the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def word_hash(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words)).view(np.int64)


def _stream(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, positions of the bytes that count, document of each of those).

    Before each document stand DEPTH line ends, so that no context reaches into
    another document.
    """
    texts = [b" ".join(d) for d in docs]
    buf = np.frombuffer(END * DEPTH + (END * DEPTH).join(texts), np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    doc = np.repeat(np.arange(len(texts)), lens)
    return buf, np.arange(len(doc)) + DEPTH * (doc + 1), doc


def _grams(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The last DEPTH bytes and the byte itself; the nearest context byte is the highest."""
    key = np.zeros(len(at), np.int64)
    for d in range(1, DEPTH + 1):
        key = (key << 8) | buf[at - d]
    return (key << 8) | buf[at]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return [(keys, np.bincount(inverse, weights=np.concatenate([n for _, n in parts])).astype(np.int64))]


def count(docs: DataFrame) -> DataFrame:
    """(kind, key, n) from (text, held_out): grams of bytes (kind 0) and hashed tokens (kind 1) to learn from, grams held out (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = [[], [], []]

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in range(3):
                for keys, n in _merge(found[kind]) if found[kind] else []:
                    for i in range(0, len(keys), 100_000):
                        k = keys[i : i + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[i : i + 100_000])], ["kind", "key", "n"])
                found[kind].clear()

        for rows in (part.to_pydict() for batch in batches for _, part in slices(batch, "text", CHUNK)):
            docs, words = ([], []), Counter()
            for text, held_out in zip(rows["text"], rows["held_out"], strict=True):
                docs[held_out].append(tokens(text))
            for kind, part in zip((0, 2), docs, strict=True):
                if part:
                    found[kind].append(np.unique(_grams(*_stream(part)[:2]), return_counts=True))
            for d in docs[False]:
                words.update(d)
            found[1].append((word_hash(list(words)), np.fromiter(words.values(), np.int64, len(words))))
            if sum(len(k) for part in found for k, _ in part) > FLUSH:
                for kind in range(3):
                    found[kind] = _merge(found[kind]) if found[kind] else []
                if sum(len(k) for part in found for k, _ in part) > FLUSH // 2:
                    yield from flush()
        yield from flush()

    return docs.select("text", "held_out").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """[key, n, m] of sorted rows; those with the same nearest two bytes stay together."""
    shift, kept, size, limit = 8 * (DEPTH - 1), [], 0, BLOCK
    for batch in batches:
        kept.append([batch.column(c).to_numpy() for c in ("key", "n", "m")])
        size += batch.num_rows
        if size >= limit:
            rows = [np.concatenate(x) for x in zip(*kept, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1] >> shift << shift))
            if cut:
                yield [x[:cut] for x in rows]
            kept, size = [[x[cut:] for x in rows]], size - cut
            limit = max(BLOCK, 2 * size)
    if size:
        yield [np.concatenate(x) for x in zip(*kept, strict=True)]


def _by_depth(keys: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(context << 8 | byte, n) at each depth, from the deepest up to 2; sorted grams that weren't learned from are left out."""
    made = {DEPTH: (keys[n > 0], n[n > 0].astype(float))}
    for d in range(DEPTH - 1, 1, -1):
        k, c = made[d + 1]
        k, inverse = np.unique(k >> 16 << 8 | k & 255, return_inverse=True)
        made[d] = k, np.bincount(inverse, weights=c, minlength=len(k))
    return made


def _weighed(by_depth: dict, b: int) -> dict[int, tuple]:
    """At each depth, the nodes of bit ``b`` as (context << 8 | node, zeros, ones, own weight, log weighted probability)."""
    made, below = {}, None
    for d in sorted(by_depth, reverse=True):
        k, c = by_depth[d]
        code = k >> 8 << 8 | (256 | k & 255) >> (8 - b)
        first = np.flatnonzero(np.diff(code, prepend=-1))
        o = np.add.reduceat(c * (k >> (7 - b) & 1), first) if len(k) else c
        z = np.add.reduceat(c, first) - o if len(k) else c
        code, own = code[first], _kt_log(z, o)
        if below is None:
            w, weighted = np.ones_like(own), own
        else:
            parent = np.searchsorted(code, below[0] >> 16 << 8 | below[0] & 255)
            weighted = np.logaddexp(own, np.bincount(parent, weights=below[1], minlength=len(code))) - math.log(2)
            w = np.exp(own - weighted) / 2
        made[d], below = (code, z, o, w, weighted), (code, weighted)
    return made


def _near(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """What depths 0 and 1 give the probability of a one, and what they leave to longer contexts, by nearest byte and node."""
    at = rows.column("code").to_numpy()
    z, o, split = (np.bincount(at, weights=rows.column(c).to_numpy(), minlength=1 << 16).reshape(256, 256) for c in ("z", "o", "w"))
    own = _kt_log(z, o)
    weighted = np.logaddexp(own, split) - math.log(2)
    w = np.where(z + o > 0, np.exp(own - weighted) / 2, 0.0)
    z0, o0 = z.sum(axis=0), o.sum(axis=0)
    own0 = _kt_log(z0, o0)
    w0 = np.exp(own0 - np.logaddexp(own0, weighted.sum(axis=0)) + math.log(2)) / 2
    return w0 * (o0 + 0.5) / (z0 + o0 + 1) + (1 - w0) * w * (o + 0.5) / (z + o + 1), (1 - w0) * (1 - w)


def gram_scores(grams: DataFrame) -> DataFrame:
    """(key, m, lp): log10 of the probability of each gram's last byte, from (key, n, m); n counts what is learned from, m all.

    A node that a context has never seen predicts one half with what the
    shorter contexts leave.
    """
    near_two = F.shiftright("key", 8 * (DEPTH - 1))
    dealt = grams.repartition(near_two).sortWithinPartitions("key")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n, _ in _blocks(batches):
            by_depth = _by_depth(keys, n)
            for b in range(8):
                code, z, o, _, weighted = _weighed(by_depth, b)[2]
                yield pa.RecordBatch.from_arrays([pa.array(code >> 16 << 8 | code & 255), pa.array(z), pa.array(o), pa.array(weighted)], ["code", "z", "o", "w"])

    sums = dealt.mapInArrow(weigh, "code long, z double, o double, w double").groupBy("code").agg(*[F.sum(c).alias(c) for c in "zow"])
    near = grams.sparkSession.sparkContext.broadcast(_near(sums.toArrow()))

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_fixed, near_left = near.value
        for keys, n, m in _blocks(batches):
            by_depth, lp = _by_depth(keys, n), np.zeros(len(keys))
            for b in range(8):
                nodes, node = _weighed(by_depth, b), (256 | keys & 255) >> (8 - b)
                p, left = near_fixed[keys >> 8 * DEPTH, node], near_left[keys >> 8 * DEPTH, node]
                deeper = np.arange(len(keys))
                for d in range(2, DEPTH + 1):
                    code, z, o, w, _ = nodes[d]
                    if not len(code):
                        break
                    wanted = keys[deeper] >> 8 * (DEPTH - d + 1) << 8 | node[deeper]
                    i = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
                    seen = code[i] == wanted
                    deeper, i = deeper[seen], i[seen]
                    p[deeper] += left[deeper] * w[i] * (o[i] + 0.5) / (z[i] + o[i] + 1)
                    left[deeper] *= 1 - w[i]
                p = np.clip(p + left / 2, 1e-12, 1 - 1e-12)
                lp += np.log10(np.where(keys >> (7 - b) & 1, p, 1 - p))
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (keys, m, lp)], ["key", "m", "lp"])

    return dealt.mapInArrow(mix, "key long, m long, lp double")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by six."""
    y = x + 6
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def _kt_log(z: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of z zeros and o ones in any fixed order."""
    out = np.zeros_like(z)
    used = (z + o) > 0
    z, o = z[used], o[used]
    out[used] = _log_gamma(z + 0.5) + _log_gamma(o + 0.5) - _log_gamma(z + o + 1.0) - math.log(math.pi)
    return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: base_score of a unigram and score of the context tree, log10.

    Null and empty texts consist of their end only. A null id counts as an
    empty one for the fold. Rows that share an id are scored one by one. With
    no training rows the tree predicts every bit by one half. Also returned:
    bits_per_byte, the code length of a text per byte of its stream.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (fold == HELD_OUT).alias("held_out"))
    counts = scratch_table(count(d), "lm-counts")
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    n_tokens, vocabulary = (sums[1]["n"], sums[1]["v"]) if 1 in sums else (0, 0)
    grams = counts.filter("kind <> 1").groupBy("key").agg(F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("m"))
    n_bytes = sum(r["n"] for kind, r in sums.items() if kind != 1)
    grams = scratch_table(gram_scores(grams), "lm-grams").withColumn("k", F.ceil(F.log2(F.lit(n_bytes) / F.col("m"))))
    # how many grams there are by the power of two of their share: a few rows
    found = {r["k"]: r["count"] for r in grams.groupBy("k").count().collect()}
    k = max((k for k in found if sum(n for j, n in found.items() if j <= k) <= COMMON_GRAMS), default=-1)
    frequent = grams.filter(F.col("k") <= k).orderBy("key").select("key", "lp").toArrow()
    words = counts.filter("kind = 1").select(F.col("key").alias("h"), F.col("n").alias("c"))
    common = words.filter(F.col("c") * (1 << COMMON_WORDS) >= n_tokens).orderBy("h").toArrow()
    model = spark.sparkContext.broadcast((frequent.column("key").to_numpy(), frequent.column("lp").to_numpy(), common.column("h").to_numpy(), common.column("c").to_numpy()))
    log_total = math.log10(n_tokens + vocabulary + 1)
    fields = "rid long, kind int, h long, n int, doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base double, score double"
    names = [x.split()[0] for x in fields.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_k, common_lp, common_h, common_c = model.value

        def pairs(kind: int, rid: np.ndarray, owner: np.ndarray, key: np.ndarray, of: np.ndarray) -> Iterator[pa.RecordBatch]:
            """What is joined: (document, word or gram), counted."""
            pair, n = np.unique(owner * len(key) + of, return_counts=True)
            for i in range(0, len(pair), 100_000):
                p = pair[i : i + 100_000]
                empty = [pa.nulls(len(p), k) for k in kinds[4:]]
                yield pa.RecordBatch.from_arrays([pa.array(rid[p // len(key)]), pa.array(np.full(len(p), kind, np.int32)), pa.array(key[p % len(key)]), pa.array(n[i : i + 100_000].astype(np.int32)), *empty], names)

        for rows in (part.to_pydict() for batch in batches for _, part in slices(batch, "text", CHUNK)):
            docs = [tokens(t) for t in rows["text"]]
            m = len(docs)
            buf, at, doc = _stream(docs)
            gram, of = np.unique(_grams(buf, at), return_inverse=True)
            i = np.minimum(np.searchsorted(common_k, gram), max(len(common_k) - 1, 0))
            sent = common_k[i] == gram if len(common_k) else np.zeros(len(gram), bool)
            lp = np.zeros(len(gram))
            lp[sent] = common_lp[i[sent]]
            score = np.bincount(doc, weights=lp[of], minlength=m)
            n_bytes = np.bincount(doc, minlength=m)
            lens = np.fromiter(map(len, docs), np.int64, m)
            flat = [w for d in docs for w in d]
            ids = {w: i for i, w in enumerate(dict.fromkeys(flat))}
            token = np.fromiter(map(ids.__getitem__, flat), np.int64, len(flat))
            owner = np.repeat(np.arange(m), lens)
            h = word_hash(list(ids))
            c = np.zeros(len(h), np.int64)
            if len(common_h):
                i = np.minimum(np.searchsorted(common_h, h), len(common_h) - 1)
                c = np.where(common_h[i] == h, common_c[i], 0)
            known = c > 0
            base = np.bincount(owner, weights=np.where(known, np.log10(c + 1.0), 0.0)[token], minlength=m) - lens * log_total
            n_known = np.bincount(owner, weights=known[token], minlength=m).astype(np.int64)
            rid = np.array(rows["rid"], np.int64)
            # a row for each document; its h fits no word and spreads these rows over the join
            nothing = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid), pa.array(np.zeros(m, np.int32)), nothing, pa.nulls(m, pa.int32()), pa.array(rows["doc_id"], pa.int64()), pa.array(rows["held_out"]), pa.array(lens), pa.array(n_known), pa.array(n_bytes), pa.array(base), pa.array(score)],
                names,
            )
            rare = ~known[token]
            yield from pairs(1, rid, owner[rare], h, token[rare])
            rare = ~sent[of]
            yield from pairs(2, rid, doc[rare], gram, of[rare])

    d = d.withColumn("rid", F.monotonically_increasing_id()).withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = d.mapInArrow(run, fields)
    rare = words.filter(F.col("c") * (1 << COMMON_WORDS) < n_tokens).select(F.col("h").alias("k"), F.lit(1).alias("kind"), F.log10(F.col("c") + 1.0).alias("v"))
    rare = rare.unionByName(grams.filter(F.col("k") > k).select(F.col("key").alias("k"), F.lit(2).alias("kind"), F.col("lp").alias("v")))
    # rows of documents get a key of their own, so that they don't meet in one task
    j = scored.withColumn("k", F.coalesce("h", F.col("rid"))).join(rare, ["k", "kind"], "left")
    joined = lambda kind, x: F.coalesce(F.sum(F.when((F.col("kind") == kind) & F.col("v").isNotNull(), x)), F.lit(0))
    out = j.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + joined(1, F.col("n").cast("long"))).alias("n_known"),
        F.max("n_bytes").alias("n_bytes"),
        (F.max("base") + joined(1, F.col("n") * F.col("v"))).alias("base_score"),
        (F.max("score") + joined(2, F.col("n") * F.col("v"))).alias("score"),
    )
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte")
    )
