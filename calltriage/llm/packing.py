"""Hierarchical multi-length packing of tokenised documents.

Every document is tokenised and cut into full windows of the longest context;
its rest is routed to the tier of the smallest context that holds it. Tiers are
packed from the longest down: a window is opened by the longest waiting rest,
its gap takes the best fitting rests of the same or shorter tiers, and the last
of them is cut so that the window is full. Windows of one tier are dealt to
steps with the same number of tokens, whatever the tier; what is left of a tier
at the end is dealt evenly, so that no step is a small remnant.

Packing happens inside each input partition, as a stream with a bounded number
of waiting tokens: the ids are never shuffled and a lost task repeats the same
windows. A partition's last tokens become windows of shorter powers of two, so
no window has padding.
"""

from __future__ import annotations

import bisect
import itertools
import json
import os
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices

CONTEXT = 1024
#: Tiers with windows of their own; shorter rests wait in the last tier.
TIERS = (1024, 512, 256, 128)
#: Tokens in a step, the same for every tier.
STEP_TOKENS = 16 * 1024
#: Ids that wait for a window in one task.
WAITING_TOKENS = 1 << 20
#: Characters that are encoded at a time.
CHUNK = 2 << 20
#: Encoded words kept by one Python worker, twice at most; longer ones aren't kept.
CACHED_WORDS = 600_000
LONGEST_WORD = 64
#: Marks that are never part of a pre-token with letters.
MARKS = "#%&()*,.:;?|!"
#: Texts that aren't cut: white space in a row, and what marks the cuts.
_RUN = re.compile(r"\s\s|\0")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Encoder:
    """ids of texts by a ``tokenizers`` file, as little-endian unsigned 32-bit bytes.

    In byte-level BPE a space or line end between other characters always
    begins a pre-token, so a text is cut there and equal words are encoded once.
    Texts with several white-space characters in a row, and all texts of other
    kinds of tokenizers, are encoded as a whole. Words that were not used since
    the store last filled up are forgotten.
    """

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        before = parts.get("pre_tokenizer") or {}
        self.by_word = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and parts.get("normalizer") is None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fixed = {"": b"", " ": self._whole(" "), "\n": self._whole("\n")} if self.by_word else {}
        self.cached_words, self.words, self.older = cached_words, dict(self.fixed), {}

    def _whole(self, text: str) -> bytes:
        return _as_bytes(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _learn(self, units: set[str]) -> None:
        """Encodes words that aren't known, many in one go: line ends stand between them.

        Marks after a letter are a pre-token of their own, so words that differ
        by such marks are encoded once.
        """
        plain, marked = {}, []
        for u in units:
            if (ids := self.older.get(u)) is not None:
                self.words[u] = ids
            elif any(x in u for x in self.special):
                self.words[u] = self._whole(u)
            elif u[-1] in MARKS and (stem := u.rstrip(MARKS))[-1:].isalpha():
                marked.append((u, stem, u[len(stem) :]))
                plain[stem] = plain[marked[-1][2]] = None
            else:
                plain[u] = None
        fresh = [u for u in plain if u not in self.words]
        if fresh:
            raw = self._whole("\n".join(fresh))
            stops = np.flatnonzero(np.frombuffer(raw, "<u4") == int.from_bytes(self.fixed["\n"], "little")) * 4
            for u, a, b in zip(fresh, [0, *(stops + 4).tolist()], [*stops.tolist(), len(raw)], strict=True):
                self.words[u] = raw[a:b]
        for u, stem, marks in marked:
            self.words[u] = self.words[stem] + self.words[marks]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        if len(self.words) > self.cached_words:
            self.words, self.older = dict(self.fixed), self.words
        cut = [None if not self.by_word or _RUN.search(t) else t.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") for t in texts]
        missing = set().union(*[u for u in cut if u is not None]).difference(self.words)
        self._learn(missing)
        for text, units in zip(texts, cut, strict=True):
            yield self._whole(text) if units is None else b"".join(map(self.words.__getitem__, units))
        for u in missing:
            if len(u) > LONGEST_WORD:
                self.words.pop(u, None)
                self.words.pop(u.rstrip(MARKS), None)


def _as_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


class Windows:
    """Rests that wait, by length, and the windows made of them."""

    def __init__(self, emit: Callable):
        self.emit, self.rests, self.lengths, self.tokens = emit, {}, [], 0

    def add(self, doc, start: int, ids: memoryview, total: int) -> None:
        """A document's rest of under CONTEXT ids."""
        n = len(ids) // 4
        if n not in self.rests:
            self.rests[n] = deque()
            bisect.insort(self.lengths, n)
        self.rests[n].append((doc, start, ids, total))
        self.tokens += n

    def _take(self, n: int):
        x = self.rests[n].popleft()
        if not self.rests[n]:
            del self.rests[n]
            self.lengths.remove(n)
        self.tokens -= n
        return x

    def _fill(self, size: int) -> None:
        """One full window of ``size`` ids; at least as many have to wait."""
        pieces, gap = [], size
        while gap:
            k = bisect.bisect_right(self.lengths, gap)
            if k:
                doc, start, ids, total = self._take(self.lengths[k - 1])
            else:  # all that wait are longer than the gap: the shortest is cut
                doc, start, ids, total = self._take(self.lengths[0])
                self.add(doc, start + gap, ids[4 * gap :], total)
                ids = ids[: 4 * gap]
            pieces.append((doc, start, ids, total))
            gap -= len(ids) // 4
        self.emit(size, pieces)

    def drain(self, down_to: int) -> None:
        """Makes windows, each of the tier that its longest rest is routed to."""
        while self.tokens > down_to:
            longest = self.lengths[-1]
            size = min((t for t in TIERS if t >= longest), default=CONTEXT)
            if self.tokens < size:
                break
            self._fill(size)

    def finish(self) -> None:
        """What still waits goes to windows of shorter powers of two."""
        self.drain(0)
        while self.tokens:
            self._fill(min(CONTEXT, 1 << (self.tokens.bit_length() - 1)))


class Steps:
    """Deals the windows of each tier to steps of STEP_TOKENS; ``rows`` gets them with their step.

    A step is given out when two are full, and the last windows of a tier are
    halved: all steps but a tier's last two are full, and those two differ by
    one window at most.
    """

    def __init__(self, base: int, rows: list[tuple]):
        self.base, self.rows, self.open, self.given = base, rows, {}, {}

    def add(self, size: int, window: list[tuple]) -> None:
        held = self.open.setdefault(size, [])
        held.append(window)
        full = max(1, STEP_TOKENS // size)
        if len(held) >= 2 * full:
            self._give(size, full)

    def _give(self, size: int, n: int) -> None:
        nth = self.given[size] = self.given.get(size, -1) + 1
        step = self.base | size.bit_length() << 31 | nth
        self.rows += [(*piece, step) for window in self.open[size][:n] for piece in window]
        del self.open[size][:n]

    def finish(self) -> None:
        for size, held in self.open.items():
            if len(held) > max(1, STEP_TOKENS // size):
                self._give(size, -(-len(held) // 2))
            if held:
                self._give(size, len(held))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """One row per piece of every document, see ``SCHEMA``.

    A null or empty text is only its end id. Rows are packed one by one, so a
    repeated id gives as many sets of pieces. An empty table gives no rows.
    ``sequence_id`` is unique over all partitions; ``tier`` is the window's
    length and ``step_group`` its step.
    """
    from pyspark.sql import functions as F

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    end = _as_bytes([end_id])
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(tokenizer_path)
        base = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        steps = Steps(base, rows)
        numbers = itertools.count(base)

        def emit(size: int, pieces: list) -> None:
            window, at, made = next(numbers), 0, []
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                made.append((doc, start, n, zlib.crc32(ids), total, window, at, size))
                at += n
            steps.add(size, made)

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                rows.clear()
                yield pa.RecordBatch.from_arrays(cols, names)

        waiting = Windows(emit)
        for batch in batches:
            for _, texts in slices(batch, "text", CHUNK):
                part = texts.to_pydict()
                for doc, ids in zip(part["doc_id"], of.encode([t or "" for t in part["text"]]), strict=True):
                    view = memoryview(ids + end)
                    total = len(view) // 4
                    full = total - total % CONTEXT
                    for s in range(0, full, CONTEXT):
                        emit(CONTEXT, [(doc, s, view[4 * s : 4 * (s + CONTEXT)], total)])
                    if full < total:
                        waiting.add(doc, full, memoryview(bytes(view[4 * full :])), total)
                if waiting.tokens > WAITING_TOKENS:
                    waiting.drain(WAITING_TOKENS // 2)
            yield from flush()
        waiting.finish()
        steps.finish()
        yield from flush()

    return source.mapInArrow(run, SCHEMA)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
