"""Token counts of whole texts; the ids themselves never leave the task.

Texts are cut only at safe boundaries: places between two characters that no
entry of the vocabulary holds next to each other, so that no token can span
them. Every space after another character is one, every line end and, in long
runs without spaces, many other places. Equal pieces are encoded once; the
pieces that are not known yet go to the tokenizer in batches of about the same
number of bytes, and only their lengths are kept. Tokenizers of other kinds
(``.json``) encode whole texts in such batches.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
#: Bytes of texts that are counted at a time; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Bytes in one call of the tokenizer.
BATCH_BYTES = 64 << 10
#: Characters of a long text that are cut into pieces at a time, and of a piece from which on it is cut further.
WINDOW, LONG_PIECE = 1 << 20, 2048
#: Counted pieces that one Python worker remembers; longer pieces aren't kept.
CACHED_PIECES, LONGEST_CACHED = 500_000, 64
#: Spaces and what follows them, or a line end and what follows it.
_PIECE = re.compile(r" +[^ \n]*|\n[^ \n]*")
SPACE = "▁"


def balanced(texts: list[str], size: int = BATCH_BYTES) -> Iterator[list[str]]:
    """The texts in batches of up to ``size`` bytes; a longer text is alone."""
    batch, held = [], 0
    for t in texts:
        n = len(t.encode())
        if batch and held + n > size:
            yield batch
            batch, held = [], 0
        batch.append(t)
        held += n
    if batch:
        yield batch


def byte_slices(batch: pa.RecordBatch, text: str, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of consecutive rows with about ``size`` bytes of a column each; one row at least."""
    ends = np.cumsum(np.array(pc.coalesce(pc.binary_length(batch.column(text)), 0), np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, end - at)
        at = end


class WholeTexts:
    """Counts by a ``tokenizers`` file, of whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def count(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for batch in balanced(texts) for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]


class Pieces:
    """Counts by a sentencepiece model, of texts cut at safe boundaries.

    The tokenizer writes a space as a mark, and puts one before each text it
    gets. A piece after a space is therefore given without that space. Other
    pieces are given behind a line end, which merges with nothing, and the two
    tokens of the mark and the line end are taken off.
    """

    def __init__(self, path: str, cached: int = CACHED_PIECES):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.cached, self.known = cached, {}
        words = (self.model.id_to_piece(i) for i in range(len(self.model)))
        self.pairs = np.unique(np.concatenate([self._pairs(w) for w in words]))
        # cuts need a mark that only begins pieces, and a line end that stands alone
        marks = self.pairs & 0x1FFFFF == ord(SPACE)
        alone = not np.isin([ord("\n")], np.concatenate([self.pairs >> 21, self.pairs & 0x1FFFFF])).any()
        self.by_piece = bool(alone and (self.pairs[marks] >> 21 == ord(SPACE)).all() and self._lengths(["\n"]) == [2] and self.model.piece_to_id(SPACE) != self.model.unk_id())

    @staticmethod
    def _pairs(text: str) -> np.ndarray:
        """Each character with its next one, as one number; a space counts as the mark."""
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        c[c == 0x20] = ord(SPACE)
        return c[:-1] << 21 | c[1:]

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def _cuts(self, text: str, size: int) -> Iterator[str]:
        """Parts of ``size`` characters or more, each up to a safe boundary."""
        at = 0
        while at < len(text):
            end, step = at + size, 4096
            while end < len(text):
                safe = np.flatnonzero(~np.isin(self._pairs(text[end - 1 : end + step]), self.pairs))
                if len(safe):
                    end += int(safe[0])
                    break
                end += step
            yield text[at:end]
            at = end

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """A text's pieces, window by window. Each begins with a space or a line end; one that is put there has a second."""
        text = " " + text.replace(SPACE, " ")
        for part in self._cuts(text, WINDOW) if len(text) > WINDOW else [text]:
            pieces = _PIECE.findall(part if part[0] in " \n" else "\n" + part)
            if part[0] not in " \n":
                pieces[0] = "\n" + pieces[0]
            yield pieces

    def _learn(self, pieces: set[str]) -> None:
        """Counts of pieces that aren't known."""
        parts: dict[str, tuple[int, int]] = {}  # to encode: what is taken off the sum, and how often it is used
        longer: dict[str, list[str]] = {}

        def asked(piece: str) -> str:
            # " x": x alone; "\nx": the mark is taken off; "\n\nx": x has nothing before it
            return piece[1:] if piece[0] == " " or piece[:2] == "\n\n" and len(piece) > 2 else piece

        for p in pieces:
            if p == " ":
                self.known[p] = 1
            elif len(p) > LONG_PIECE:
                longer[p] = [x if i == 0 else "\n\n" + x for i, x in enumerate(self._cuts(p, LONG_PIECE))]
            else:
                parts[p] = (0, 0)
        for xs in longer.values():
            parts.update((x, (0, 0)) for x in xs if x not in self.known)
        todo = list(parts)
        counts = [n for batch in balanced([asked(p) for p in todo]) for n in self._lengths(batch)]
        for p, n in zip(todo, counts, strict=True):
            self.known[p] = n - (0 if p[0] == " " else 2 if p[:2] == "\n\n" and len(p) > 2 else 1)
        for p, xs in longer.items():
            self.known[p] = sum(map(self.known.__getitem__, xs))
        self.fresh += [p for p in (*todo, *longer) if len(p) > LONGEST_CACHED]

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; an empty text has none."""
        if not self.by_piece:
            return [n for batch in balanced(texts) for n in self._lengths(batch)]
        if len(self.known) > self.cached:
            self.known = {}
        out, held, self.fresh = [], [], []
        for text in texts:
            if len(text) >= WINDOW:  # window by window, as its pieces take many times its bytes
                total = 0
                for pieces in self._pieces(text):
                    total += self._sum(pieces)
                out.append(total)
            elif text:
                held.append((len(out), next(self._pieces(text))))
                out.append(0)
            else:
                out.append(0)
        self._learn(set().union(*[p for _, p in held]).difference(self.known))
        for i, pieces in held:
            out[i] = sum(map(self.known.__getitem__, pieces))
        for p in self.fresh:
            self.known.pop(p, None)
        return out

    def _sum(self, pieces: list[str]) -> int:
        self._learn(set(pieces).difference(self.known))
        return sum(map(self.known.__getitem__, pieces))


def counter(path: str):
    """Counts by the library that reads the file."""
    return Pieces(path) if path.endswith(".model") else WholeTexts(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: its id, n_bytes, n_tokens, and whether there are more than ``limit``.

    ``path`` names a vocabulary file that all executors have. No begin, end or
    special tokens are added, and their strings in a text are treated as the
    library does by default. A null or empty text has no bytes and no tokens. Rows
    are independent of each other, repeated ones included; an empty table gives
    none; other columns, whatever their names, don't matter. A text of any
    length is counted in one task, in windows of bounded memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_BYTES):
                n = c.count(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    schema = rows.select("id", "n_bytes", F.lit(0).cast("long").alias("n_tokens")).schema
    out = rows.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
