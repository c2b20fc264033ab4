"""Secret scans with a worklist of decoded layers.

Every text is scanned as it stands. Then URL escapes, Unicode escapes and
base64 runs (plain, or holding gzip, zlib, bzip2, xz, lzma, zstd or deflate
data) are unwrapped; each new layer is scanned as well and unwrapped again,
until no new layer comes up. Bytes that aren't UTF-8 become single characters.
Base64 runs are also read across line ends and in all four phases. Compressed
data is looked for at every byte of a decoded run and of unfolded data; streams
that follow one another are read together, as overlapping pieces, and what a
stream has taken is not tried again, so the work grows with the text. Streams
that end too early or break are reported. Layers already seen are not visited
twice, which also ends cycles. Each layer carries, for every character, the
span of the original text that it came from, so that a finding inside nested
layers is reported there.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, renamed, slices

#: Kinds of secrets, in the order in which spans that begin together are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over two lines or more.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:={0,2}\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")


def _zlib_heads() -> bytes:
    """A pattern of the first two bytes of zlib data: all window sizes, without a preset dictionary."""
    heads = []
    for cmf in range(0x08, 0x80, 0x10):
        flags = [f for f in range(256) if (cmf << 8 | f) % 31 == 0 and not f & 0x20]
        heads.append(b"\\x%02x[" % cmf + b"".join(b"\\x%02x" % f for f in flags) + b"]")
    return b"|".join(heads)


#: How gzip, bzip2, xz, zstd, lzma and zlib data begins.
PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\x5d\x00\x00|" + _zlib_heads(), re.DOTALL)
#: Bytes of unfolded data that are scanned at a time; pieces overlap by half.
PIECE = 8 << 20
#: Base64 runs from this length on are decoded one by one, phase by phase.
LONG_RUN = 4096
#: Bytes that a decompressor gets and gives at a time. A zstd block of four bytes can unfold to 128 KB, so it gets few.
FEED, FEED_ZSTD, OUT = 64 << 10, 1 << 10, 1 << 20
#: Characters of documents that are scanned before their findings are given out.
CHUNK = 4 << 20

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """The base patterns: leftmost, non-overlapping per kind."""
    out: list[Span] = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(h in low for h in HINTS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _ordered(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _text(raw: bytes):
    """(text, first byte and end of each character); a byte that isn't UTF-8 is a character of its own."""
    s = raw.decode("utf-8", "surrogateescape")
    kind = np.int32 if len(raw) < 1 << 27 else np.int64  # eight times as many has to fit
    if len(s) == len(raw):
        return s, np.arange(len(s), dtype=kind), np.arange(1, len(s) + 1, dtype=kind)
    cp = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.where((cp >= 0xDC80) & (cp <= 0xDCFF), np.uint8(1), (cp >= 0x80).astype(np.uint8) + (cp >= 0x800) + (cp >= 0x10000) + np.uint8(1))
    ends = np.cumsum(size, dtype=kind)
    return s, ends - size, ends


def _url(run: str):
    s, starts, ends = _text(bytes.fromhex(run.replace("%", "")))
    return s, 3 * starts, 3 * ends


def _escapes(run: str):
    wide = run[1] == "u"
    step = 6 if wide else 4
    units = [int(run[i + 2 : i + step], 16) for i in range(0, len(run), step)]
    if not wide:
        s, starts, ends = _text(bytes(units))
        return s, step * starts, step * ends
    s = b"".join(u.to_bytes(2, "little") for u in units).decode("utf-16-le", "surrogatepass")
    ends = step * np.cumsum([1 + (c > "\uffff") for c in s])
    return s, np.concatenate(([0], ends[:-1])), ends


def _raw(body: str) -> bytes:
    """Base64 without padding; a last character that is no byte is left out."""
    body = body[: len(body) - (len(body) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _decompressor(head: bytes):
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(lzma.FORMAT_XZ)
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()
    if head[:3] == b"\x5d\x00\x00":
        return lzma.LZMADecompressor(lzma.FORMAT_ALONE)
    return zlib.decompressobj(15)


Stream = Generator[bytes, None, tuple[int, bool]]


def _stream(raw: bytes, at: int, d=None) -> Stream:
    """What the stream that begins at a place holds, part by part; returns (its end, whether it is whole)."""
    d, view, pos = d or _decompressor(raw[at : at + 6]), memoryview(raw), at
    feed = FEED if hasattr(d, "needs_input") or hasattr(d, "copy") else FEED_ZSTD
    left = b""
    try:
        while not d.eof:
            if not left and getattr(d, "needs_input", True):
                left = bytes(view[pos : pos + feed])
                pos += len(left)
                if not left:
                    return pos, False
            out = d.decompress(left) if feed == FEED_ZSTD else d.decompress(left, OUT)
            left = getattr(d, "unconsumed_tail", b"") if feed != FEED_ZSTD else b""
            if out:
                yield out
        return pos - len(d.unused_data), True
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return pos, False
    except Exception as e:  # zstandard raises a class of its own
        if type(e).__name__ != "ZstdError":
            raise
        return pos, False


def _chain(raw: bytes, at: int) -> Stream:
    """What streams that follow one another hold; returns (the end of the last whole one, whether none broke)."""
    while True:
        given = False
        end, whole = 0, False
        stream = _stream(raw, at)
        while True:
            try:
                part = next(stream)
            except StopIteration as done:
                end, whole = done.value
                break
            given = True
            yield part
        if not whole:
            return at, not given
        at = end
        if not PACKED.match(raw, at):
            return at, True


def unfolded(raw: bytes, cut: list, deflate: bool) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(place, parts) of all packed data in some bytes; each has to be read before the next. ``cut`` gets the places of what breaks.

    ``deflate``: the bytes as a whole are tried as a stream without a head.
    """
    state = {"end": 0}

    def parts(first: bytes, rest: Stream, at: int) -> Iterator[bytes]:
        yield first
        end, whole = yield from rest
        state["end"] = max(end, at + 1)
        if not whole:
            cut.append(at)

    at = 0
    while (m := PACKED.search(raw, at)) is not None:
        state["end"] = m.start() + 1
        stream = _chain(raw, m.start())
        first = next(stream, None)
        if first is not None:  # most that begin alike hold nothing
            yield m.start(), parts(first, stream, m.start())
        at = state["end"]
    if deflate and raw:
        held, stream, whole = [], _stream(raw, 0, zlib.decompressobj(-15)), False
        while len(held) < 64:
            try:
                held.append(next(stream))
            except StopIteration as done:
                whole = done.value[1]
                break
        if whole and held:  # other bytes seldom end as a stream does
            yield 0, iter(held)
        elif len(held) == 64:
            yield 0, itertools.chain(held, stream)


def _pieces(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The parts as pieces of PIECE bytes or less, each with half of the one before."""
    held, size, fresh = [], 0, False
    for part in parts:
        held.append(part)
        size, fresh = size + len(part), True
        if size >= PIECE:
            piece = b"".join(held)
            yield piece
            held, size, fresh = [piece[-(PIECE // 2) :]], PIECE // 2, False
    if fresh:
        yield b"".join(held)


def _base64(run: str):
    """Only a run that is UTF-8 takes the run's place; Layer.pieces has the others."""
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        return None
    raw = _raw(body)
    try:
        raw.decode()
    except UnicodeDecodeError:
        return None
    s, starts, ends = _text(raw)
    return s, starts * 8 // 6, -(-ends * 8 // 6)


DECODERS = ((lambda t: "%" in t, URL, _url), (lambda t: "\\" in t, ESCAPES, _escapes), (lambda t: True, BASE64, _base64))


class _Line:
    """The places of a run without gaps."""

    def __init__(self, start: int):
        self.start = start

    def __getitem__(self, i):
        return i + self.start


class Layer:
    """A text and, for each character, its span of the original text (None: itself); ``raw`` are the bytes of unfolded data."""

    def __init__(self, text: str, starts=None, ends=None, raw: bytes | None = None):
        self.text, self.starts, self.ends, self.raw = text, starts, ends, raw

    def origin(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (int(self.starts[a]), int(self.ends[b - 1]))

    def unwrap(self, rx: re.Pattern, decode) -> Layer | None:
        """The layer with every run of ``rx`` decoded; None if none can be."""
        found = [(m, x) for m in rx.finditer(self.text) if (x := decode(m[0])) is not None]
        if not found:
            return None
        n = len(self.text)
        s0 = np.arange(n) if self.starts is None else self.starts
        e0 = np.arange(1, n + 1) if self.ends is None else self.ends
        texts, starts, ends, at = [], [], [], 0
        for m, (s, a, b) in found:
            i, j = m.span()
            texts += [self.text[at:i], s]
            starts += [s0[at:i], s0[np.minimum(i + a, j - 1)]]
            ends += [e0[at:i], e0[np.minimum(i + b, j) - 1]]
            at = j
        return Layer("".join([*texts, self.text[at:]]), np.concatenate([*starts, s0[at:]]), np.concatenate([*ends, e0[at:]]))

    def runs(self) -> Iterator[tuple[str, np.ndarray | _Line, int]]:
        """Base64 runs, in one line and across lines: (characters, their places, end)."""
        for m in BASE64.finditer(self.text):
            yield m[0].rstrip("="), _Line(m.start()), m.end()
        for m in WRAPPED.finditer(self.text):
            chars = np.frombuffer(m[0].encode(), np.uint8)
            at = np.flatnonzero(~np.isin(chars, np.frombuffer(b"=\r\n\t ", np.uint8))).astype(np.int32)
            yield chars[at].tobytes().decode(), at + m.start(), m.end()

    def inner(self, cut: list) -> Iterator[Layer]:
        """All layers that are one step further in; ``cut`` gets the spans of packed data that breaks."""
        for wanted, rx, decode in DECODERS:
            if wanted(self.text) and (new := self.unwrap(rx, decode)) is not None:
                yield new
        texts, starts, ends = [], [], []
        for body, at, end in self.runs():
            for phase in range(4):
                raw = _raw(body[phase:])
                s, a, b = _text(raw)
                a, b = self._firsts(at[phase + a * 8 // 6]), self._lasts(at[phase - (-b * 8 // 6) - 1])
                if len(body) >= LONG_RUN:
                    yield Layer(s, a, b)
                elif s:
                    texts += [s, "\0"]
                    starts += [a, a[-1:]]
                    ends += [b, b[-1:]]
                del s, a, b
                yield from self._packed(raw, lambda k, at=at, phase=phase, end=end: self.origin(int(at[phase + k * 8 // 6]), end), cut, phase == 0)
        if texts:
            yield Layer("".join(texts), np.concatenate(starts), np.concatenate(ends))
        if self.raw:
            yield from self._packed(self.raw, lambda _: self.origin(0, len(self.text)), cut, False)

    def _packed(self, raw: bytes, origin, cut: list, deflate: bool) -> Iterator[Layer]:
        """The unfolded data in some bytes; ``origin`` has the span of what begins at a place."""
        broken: list[int] = []
        for k, parts in unfolded(raw, broken, deflate):
            a, b = origin(k)
            for piece in _pieces(parts):
                text = piece.decode("utf-8", "surrogateescape")
                yield Layer(text, np.broadcast_to(a, len(text)), np.broadcast_to(b, len(text)), piece)
        cut += [origin(k) for k in broken]

    def _firsts(self, at: np.ndarray) -> np.ndarray:
        return at if self.starts is None else self.starts[at]

    def _lasts(self, at: np.ndarray) -> np.ndarray:
        return at + 1 if self.ends is None else self.ends[at]


def find(text: str | None, cut: list | None = None) -> tuple[list[Span], list[Span]]:
    """(spans of the text itself, those and the spans of all its layers); ``cut`` gets the spans of packed data that breaks."""
    text, cut = text or "", [] if cut is None else cut
    base = _ordered(scan(text))
    # layers are made one by one, so that of a long stream only a piece is held
    spans, seen, todo = set(base), set(), [Layer(text).inner(cut)]
    while todo:
        new = next(todo[-1], None)
        if new is None:
            todo.pop()
        elif new.text:
            # the same text may stand in several places
            key = hashlib.blake2b(repr(new.origin(0, len(new.text))).encode() + new.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if key not in seen:
                seen.add(key)
                spans.update((k, *new.origin(a, b)) for k, a, b in scan(new.text))
                todo.append(new.inner(cut))
            del new
    return base, _ordered(spans)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256, all spans, and the number of packed streams that break or end too early.

    Of such a stream all is scanned that can be read. A null or empty text has no spans. Rows are independent of each other.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cut long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch, "text", CHUNK):
                cuts: list[list] = [[] for _ in range(part.num_rows)]
                found = [find(t.as_py(), c) for t, c in zip(part.column(1), cuts, strict=True)]
                counts = [pa.array([sum(k == x for x, _, _ in b) for b, _ in found], pa.int64()) for k in KINDS]
                digests = pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digests, pa.array([listed(a) for _, a in found], pa.string()), pa.array([len(set(c)) for c in cuts], pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cut"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret's span replaced by its kind in brackets.

    Overlapping spans are replaced together, under the first one's kind. A null
    text stays null. All columns stay, whatever their names; no row is dropped.
    """
    at = docs.columns.index(text_col)
    rows = numbered(docs).drop("rid")

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, last, end = [], 0, -1
        for kind, a, b in find(text)[1]:
            if a >= end:
                out += [text[last:a], f"[{kind}]"]
            last = end = max(end, b)
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch, f"c{at}", CHUNK):
                texts = pa.array([clean(t.as_py()) for t in part.column(at)], pa.string())
                yield part.set_column(at, f"c{at}", texts)

    return renamed(rows.mapInArrow(run, rows.schema), docs)
