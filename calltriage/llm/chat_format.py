"""Chat formatting into windows with a token budget.

The turns of a conversation, in order, are cut into spans of whole turns: the
prefix sums of their tokens decide how many fit a window. A leading system
turn is retained in every window, and a window after the first repeats the
last turns before it, up to a small budget. The loss covers the assistant
texts of a window's own span; the retained and the repeated turns are masked,
so that each assistant text is a target once.

Conversations are streamed through sorted partitions: a task holds one window
and the repeated history, never a whole conversation. A long conversation is
dealt out in segments of SEGMENT turn numbers, which begin with the system turn
and the last turns of the segment before, as any later window does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_table, slices
from .packing import encoder

#: Tokens of a window, and of the history that it repeats.
BUDGET = 512
HISTORY = 96
#: Turn numbers of a conversation that are formatted in one task.
SEGMENT = 4096
#: Turns at a segment's end that the next one may repeat; more don't fit HISTORY, as marks alone are five tokens.
TAIL = 20
#: Conversations' segments are broadcast up to so many; more are joined by a shuffle.
BROADCAST_SEGMENTS = 1 << 20
#: Characters of turns that are counted at a time.
CHUNK = 2 << 20
#: Strings that mark turns here or in common templates: never left as they are inside a text.
CONTROL = ("<|turn|>", "<|end|>", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
#: A role may hold an escaped line end; a text holds no unescaped mark.
_TURN = re.compile(r"<\|turn\|>((?:\\[\s\S]|[^\\\n])*)\n([\s\S]*?)<\|end\|>\n")
WINDOW_SCHEMA = "conv_id long, segment long, window long, text string, n_context int, n_turns int, loss_start array<int>, loss_end array<int>"


def escape(text: str) -> str:
    """Doubles backslashes and breaks each control string by one."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(a turn in the template, where its text begins and ends in it)."""
    head = f"<|turn|>{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
    body = escape(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) of every turn of a formatted window."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def count_tokens(turns: list[str], tokenizer_path: str | None = None) -> list[int]:
    """The tokens of each formatted turn; without a tokenizer, one for each four UTF-8 bytes, the last ones included.

    A formatted turn ends with a line end, so the tokens of a window are those of its turns.
    """
    if tokenizer_path is None:
        return [-(-len(t.encode("utf-8", "surrogatepass")) // 4) for t in turns]
    return [len(ids) // 4 for ids in encoder(tokenizer_path).encode(turns)]


#: Kinds of rows of a segment: a system turn and turns before that are repeated, its own turns.
HEAD, BEFORE, OWN = 0, 1, 2


@dataclass
class _Turn:
    role: str
    text: str
    tokens: int


class _Windows:
    """Cuts a segment's turns, one by one, into windows; later segments of a conversation have what they repeat first."""

    def __init__(self, conv, segment):
        self.key, self.n, self.seen, self.later, self.system = (conv, segment), 0, 0, False, None
        self.history: list[_Turn] = []
        self.start()

    def start(self) -> None:
        again = self.n or self.later
        self.context, self.span = ([self.system] if self.system and again else []) + (self.history if again else []), []
        self.tokens = sum(t.tokens for t in self.context)

    def repeat(self, kind: int, role: str, text: str, tokens: int) -> None:
        """The system turn (HEAD), then turns of the segment before (BEFORE)."""
        t, self.later = _Turn(role, text, tokens), True
        if kind == HEAD:
            self.system = t
        elif not (self.system and (role, text) == (self.system.role, self.system.text)):
            self.history = _last([*self.history, t])
        self.start()

    def add(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        t = _Turn(role, text, tokens)
        if self.span and self.tokens + t.tokens > BUDGET:
            yield self.close()
        while not self.span and self.history and self.tokens + t.tokens > BUDGET:  # room for the turn goes before history
            self.tokens -= self.history.pop(0).tokens
            self.context = ([self.system] if self.system else []) + self.history
        if self.seen == 0 and role == "system" and not self.later:
            self.system = t
        self.seen += 1
        self.span.append(t)
        self.tokens += t.tokens

    def close(self) -> tuple:
        parts, starts, ends, at = [], [], [], 0
        for i, t in enumerate([*self.context, *self.span]):
            s, a, b = render(t.role, t.text)
            parts.append(s)
            if i >= len(self.context) and t.role == "assistant":
                starts.append(at + a)
                ends.append(at + b)
            at += len(s)
        row = (*self.key, self.n, "".join(parts), len(self.context), len(self.context) + len(self.span), starts, ends)
        self.n += 1
        self.history = _last([t for t in [*self.history, *self.span] if t is not self.system])
        self.start()
        return row


def _last(turns: list[_Turn]) -> list[_Turn]:
    """The last turns that HISTORY has room for."""
    n, size = 0, 0
    for t in reversed(turns):
        size += t.tokens
        if size > HISTORY:
            break
        n += 1
    return turns[len(turns) - n :]


def format_conversations(turns: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row per window, see ``WINDOW_SCHEMA``.

    ``turns`` has conv_id, turn, role and text. Null roles and texts count as
    empty; rows of equal turn numbers are ordered by role and text, and repeated
    rows stay. A null conv_id is a conversation of its own, null turns come
    first. A turn longer than the budget is a window of its own and exceeds it,
    and so does every window of a conversation whose system turn is that long.
    An empty table gives no rows; other columns don't matter.
    """
    e = F.lit("")
    t = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", e).alias("role"), F.coalesce("text", e).alias("text"))
    rows = _with_repeated(t.withColumn("segment", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62)))))
    rows = rows.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "kind", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, rows = None, []
        for batch in batches:
            for _, part in slices(batch, "text", CHUNK):
                convs, segments, kinds, roles, texts = (part.column(c).to_pylist() for c in ("conv_id", "segment", "kind", "role", "text"))
                tokens = count_tokens([render(r, t)[0] for r, t in zip(roles, texts, strict=True)], tokenizer_path)
                for conv, segment, kind, role, text, n in zip(convs, segments, kinds, roles, texts, tokens, strict=True):
                    if open_ is None or open_.key != (conv, segment):
                        rows += [open_.close()] if open_ else []
                        open_ = _Windows(conv, segment)
                    if kind == OWN:
                        rows += open_.add(role, text, n)
                    else:
                        open_.repeat(kind, role, text, n)
                    if len(rows) >= 500:
                        yield _window_batch(rows)
                        rows = []
        rows += [open_.close()] if open_ else []
        if rows:
            yield _window_batch(rows)

    return rows.mapInArrow(run, WINDOW_SCHEMA)


def _with_repeated(turns: DataFrame) -> DataFrame:
    """Adds ``kind``, and to the later segments of long conversations the rows that they repeat."""
    own = turns.withColumn("kind", F.lit(OWN))
    by_conv = Window.partitionBy("conv_id")
    segments = turns.select("conv_id", "segment").distinct()
    segments = segments.withColumns({"next": F.lead("segment").over(by_conv.orderBy("segment")), "first": F.min("segment").over(by_conv)})
    # a row for each segment but the last of a conversation
    followed = scratch_table(segments.filter("next is not null").select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), "next", "first"), "chat-segments")
    n = followed.count()
    if not n:
        return own
    side = F.broadcast(followed) if n <= BROADCAST_SEGMENTS else followed
    order = [F.col(c).desc() for c in ("turn", "role", "text")]
    last = turns.join(side, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")))
    last = last.withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "segment").orderBy(*order))).filter(F.col("r") <= TAIL)
    last = last.select("conv_id", "turn", "role", "text", F.col("next").alias("segment"), F.lit(BEFORE).alias("kind"))
    begun = followed.filter("s = first").select("c", "s")
    begun = turns.join(F.broadcast(begun) if n <= BROADCAST_SEGMENTS else begun, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")))
    begun = begun.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text")).alias("t")).filter("t.role = 'system'").select(F.col("conv_id").alias("c0"), "t.*")
    head = begun.join(side, F.col("c0").eqNullSafe(F.col("c"))).select(F.col("c0").alias("conv_id"), "turn", "role", "text", F.col("next").alias("segment"), F.lit(HEAD).alias("kind"))
    return own.unionByName(last).unionByName(head)


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["conv_id", "segment", "window", "text", "n_context", "n_turns", "loss_start", "loss_end"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, what its formatted windows hold: turns, targets, sizes.

    The windows' own turns (without the first ``n_context``) are parsed from
    the text, the targets cut from it by the loss spans; both are unescaped
    where the windows are. Only the digests need a conversation's windows in
    order, so these are streamed through one task.
    """
    said = "conv_id long, segment long, window long, n_turns long, turns string, loss string, formatted long"

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch, "text", CHUNK):
                rows = part.to_pydict()
                own = [parse(t)[skip:] for t, skip in zip(rows["text"], rows["n_context"], strict=True)]
                turns = ["".join(f"{r}\n{x}\n" for r, x in o) for o in own]
                loss = ["".join(unescape(t[i:j]) for i, j in zip(a, b, strict=True)) for t, a, b in zip(rows["text"], rows["loss_start"], rows["loss_end"], strict=True)]
                made = [pa.array(map(len, own), pa.int64()), pa.array(turns, pa.string()), pa.array(loss, pa.string()), pa.array(map(len, rows["text"]), pa.int64())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("conv_id", "segment", "window")], *made], [x.split()[0] for x in said.split(", ")])

    w = windows.mapInArrow(parsed, said).repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []
        rows: list[tuple] = []

        def finish() -> None:
            if state:
                conv, n, turns, chars, loss, formatted, k = state
                rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, k))

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])
                rows.clear()

        for batch in batches:
            cols = batch.to_pydict()
            for conv, n, turns, loss, formatted in zip(*(cols[c] for c in ("conv_id", "n_turns", "turns", "loss", "formatted")), strict=True):
                if not state or state[0] != conv:
                    finish()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                state[1] += n
                state[2].update(turns.encode("utf-8", "surrogatepass"))
                state[3] += len(loss)
                state[4].update(loss.encode("utf-8", "surrogatepass"))
                state[5] += formatted
                state[6] += 1
            yield from flush()
        finish()
        yield from flush()

    return w.mapInArrow(run, schema)
