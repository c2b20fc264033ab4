"""Rolling texts as runs: the text of a session's consecutive chunks once, and the window of it that each chunk sees.

Consecutive rolling texts are almost the same, so what they share is worked on
once: words between spaces are split into tokens once and counted in and out of
the windows, and a sentence with an anchor is searched by the rules once for
all windows that hold all of it. Only the beginnings and ends that a window
cuts are looked at on their own.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import signatures
from ..operators.termmodel import TermModel, _find
from ..operators.textmodel import word_tokens

#: Chunks and new characters of a run at most.
CHUNKS, CHARS = 256, 1 << 16
#: Windows that are scored together.
WINDOWS = 1 << 14
#: Of each window: its chunk; its place in the text; its pieces, and the one it cuts; its sentences with an anchor, and those cut at its begin and end.
LISTS = {"seq": "long", "us": "long", "late": "boolean", "first": "boolean", "a": "int", "b": "int", "p0": "int", "p1": "int", "cut": "int", "s0": "int", "s1": "int", "head": "int", "tail": "int"}
RUNS = f"session_id long, text string, pieces array<string>, n_main int, sentences array<string>, {', '.join(f'{c} array<{t}>' for c, t in LISTS.items())}"
COLUMNS = [c.split()[0] for c in RUNS.split(", ")]
FLAT = "session_id long, seq long, us long, n_chars int, text_score double, mask int, late boolean, first boolean"
NO_TIME = -(1 << 63)


def micros(ts: Column) -> Column:
    return F.coalesce(F.unix_micros(ts), F.lit(NO_TIME)).alias("us")


def time(us: Column) -> Column:
    return F.when(us != NO_TIME, F.timestamp_micros(us)).alias("ts")


def applies(text_score, rules) -> bool:
    """Whether windows can be scored together: by a model of words, or none, and rules that search sentences with an anchor."""
    return (text_score is None or isinstance(text_score, TermModel) and not text_score.dictionary.tree) and all(r.anchors and r.one_sentence for r in rules)


def anchors(rules) -> tuple[str, ...]:
    return tuple(sorted({a for r in rules for a in r.anchors}))


@cache
def _patterns(found: tuple[str, ...]) -> tuple[re.Pattern, re.Pattern]:
    plain = "|".join(map(re.escape, found)) or r"(?!)"
    return re.compile(plain), re.compile(plain.replace("i", "[iıİ]"), re.IGNORECASE)


def _zones(text: str, found: tuple[str, ...]) -> list[tuple[int, int]]:
    """Where anchors stand; another one can only stand in a sentence that one of these touches."""
    plain, odd = _patterns(found)
    return [m.span() for m in (plain.finditer(text.lower()) if text.isascii() else odd.finditer(text))]


def _sentences(text: str, windows: list[tuple[int, int]], found: tuple[str, ...]) -> tuple[list[str], list[list[int]]]:
    """(the stretches that rules have to search, of each window: the first and last whole sentence among them, the one cut at its begin, the one at its end)."""
    zones = _zones(text, found)
    if not zones:
        return [], [[0] * len(windows), [0] * len(windows), [-1] * len(windows), [-1] * len(windows)]
    begins, ends = [x for x, _ in zones], [y for _, y in zones]

    def touched(s: int, e: int) -> bool:
        k = bisect_right(ends, s)
        return s < e and k < len(ends) and begins[k] < e

    stops = [m.start() for m in re.finditer("[.?!]", text)]
    first, last = [0, *[x + 1 for x in stops]], [*stops, len(text)]
    kept = [(s, e) for s, e in zip(first[:-1], stops, strict=True) if touched(s, e)]
    own_first, own_last = [s for s, _ in kept], [e for _, e in kept]
    number = {se: k for k, se in enumerate(kept)}

    def stretch(s: int, e: int) -> int:
        return number.setdefault((s, e), len(number)) if touched(s, e) else -1

    out: list[list[int]] = [[], [], [], []]
    for a, b in windows:
        out[0].append(bisect_left(own_first, a))
        out[1].append(max(out[0][-1], bisect_left(own_last, b)))
        k = bisect_right(first, a) - 1
        out[2].append(stretch(a, min(last[k], b)) if first[k] < a else -1)
        k = bisect_right(first, b) - 1
        out[3].append(stretch(max(first[k], a), b))
    return [text[s:e] for s, e in number], out


def _run(text: str, windows: list[tuple[int, int]], found: tuple[str, ...]) -> dict:
    pieces = text.split(" ")
    starts = np.cumsum([0, *[len(p) + 1 for p in pieces[:-1]]])
    a, b = np.array(windows, np.int64).T
    p0, p1 = np.searchsorted(starts, a), np.searchsorted(starts, b)
    cut, known = np.full(len(a), -1), {}
    for k in np.flatnonzero((starts[np.minimum(p0, len(starts) - 1)] != a) & (a < b)):
        x, end = int(a[k]), int(starts[p0[k] - 1] + len(pieces[p0[k] - 1]))
        if x < end:
            cut[k] = len(pieces) + known.setdefault(x, (len(known), text[x:end]))[0]
    suffixes = [t for _, t in known.values()]
    sentences, (s0, s1, head, tail) = _sentences(text, windows, found)
    return {"pieces": pieces + suffixes, "n_main": len(pieces), "sentences": sentences, "a": a, "b": b, "p0": p0, "p1": p1, "cut": cut, "s0": s0, "s1": s1, "head": head, "tail": tail}


def runs(session, transcript: str, last: int, begins: bool, chunks: pd.DataFrame, found: tuple[str, ...] | None, s: Settings = Settings()) -> tuple[pd.DataFrame, str, int]:
    """(the runs of a session's chunks, in order, its text and its last chunk after them); without anchors given, the texts as they are.

    Each step is that of ``next_transcript``: the chunk behind a space, white space stripped, the last characters kept.
    """
    rows, seqs, times, said = [], chunks["seq"].tolist(), chunks["us"].astype("int64").tolist(), chunks["chunk"].tolist()
    at = 0
    while at < len(seqs):
        text, a, own = transcript, 0, {"seq": [], "us": [], "late": [], "first": []}
        windows, room = [], len(transcript) + CHARS
        while at < len(seqs) and len(windows) < CHUNKS and len(text) < room:
            late = seqs[at] <= last
            own["seq"].append(seqs[at])
            own["us"].append(times[at])
            own["late"].append(late)
            own["first"].append(begins and not late)
            if not late:
                chunk = said[at] or ""
                text += (" " + chunk).rstrip() if text else chunk.strip()
                while a < len(text) and text[a].isspace():
                    a += 1
                a, last, begins = max(a, len(text) - s.rolling_chars), seqs[at], False
            windows.append((a, len(text)))
            at += 1
        made = {"text": "", **_run(text, windows, found)} if found is not None else {c: [] for c in ("pieces", "sentences", *LISTS)} | {"text": text, "n_main": 0, "a": [x for x, _ in windows], "b": [y for _, y in windows]}
        rows.append({"session_id": session, **made, **own})
        transcript = text[a:]
    return pd.DataFrame({c: [r[c] for r in rows] for c in COLUMNS}), transcript, int(last)


def texts(made: DataFrame, *kept: str) -> DataFrame:
    """Runs with texts as one row for each chunk, with the rolling text there."""
    x = made.select("session_id", "text", F.explode(F.arrays_zip("seq", "us", "a", "b", "late", "first")).alias("x"))
    return x.select("session_id", "x.seq", time(F.col("x.us")), F.substring(F.col("text"), F.col("x.a") + 1, F.col("x.b") - F.col("x.a")).alias("transcript"), "x.late", *[f"x.{c}" for c in kept])


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.list_flatten(batch.column(name)).to_numpy(zero_copy_only=False)


def _masks(batch: pa.RecordBatch, run: np.ndarray, n_rules: int) -> np.ndarray:
    """The rules found in each window, as bits."""
    sizes = np.asarray(pc.list_value_length(batch.column("masks"))).astype(np.int64)
    masks, off = _flat(batch, "masks").astype(np.int64), (np.cumsum(sizes) - sizes)[run]
    if not len(masks):
        return np.zeros(len(run), np.int64)
    bits = np.zeros((len(masks) + 1, n_rules), np.int64)
    bits[1:] = np.cumsum(masks[:, None] >> np.arange(n_rules) & 1, axis=0)
    out = ((bits[off + _flat(batch, "s1")] > bits[off + _flat(batch, "s0")]) << np.arange(n_rules)).sum(axis=1)
    for name in ("head", "tail"):
        k = _flat(batch, name)
        out[k >= 0] |= masks[(off + k)[k >= 0]]
    return out


def _scores(batch: pa.RecordBatch, run: np.ndarray, model: TermModel) -> np.ndarray:
    """The model's score of each window's text, as ``TermModel.score`` has it: terms are counted into the windows and out of them."""
    d, n_windows = model.dictionary, len(run)
    sizes = np.asarray(pc.list_value_length(batch.column("tokens"))).astype(np.int64)
    off, pieces = np.cumsum(sizes) - sizes, pc.list_flatten(batch.column("tokens"))
    of_run = np.repeat(np.arange(len(sizes)), sizes)
    main_piece = np.arange(len(of_run)) - off[of_run] < np.asarray(batch.column("n_main"))[of_run]
    each = np.asarray(pc.fill_null(pc.list_value_length(pieces), 0)).astype(np.int64)
    piece = np.repeat(np.arange(len(each)), each)
    word = np.asarray(pc.fill_null(pc.index_in(pc.list_flatten(pieces), value_set=d.words), -1)).astype(np.int64)
    p0, p1 = off[run] + _flat(batch, "p0"), off[run] + _flat(batch, "p1")
    # (run, term, first window with it, first window without it)
    found = []

    def put(term: np.ndarray, first: np.ndarray, end: np.ndarray, whose: np.ndarray) -> None:
        ok = (term >= 0) & (first < end)
        found.append((whose[ok], term[ok], first[ok], end[ok]))

    def pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = np.where((x >= 0) & (y >= 0), _find(d.pairs, x * len(d.words) + y), -1)
        return np.append(d.pair_terms, -1)[k]

    t, p = word[main_piece[piece]], piece[main_piece[piece]]
    first, end, whose = np.searchsorted(p1, p, "right"), np.searchsorted(p0, p, "right"), of_run[p]
    put(d.single[t], first, end, whose)
    same = whose[1:] == whose[:-1]
    put(pair(t[:-1], t[1:])[same], first[1:][same], end[:-1][same], whose[1:][same])
    k = np.flatnonzero(_flat(batch, "cut") >= 0)
    if len(k):  # a word that a window cuts, and the pair with the next one
        q = off[run[k]] + _flat(batch, "cut")[k]
        token_at = np.cumsum(each) - each
        window = np.repeat(k, each[q])
        at = np.repeat(token_at[q] - (np.cumsum(each[q]) - each[q]), each[q]) + np.arange(len(window))
        put(d.single[word[at]], window, window + 1, run[window])
        inner = window[1:] == window[:-1]
        put(pair(word[at[:-1]], word[at[1:]])[inner], window[1:][inner], window[1:][inner] + 1, run[window[1:][inner]])
        k, q = k[each[q] > 0], q[each[q] > 0]
        nxt = np.searchsorted(p, p0[k])
        inside = np.append(p, len(each))[nxt] < p1[k]
        k, q, nxt = k[inside], q[inside], nxt[inside]
        put(pair(word[token_at[q] + each[q] - 1], t[nxt]), k, k + 1, run[k])
    whose, term, first, end = (np.concatenate(x) for x in zip(*found, strict=True))
    key = whose * max(1, len(d)) + term
    key, window = np.concatenate([key, key]), np.concatenate([first, end])
    sign = np.repeat(np.array([1, -1]), len(term))
    order = np.lexsort((window, key))
    window, sign, term = window[order], sign[order], np.concatenate([term, term])[order]
    tf = np.cumsum(sign)  # every term goes again, so each starts from none
    weight = np.append(0.0, 1 + np.log(np.arange(1, max(2, tf.max(initial=0) + 1))))
    new, old = weight[tf], weight[tf - sign]

    def summed(x: np.ndarray) -> np.ndarray:
        return np.cumsum(np.bincount(window, x, n_windows + 1))[:n_windows]

    idf = d.idf[term]
    terms = summed((tf > 0).astype(float) - (tf - sign > 0))
    length = np.sqrt(np.where(terms > 0.5, summed((new * new - old * old) * idf * idf), 1.0))
    z = np.where(terms > 0.5, summed((new - old) * idf * model.coefficients[term]), 0.0) / length + model.intercept
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def scored(made: DataFrame, model: TermModel | None, rules) -> DataFrame:
    """Runs as one row for each chunk: (session_id, seq, us, n_chars, text_score, mask, late, first), ``mask`` the rules found, as bits; the score is null for empty texts."""
    sent = made.sparkSession.sparkContext.broadcast(model)
    n_rules = len(rules)

    def mask(s: Column) -> Column:
        low = signatures.folded(s)
        return sum((F.when(signatures.flag(s, r, low), 1 << i).otherwise(0) for i, r in enumerate(rules)), F.lit(0))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.asarray(pc.list_value_length(batch.column("seq")))
        run = np.repeat(np.arange(len(n)), n)
        chars = _flat(batch, "b") - _flat(batch, "a")
        score = pa.array(_scores(batch, run, sent.value), mask=chars == 0) if sent.value else pa.nulls(len(run), pa.float64())
        cols = [batch.column("session_id").take(pa.array(run)), *[pc.list_flatten(batch.column(c)) for c in ("seq", "us")], pa.array(chars.astype(np.int32)), score, pa.array(_masks(batch, run, n_rules).astype(np.int32)), *[pc.list_flatten(batch.column(c)) for c in ("late", "first")]]
        return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in FLAT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, at = np.cumsum(np.asarray(pc.list_value_length(batch.column("seq")))), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WINDOWS)))
                yield one(batch.slice(at, end - at))
                at = end

    tokens = F.transform("pieces", lambda p: word_tokens(F.lower(p))) if model else F.array().cast("array<array<string>>")
    return made.select("session_id", "n_main", tokens.alias("tokens"), F.transform("sentences", mask).alias("masks"), *LISTS).mapInArrow(run, FLAT)


def with_hits(rows: DataFrame, rules) -> DataFrame:
    """Adds the hits of the rules in ``mask``."""
    one = [F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.struct(F.lit(r.id).alias("id"), F.lit(r.severity).alias("severity"))) for i, r in enumerate(rules)]
    return rows.withColumn("hits", F.array_compact(F.array(*one)))
