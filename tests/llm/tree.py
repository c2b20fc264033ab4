"""A context tree in memory, to compare the one that Spark weighs in parts with."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from calltriage.llm import lm_scoring as L


def _decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each of the 255 binary nodes (1-based, like a heap)."""
    z, o = np.zeros(counts.shape), np.zeros(counts.shape)
    level = counts.astype(float)
    for b in range(7, -1, -1):
        z[:, 1 << b : 2 << b], o[:, 1 << b : 2 << b] = level[:, 0::2], level[:, 1::2]
        level = level[:, 0::2] + level[:, 1::2]
    return z, o


@dataclass
class Tree:
    """A tree in memory, for small counts; column[b] is byte b's column, the last one that of all bytes not learned from.

    child[i, c]: the context that adds such a byte before context i (-1: none);
    log10[i, c]: its probability after context i.
    """

    column: np.ndarray
    child: np.ndarray
    log10: np.ndarray

    def score(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte after its longest kept context."""
        buf = self.column[buf]
        ctx = np.zeros(len(at), np.int32)
        deeper = np.arange(len(at))
        for d in range(1, L.DEPTH + 1):
            nxt = self.child[ctx[deeper], buf[at[deeper] - d]]
            found = nxt >= 0
            deeper = deeper[found]
            ctx[deeper] = nxt[found]
        return self.log10[ctx, buf[at]]


class _Depth:
    """The kept contexts of one depth and their byte counts, sorted by context."""

    def __init__(self, t: pa.Table, above: _Depth | None):
        ctx, self.sym, self.n = (t.column(c).to_numpy() for c in ("ctx", "sym", "n"))
        if above is None and not len(ctx):
            ctx, self.sym, self.n = np.zeros(1, np.int64), np.full(1, L.END[0]), np.zeros(1, np.int64)
        self.names, self.row = np.unique(ctx, return_inverse=True)
        # the nearest byte is the highest, so a parent is the name without its lowest byte
        self.parent = None if above is None else np.searchsorted(above.names, self.names >> 8)

    def part(self, lo: int, hi: int) -> np.ndarray:
        a, b = np.searchsorted(self.row, [lo, hi])
        c = np.zeros((hi - lo, 256))
        c[self.row[a:b] - lo, self.sym[a:b]] = self.n[a:b]
        return c


def _weigh(counts: np.ndarray, below: tuple | None, parent: np.ndarray | None) -> tuple:
    """((log weighted probability, zeros, ones), (own weight, own estimate, the rest's estimate))."""
    z, o = _decisions(counts)
    own = L._kt_log(z, o)
    if parent is None:
        return (own, z, o), (np.ones_like(own), (o + 0.5) / (z + o + 1), np.full_like(own, 0.5))
    rest_z, rest_o, split = z.copy(), o.copy(), np.zeros_like(own)
    np.add.at(split, parent, below[0])
    np.subtract.at(rest_z, parent, below[1])
    np.subtract.at(rest_o, parent, below[2])
    split += L._kt_log(rest_z, rest_o)
    weighted = np.logaddexp(own, split) - math.log(2)
    return (weighted, z, o), (np.exp(own - weighted) / 2, (o + 0.5) / (z + o + 1), (rest_o + 0.5) / (rest_z + rest_o + 1))


def _log10_of_bytes(p: np.ndarray) -> np.ndarray:
    """log10 of each byte's probability from the probabilities of a one at the nodes."""
    p = np.clip(p, 1e-12, 1 - 1e-12)
    one, zero, bits = np.log10(p), np.log10(1 - p), np.arange(256)
    out = np.zeros(p.shape)
    for b in range(8):
        node, bit = (256 | bits) >> (8 - b), (bits >> (7 - b)) & 1
        out += np.where(bit == 1, one[:, node], zero[:, node])
    return out


def build_tree(tables: list[pa.Table]) -> Tree:
    """Weighs the kept contexts from the deepest up, then mixes from the root down.

    The subtrees of the nearest byte are worked on one by one, first for their
    weight at the root, then for the estimates of their contexts.
    """
    depths: list[_Depth] = []
    for t in tables:
        depths.append(_Depth(t, depths[-1] if depths else None))
    first = np.concatenate(([0], np.cumsum([len(d.names) for d in depths])))
    used = np.flatnonzero(depths[0].part(0, 1)[0])
    column = np.full(256, len(used), np.uint8 if len(used) < 256 else np.uint16)
    column[used] = np.arange(len(used))
    child = np.full((first[-1], len(used) + 1), -1, np.int32)
    log10 = np.zeros((first[-1], len(used) + 1))

    def put(lo: int, hi: int, p: np.ndarray) -> None:
        each = _log10_of_bytes(p)
        log10[lo:hi, :-1] = each[:, used]
        if len(used) < 256:  # bytes not learned from share what the tree leaves them
            log10[lo:hi, -1] = np.log10(np.mean(10 ** each[:, np.setdiff1d(np.arange(256), used)], axis=1))

    for d in range(1, len(depths)):
        child[first[d - 1] + depths[d].parent, column[depths[d].names & 255]] = first[d] + np.arange(len(depths[d].names))

    def subtree(i: int) -> tuple[list[tuple[int, int]], list, tuple]:
        spans = [(i, i + 1)]
        for d in range(2, len(depths)):
            spans.append(tuple(int(x) for x in np.searchsorted(depths[d].parent, spans[-1])))
        below, mix = None, []
        for d in range(len(depths) - 1, 0, -1):
            lo, hi = spans[d - 1]
            deeper = spans[d] if d < len(depths) - 1 else None
            parent = None if deeper is None else depths[d + 1].parent[slice(*deeper)] - lo
            below, m = _weigh(depths[d].part(lo, hi), below, parent)
            mix.append(m)
        return spans, mix[::-1], below

    n_first = len(depths[1].names) if len(depths) > 1 else 0
    tops = [subtree(i)[2] for i in range(n_first)]
    joined = tuple(np.concatenate([t[j] for t in tops]) if tops else np.zeros((0, 256)) for j in range(3))
    _, (w, p_own, p_rest) = _weigh(depths[0].part(0, 1), joined, np.zeros(n_first, np.int64))
    put(0, 1, w * p_own + (1 - w) * p_rest)
    root = (w * p_own, 1 - w)
    for i in range(n_first):
        spans, mix, _ = subtree(i)
        fixed, left = root
        for d, ((lo, hi), (w, p_own, p_rest)) in enumerate(zip(spans, mix, strict=True), 1):
            put(first[d] + lo, first[d] + hi, fixed + left * (w * p_own + (1 - w) * p_rest))
            if d < len(spans):
                p = depths[d + 1].parent[slice(*spans[d])] - lo
                fixed, left = (fixed + left * w * p_own)[p], (left * (1 - w))[p]
    return Tree(column, child, log10)
