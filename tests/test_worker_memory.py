import tracemalloc

import numpy as np
import pyarrow as pa

from calltriage.operators import heavyterms, logistic
from calltriage.operators.termmodel import Dictionary, TermModel, _flat, _slices

WORDS = [f"word{i % 977}x{i % 31}" for i in range(1500)]
TEXT = " ".join(WORDS)


def peak(run) -> float:
    """MB that a call takes at most."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def batch(n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([TEXT] * n), pa.array([WORDS] * n)], ["text", "tokens"])


def test_terms_are_summed_in_small_slices():
    """what a task has at hand for the vocabulary doesn't grow with a batch of two million characters."""
    b = batch(2_000_000 // len(TEXT))

    def run():
        kept = heavyterms.Summary(1 << 16)
        for _, found, _ in heavyterms._terms(b):
            kept.add(found[0])

    assert peak(run) < 60


def test_summary_counts_exactly_while_there_is_room():
    rng, s, want = np.random.default_rng(1), heavyterms.Summary(1000), {}
    for _ in range(20):
        h = rng.integers(0, 400, 300).astype(np.uint64)
        s.add(h)
        for x in h.tolist():
            want[x] = want.get(x, 0) + 1
    assert dict(zip(s.h.tolist(), s.n.tolist(), strict=True)) == want and s.lost == 0 and (np.diff(s.h.astype(np.int64)) > 0).all()


def test_texts_are_scored_in_small_slices():
    """the same for the scores of texts."""
    b = batch(2_000_000 // len(TEXT))
    runs = sorted({w[i : i + n] for w in WORDS for n in (3, 4, 5) for i in range(len(w) - n + 1)})
    terms = [*["word"] * 977, *["char"] * len(runs)], [*WORDS[:977], *runs]
    model = TermModel(Dictionary(*terms, np.ones(len(terms[1]))), np.ones(len(terms[1])), 0.0)
    texts, tokens = b.column("text"), b.column("tokens")
    model.score(texts.slice(0, 1), tokens.slice(0, 1))  # the tables are made once
    assert peak(lambda: [model.score(texts.slice(at, n), _flat(tokens.slice(at, n))) for at, n in _slices(texts)]) < 90


def test_rows_are_scored_in_small_slices():
    """what a task has at hand for the scores of a batch of features doesn't grow with the batch."""
    n, each = 4000, 1000
    offsets = pa.array(np.arange(0, n * each + 1, each), pa.int32())
    i, w = pa.ListArray.from_arrays(offsets, pa.array(np.tile(np.arange(each, dtype=np.int32), n))), pa.ListArray.from_arrays(offsets, pa.array(np.full(n * each, 0.5)))
    assert peak(lambda: logistic._scores(i, w, np.ones((1, each + 1)))) < 20
