import random

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from calltriage.llm import token_counts

from ..conftest import SF

MODEL, JSON = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "▁", "é", "word", "the", "\t", "<s>", "</s>", "<0x0A>", "漢", "字", "😀", "\0", "0x", "ffff", "==", "."]
ODD = ["", " ", "  ", "\n", "\n\n", " \n", "\n ", "▁", "a\n", "\na", "\n\na", "x" * 5000, "a " * 3000, "abc1" * 4000, "漢字" * 5000, "\n" * 100, "  \n  ", " " * 3000 + "a", "q" * 49, "q" * 50]


def texts(n=400):
    rng = random.Random(5)
    return ODD + ["".join(rng.choices(PARTS, k=rng.randrange(1, 120))) for _ in range(n)]


def plain(ts):
    return [len(x) for x in SentencePieceProcessor(model_file=MODEL).encode(ts, num_threads=1)]


@pytest.mark.parametrize(("window", "long_piece", "cached"), [(1 << 20, 2048, 500_000), (50, 7, 20)])
def test_pieces_equal_whole_texts(monkeypatch, window, long_piece, cached):
    monkeypatch.setattr(token_counts, "WINDOW", window)
    monkeypatch.setattr(token_counts, "LONG_PIECE", long_piece)
    c, ts = token_counts.Pieces(MODEL, cached), texts(400 if window > 100 else 120)
    assert c.by_piece
    got = [n for at in range(0, len(ts), 30) for n in c.count(ts[at : at + 30])]
    assert got == plain(ts)


def test_documents(spark):
    """Every text of sf0.001, by the model and by a file of another library."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ts = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, MODEL).collect()}
    for t, n in zip(ts, plain([t["text"] or "" for t in ts]), strict=True):
        r = got[t["doc_id"]]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t["text"] or "").encode()), n, n > 4096)
    tk = Tokenizer.from_file(JSON)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, JSON).collect()}
    assert got == {t["doc_id"]: len(tk.encode(t["text"] or "", add_special_tokens=False).ids) for t in ts}


def test_odd_rows(spark):
    """Nulls, repeated rows and clashing columns; counts above the limit."""
    rows = [(1, None, 0), (1, None, 0), (None, "a b", 0), (2, "x y " * 5000, 0), (2, "", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int").withColumnRenamed("n_bytes", "n.tokens")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(d, MODEL).collect()), key=str)
    assert got == sorted([(1, 0, 0, False)] * 2 + [(None, 3, 2, False), (2, 20_000, plain(["x y " * 5000])[0], True), (2, 0, 0, False)], key=str)
    assert token_counts.count_tokens(d.limit(0), MODEL).count() == 0


def test_batches_by_bytes():
    ts = ["a" * 10, "é" * 10, "b" * 100, "", "c"]
    got = list(token_counts.balanced(ts, 30))
    assert [t for b in got for t in b] == ts and got == [["a" * 10, "é" * 10], ["b" * 100], ["", "c"]]
    batch = pa.RecordBatch.from_pydict({"text": [*ts, None]})
    parts = list(token_counts.byte_slices(batch, "text", 30))
    assert [p.num_rows for p in parts] == [2, 1, 3]
