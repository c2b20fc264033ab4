import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from calltriage.llm import packing

from ..conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "a b", "  two  spaces", "tab\t x \n\n y", "end ", "\n lead", "don't <|endoftext|> stop", "word " * 3000,
    "x" * 5000, "é è  ß   z", "a\x1c b", "\x1c a", "The the. The,\nThe \n the", "a,b c,. d!! e?x f's. g'", "é. ß, x9. 9. (a) a)b) nul\0 in", "x" * 70 + ", " + "x" * 70, "<|endoftext|>. a <|endoftext|> <|endoftext|>\nb",
] + [f"text {i} " * (i * 7 % 90) for i in range(120)]


def brute(t):
    tk = Tokenizer.from_file(PATH)
    return tk.encode(t or "", add_special_tokens=False).ids + [0]


def test_encoder_equals_whole_texts():
    tk = Tokenizer.from_file(PATH)
    texts = [t or "" for t in TEXTS]
    got = list(packing.Encoder(PATH, cached_words=5).encode(texts))
    assert got == [packing._as_bytes(tk.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("parts", [1, 3])
def test_pieces(spark, parts):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, tier string, length int").repartition(parts)
    rows = packing.pack(df, PATH).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(docs) == set(range(len(TEXTS)))
    for d, ps in docs.items():
        ids, at = brute(TEXTS[d]), 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(packing._as_bytes(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0 and {p.tier for p in ps} == {at}


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_on_documents(name):
    """Every text of sf0.001, whatever the kind of tokenizer; words forgotten and learned again."""
    import pyarrow.parquet as pq

    path = public_tokenizers.path(name)
    texts = [t or "" for t in pq.read_table(f"{SF}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    e = packing.Encoder(path, cached_words=2000)
    got = [x for at in range(0, len(texts), 50) for x in e.encode(texts[at : at + 50])]
    tk = Tokenizer.from_file(path)
    assert got == [packing._as_bytes(tk.encode(t, add_special_tokens=False).ids) for t in texts]


def test_steps_are_even(spark):
    df = spark.createDataFrame([(i, f"word{i} " * (i * 37 % 700)) for i in range(1500)], "doc_id long, text string").repartition(2)
    windows = {(r.sequence_id, r.tier, r.step_group) for r in packing.pack(df, PATH).collect()}
    steps = defaultdict(lambda: defaultdict(int))
    for sequence, tier, step in windows:
        steps[sequence >> 36, tier][step] += 1
    assert any(len(s) > 2 for s in steps.values())
    for (_, tier), sizes in steps.items():
        n = [sizes[k] for k in sorted(sizes)]
        full = packing.STEP_TOKENS // tier
        assert all(x == full for x in n[:-2]) and max(n) <= full and (len(n) < 2 or abs(n[-1] - n[-2]) <= 1)
