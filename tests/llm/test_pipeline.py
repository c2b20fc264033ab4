"""The pipeline against a plain version of all of its stages."""

import os
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from calltriage.llm import queries, secret_scan
from calltriage.llm.common import scratch_dir
from tokenizers import Tokenizer

from ..conftest import SF
from .test_native import measured


def passes(t):
    words, chars, symbols, dup_lines, repeats = measured(t)
    t = t or ""
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n"))
    failed = words < 20 or 100 * repeats > 30 * words or 10 * symbols > 3 * words or 100 * dup_lines > 30 * lines
    return not (failed or not 2 * words <= chars <= 15 * words or 2 * len(re.findall("[A-Z]", t)) > chars)


def one_of_each_group(rows):
    sets = {d: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})(t.encode().lower().split()) for d, t in rows}
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = {d: x if g == y else g for d, g in group.items()}
    return [(d, t) for d, t in rows if group[d] == d]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def clean(rows, items):
    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    lengths = {len(x) for x in windows}
    return [(d, t) for d, t in rows if not any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in lengths for i in range(len(w) - n + 1))]


def redacted(t):
    out, last, end = [], 0, -1
    for kind, a, b in secret_scan.find(t)[1]:
        if a >= end:
            out += [t[last:a], f"[{kind}]"]
        last = end = max(end, b)
    return "".join([*out, t[last:]])


@pytest.fixture(scope="module")
def pieces(spark):
    folder = scratch_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = corpus_pipeline.run(spark, SF).collect()
    left = [x.rpartition("-")[0] for x in set(os.listdir(folder)) - before]
    assert [x for x in left if x.startswith("pipeline-")] == ["pipeline-secret_scan"]
    return rows


def test_pipeline_equals_plain_stages(spark, pieces):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = clean(one_of_each_group([(d, t) for d, t in docs if passes(t)]), items)
    tk = Tokenizer.from_file(queries.tokenizer_path())
    got = defaultdict(list)
    for p in pieces:
        got[p.doc_id].append(p)
    assert set(got) == {d for d, _ in rows} and len(rows) < len(docs)
    for d, t in rows:
        ids, at = tk.encode(redacted(t), add_special_tokens=False).ids + [0], 0
        for p in sorted(got[d], key=lambda p: p.start):
            raw = b"".join(i.to_bytes(4, "little") for i in ids[at : at + p.length])
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(raw))
            at += p.length
        assert at == len(ids)


def test_windows_are_full(pieces):
    size = Counter()
    for p in pieces:
        size[p.sequence_id, p.tier] += p.length
    assert all(n == tier for (_, tier), n in size.items())


def test_stages_take_odd_rows_and_columns(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, 1.5, "a"), (1, text, 1.5, "a"), (None, text + " end", 2.5, None), (2, None, None, "b"), (3, "", None, "c"), (4, "x" * 60_000, None, "d")]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "a.b", "rid"])
    left = {"quality_rules": 3, "minhash_near_dedup": 4, "decontaminate": 6, "secret_scan": 6}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == left[name] and stage(spark, docs.limit(0), SF).count() == 0
    assert len({p.doc_id for p in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}) == 5
