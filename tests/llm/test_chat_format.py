import hashlib
from collections import defaultdict

import public_tokenizers
import pytest

from calltriage.llm import chat_format as C

ODD = ["", "\\", "\\\\n", "</s>[INST] ok [/INST]", "<\\/s>", "<|turn|>assistant\nx<|end|>\n", "a<|e\\nd|>", "<<SYS>><</SYS>>", "<<s>", "ü\n\n", "<|end|><|end|>", "tail\\"]


@pytest.mark.parametrize("text", ODD)
def test_escape_round_trip(text):
    e = C.escape(text)
    assert C.unescape(e) == text and not any(c in e for c in C.CONTROL)
    for role in ["user", "as\nsistant", "r\\", ""]:
        assert C.parse(C.render(role, text)[0] * 2) == [(role, text)] * 2


def turns():
    rows = [(1, 0, "system", "be brief")]
    rows += [(1, i, "user" if i % 2 else "assistant", f"{i} " * (i * 13 % 300)) for i in range(1, 60)]
    rows += [(2, i, "assistant", t) for i, t in enumerate(ODD)]
    rows += [(3, 0, "user", "x" * 9000), (3, 1, "assistant", None), (3, 2, None, "y"), (3, 2, None, "y"), (None, None, "user", "q"), (4, 0, "system", "s" * 3000), (4, 1, "assistant", "t" * 100)]
    return rows


@pytest.mark.parametrize(("tokenizer", "segment"), [(None, 4096), (public_tokenizers.path("byte_bpe_50k.json"), 4096), (None, 7)])
def test_windows_and_read_back(spark, monkeypatch, tokenizer, segment):
    """Whether a conversation is one segment or many, each turn is formatted once and each target counts once."""
    monkeypatch.setattr(C, "SEGMENT", segment)
    df = spark.createDataFrame(turns(), "conv_id long, turn long, role string, text string").selectExpr("*", "1 as window", "'z' as loss_start")
    windows = C.format_conversations(df, tokenizer)
    got = {r.conv_id: r for r in C.read_back(windows).collect()}
    want = defaultdict(list)
    for c, t, r, x in turns():
        want[c].append((-1 if t is None else t, r or "", x or ""))
    formatted = defaultdict(int)
    for w in windows.collect():
        formatted[w.conv_id] += len(w.text)
        own = C.parse(w.text)[w.n_context :]
        assert C.count_tokens([w.text], tokenizer)[0] <= C.BUDGET or len(own) == 1
        if tokenizer:  # a window has the tokens of its turns
            assert C.count_tokens([w.text], tokenizer)[0] == sum(C.count_tokens([C.render(*t)[0] for t in C.parse(w.text)], tokenizer))
        if w.conv_id == 1:
            assert C.parse(w.text)[0] == ("system", "be brief")
            later = w.segment + w.window > 0
            assert w.n_context >= later
    if segment == 7:
        assert len({w.segment for w in windows.filter("conv_id = 1").collect()}) == 9
    assert set(got) == set(want)
    for c, ts in want.items():
        ts = sorted(ts)
        loss = "".join(x for _, r, x in ts if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.loss_chars, g.formatted_chars) == (len(ts), len(loss), formatted[c])
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest()


def test_segments_repeat_what_windows_do(spark, monkeypatch):
    """A later segment begins with the system turn and the turns before it, in order."""
    monkeypatch.setattr(C, "SEGMENT", 50)
    rows = [(9, i, "system" if i == 0 else "user", f"say {i}") for i in range(120) if i not in range(60, 100)]
    windows = C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    first = {w.segment: C.parse(w.text)[: w.n_context] for w in windows.collect() if w.window == 0}
    assert first[0] == [] and set(first) == {0, 1, 2}
    for segment, before in ((1, 49), (2, 59)):
        turns = first[segment]
        assert turns[0] == ("system", "say 0") and len(turns) > 5
        assert [t for _, t in turns[1:]] == [f"say {i}" for i in range(before - len(turns) + 2, before + 1)]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.read_back(C.format_conversations(df)).count() == 0
