"""Rolling texts scored together, against each text on its own."""

import random
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from calltriage.config import Settings
from calltriage.operators import signatures, termmodel
from calltriage.plans import fixtures as fx, registry
from calltriage.streaming import follow, sessions as live, windows

from .conftest import SF
from .test_near import ODD

WORDS = sorted({w for t in fx.TEMPLATES for w in t.split(" ")})


def sessions_of_chunks(n=40):
    rng = random.Random(11)
    for session in range(n):
        rows, seq = [], 0
        for _ in range(rng.randrange(1, 50)):
            seq += rng.choice([1, 1, 1, 2, 0, -2])
            parts = rng.choices(WORDS, k=rng.randrange(6)) + rng.choices(ODD, k=rng.choice([0, 0, 1, 2])) + rng.choices(fx.TEMPLATES, k=rng.choice([0, 0, 0, 1]))
            rng.shuffle(parts)
            rows.append((seq, 10 * seq, rng.choice([None, "", "  ", "x" * 90] + [rng.choice([" ", "", "\t"]).join(parts) + rng.choice(["", " "])] * 16)))
        yield session, pd.DataFrame(rows, columns=["seq", "us", "chunk"]).sort_values("seq", kind="stable")


def words_model():
    rng, low = random.Random(5), [w.strip(".,?%").lower() for w in WORDS]
    terms = sorted({w for w in low if len(w) > 1} | {f"{a} {b}" for t in fx.TEMPLATES for a, b in zip(t.lower().split(), t.lower().split()[1:]) if a.isalpha() and b.isalpha() and min(len(a), len(b)) > 1} | {"ber", "ount", "ſafe", "ease share"})
    return termmodel.TermModel(termmodel.Dictionary(["word"] * len(terms), terms, np.array([rng.uniform(1, 4) for _ in terms])), np.array([rng.uniform(-2, 2) for _ in terms]), -0.4)


def runs(spark, found, s):
    made = [windows.runs(session, "", -1, True, chunks, found, s)[0] for session, chunks in sessions_of_chunks()]
    return spark.createDataFrame([tuple(r) for t in made for r in t.map(lambda x: x.tolist() if isinstance(x, np.ndarray) else x).itertuples(index=False)], windows.RUNS)


@pytest.mark.parametrize("chars", [3000, 70, 12])
def test_windows_are_scored_as_their_texts(spark, monkeypatch, chars):
    """texts that are cut anywhere, late and blank chunks, runs that end in between: the same hits and scores."""
    monkeypatch.setattr(windows, "CHUNKS", 9)
    monkeypatch.setattr(windows, "WINDOWS", 25)
    s, m = Settings().override(rolling_chars=chars), words_model()
    make = partial(runs, spark, s=s)
    fields = ("session_id", "seq", "ts", "n_chars", "n_hits", "hit_ids", "late", "first", "risk_score")
    got, want = (sorted(map(tuple, live.score_runs(make, m, rules, "first").select(*fields).collect())) for rules in (signatures.RULES, tuple(signatures.replace(r, one_sentence=False) for r in signatures.RULES)))
    assert [x[:-1] for x in got] == [x[:-1] for x in want] and [x[-1] for x in got] == pytest.approx([x[-1] for x in want], abs=1e-9)
    assert len(got) > 800 and sum(x[4] > 0 for x in got) > 40 and len({round(x[-1], 6) for x in got}) > 100
    texts = {}
    for session, chunks in sessions_of_chunks():
        text, last, own = "", -1, []
        for seq, _, chunk in chunks.itertuples(index=False):
            if seq > last:
                text, last = live.next_transcript(text, chunk or "", s), seq
            own.append(text)
        texts[session] = own
    for session, own in texts.items():
        assert sorted(len(t) for t in own) == sorted(x[3] for x in got if x[0] == session)
    rows = windows.texts(make(None)).collect()
    assert sorted((r.session_id, r.transcript) for r in rows) == sorted((k, t) for k, own in texts.items() for t in own)


def test_what_is_made_of_a_session_grows_with_its_chunks():
    """A text at its full length isn't repeated for each chunk, nor are its words and sentences."""
    chunks = pd.DataFrame({"seq": range(2000), "us": 0, "chunk": [f"view number {k}" + (" do not tell anyone." if k % 20 == 0 else "") for k in range(2000)]})
    made = windows.runs(1, "", -1, True, chunks, windows.anchors(signatures.RULES))[0]
    said = chunks["chunk"].str.len().sum()
    assert made["pieces"].map(lambda p: sum(map(len, p))).sum() < 2 * said and made["pieces"].map(len).max() < 2000
    assert sum(made["seq"].map(len)) == 2000


def test_streams_score_runs(spark, tmp_path):
    """No rolling text reaches the scorers of the live queries."""
    chunks = fx.as_chunks(live.read_events(spark, SF)).select("session_id", "seq", "ts", "chunk")
    plan = follow.follow(chunks, words_model())._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "transcript" not in plan.split("MapInArrow")[0]
    assert {"score_stream", "score_stream_chained", "alert_on_escalation_live"} <= set(registry.queries())
