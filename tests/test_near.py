import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from calltriage.operators import signatures
from calltriage.plans import fixtures as fx
from calltriage.plans import registry

from .conftest import SF

ODD = [".", "?", "!", "\n", "  ", "\u0001", "\u0002", "́", " ", "ſ", "İ", "ı", "K", "\U0001f600", "Σ", "'", " not", " pin location", " Kyc expired", " İnstall anydesK", " ſafe account"]


def texts():
    rng = random.Random(3)
    words = [w for t in fx.TEMPLATES for w in t.split(" ")]
    for i in range(400):
        parts = [t for t in rng.sample(fx.TEMPLATES, rng.randint(0, 3))] + rng.choices(words, k=rng.randint(0, 12)) + rng.choices(ODD, k=rng.randint(0, 6))
        rng.shuffle(parts)
        t = rng.choice([" ", "", "  "]).join(parts)
        if rng.random() < 0.4 and t:  # a mark or an end of a sentence inside a match
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(ODD) + t[k:]
        yield i, t.upper() if i % 5 == 0 else t
    yield from [(400, None), (401, ""), (402, "..."), (403, "\u0001otp\u0002 share otp. Tell me the o\u0001tp.")]


def test_sentences_have_all_matches(spark):
    """Searching the sentences with an anchor gives the hits and snippets of the whole texts."""
    d = spark.createDataFrame(list(texts()), "call_id long, text string").repartition(3)
    own = tuple(replace(r, one_sentence=False) for r in signatures.RULES)
    got, want = (sorted(map(tuple, signatures.hits_long(d, rules=r, with_snippets=True).select("call_id", "id", "pos", "matches").collect())) for r in (signatures.RULES, own))
    assert got == want and len(want) > 300
    flags, whole = (sorted(map(tuple, signatures.with_flags(d, r).drop("text").collect())) for r in (signatures.RULES, own))
    assert flags == whole


def test_only_sentences_with_an_anchor_are_searched(spark):
    d = spark.createDataFrame([(1, "Good morning. \u0001Tell me the otp! Where? At home, by the arrest."), (2, "Nothing here."), (3, None)], "i long, text string")
    got = {r["i"]: [tuple(p) for p in r["p"]] for r in d.select("i", signatures.near(F.col("text"), signatures.RULES).alias("p")).collect()}
    assert got == {1: [(13, " \u0001Tell me the otp"), (37, " At home, by the arrest")], 2: [], 3: []}


@pytest.mark.parametrize("name", ["sig_hits_long", "sig_prevalence"])
def test_hits_are_found_in_one_pass(spark, name):
    """Queries on hits look for the anchors of all rules once a text, not once for each."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "RLIKE(concat(Caller" not in plan and "RLIKE(text" not in plan
