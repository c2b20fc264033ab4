"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements
and one bit for each rule that fails; a policy is a set of rule names, applied
as a bit mask, so that policies can be compared or changed without reading the
texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, renamed, with_window_hashes, with_words

#: White space that separates words.
SPACE_CLASS = r"\x20\x09-\x0D"
SYMBOL_CLASS = "[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A named condition over the ledger's measurements; true means failed."""

    name: str
    failed: Column


def rules() -> list[Rule]:
    """The rules, in the order of their bits (bit 0 first)."""
    c = F.col
    return [
        Rule("few_words", c("n_words") < 20),
        Rule("repeated_windows", 100 * c("n_repeat_words") > 30 * c("n_words")),
        Rule("symbols", 10 * c("n_symbols") > 3 * c("n_words")),
        Rule("duplicate_lines", 100 * c("n_dup_lines") > 30 * c("n_lines")),
        Rule("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words"))),
        Rule("upper_case", 2 * c("n_upper") > c("word_chars")),
    ]


#: Policies by version: the rules that make a document fail.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "word_length", "upper_case"),
}


def policy_mask(policy: str) -> int:
    """The bits of a policy's rules."""
    names = [r.name for r in rules()]
    return sum(1 << names.index(x) for x in POLICIES[policy])


#: The measurements of a text, in the order of their columns.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_repeat_words")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measurements to every row of ``docs``.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with
    a word), n_dup_lines (those equal to an earlier line), n_upper (A-Z), and
    n_repeat_words: the words inside 8-word windows that occur twice or more
    in the text. A null text counts as empty and measures 0 everywhere. Rows
    are independent: repeated rows and repeated ids keep one result each.
    Columns of any name stay; those named like a measurement or ``fail_bits``
    go on as ``<name>_input``.
    """
    own = [f"c{i}" for i in range(len(docs.columns))]
    d = docs.toDF(*own).withColumn("__text", F.coalesce(F.col(own[docs.columns.index(text_col)]), F.lit("")))
    d = with_words(d, "__text", "__words", SPACE_CLASS)
    d = d.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")))
    d = d.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count("__text", F.lit(SYMBOL_CLASS)).cast("long"),
            "n_upper": F.regexp_count("__text", F.lit("[A-Z]")).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__h": F.transform("__words", lambda w: F.xxhash64(w)),
        }
    ).drop("__text", "__words", "__lines")
    # one 64-bit value a window; most texts have no window twice and stop here
    d = with_window_hashes(d, "__h", "__win", WINDOW).drop("__h")
    d = d.withColumn("__rep", F.size(F.array_distinct("__win")) < F.size("__win"))
    d = d.withColumn("__sorted", F.when(F.col("__rep"), F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__win")
    hash_at = lambda k: F.get("__sorted", k)["h"]
    same = lambda k: (hash_at(k - 1) == hash_at(k)) | (hash_at(k + 1) == hash_at(k))
    d = d.withColumn("__at", F.when(F.col("__rep"), F.sort_array(F.transform(F.filter("__sorted", lambda x, k: F.coalesce(same(k), F.lit(False))), lambda x: x["i"])))).drop("__sorted")
    # windows start at __at: each covers the words up to the next start, the last one all of its words
    steps = F.zip_with(F.slice("__at", 1, F.greatest(F.size("__at") - 1, F.lit(0))), F.slice("__at", 2, F.greatest(F.size("__at") - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(WINDOW), lambda acc, x: acc + x)
    d = d.withColumn("n_repeat_words", F.when(F.col("__rep"), covered).otherwise(0).cast("long"))
    return d.select(*own, *MEASURES).toDF(*[f"{c}_input" if c in (*MEASURES, "fail_bits") else c for c in docs.columns], *MEASURES)


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``measure`` plus ``fail_bits``: bit i is set if rule i fails."""
    bits = F.lit(0).cast("long")
    for i, r in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(r.failed, F.lit(1 << i)).otherwise(0).cast("long"))
    return measure(docs, text_col).withColumn("fail_bits", bits)


def verdict(policy: str) -> Column:
    """True if a ledger row passes the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def keep(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the policy, with their own columns, whatever their names.

    Null and empty texts go; repeated rows stay or go together.
    """
    # a filter on the measurements would be pushed below them, which would make
    # each of them anew wherever it is named; the row number keeps it above
    led = ledger(numbered(docs), f"c{docs.columns.index(text_col)}")
    kept = led.withColumn("row", F.monotonically_increasing_id()).filter(verdict(policy) & (F.col("row") >= 0))
    return renamed(kept, docs)


def ablation(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents failing it, and those failing it alone.

    ``regained`` is what dropping that one rule would let through. The ledger
    is first counted by bit pattern (at most 2^rules rows), so texts and
    documents are read once, whatever the number of rules.
    """
    mask = F.lit(policy_mask(policy)).cast("long")
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    names = [r.name for r in rules()]
    each = F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(1 << names.index(x)).cast("long").alias("bit")) for x in POLICIES[policy]])
    rows = patterns.select("bits", "n", F.explode(each).alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return rows.groupBy("rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"), F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("regained"))
