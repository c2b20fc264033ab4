"""Text normalisation and small projections of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the two speakers, source tags and the tags they stand for.
CALLER = ("caller", "suspect", "person a", "scammer", "agent")
RECEIVER = ("receiver", "innocent", "person b", "victim", "user")
SCAM_TAGS = {"ssn": "govt_impersonation", "support": "tech_support", "refund": "refund_scam", "reward": "prize_scam"}
BENIGN_TAGS = {"delivery": "delivery", "insurance": "insurance", "telemarketing": "telemarketing", "wrong": "wrong_number", "appointment": "appointment"}


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_ws(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_speakers(c: Column) -> Column:
    """Speaker marks become ``Caller:`` and ``Receiver:``; white space is collapsed."""
    for names, mark in ((CALLER, "Caller:"), (RECEIVER, "Receiver:")):
        alternatives = "|".join(sorted(names, key=len, reverse=True))
        c = F.regexp_replace(c, rf"(?iuU)\b(?:{alternatives})\s*:", mark)
    return collapse_ws(c)


def unify_type(tag: Column, label: Column) -> Column:
    """The common tag of a source's tag; scams and benign calls have their own lists."""

    def lookup(tags: dict, other: str) -> Column:
        out = F.lit(other)
        for k, v in tags.items():
            out = F.when(tag == k, v).otherwise(out)
        return out

    return F.when(label == 1, lookup(SCAM_TAGS, "unknown_scam")).otherwise(lookup(BENIGN_TAGS, "none"))


def word_count(c: Column) -> Column:
    t = collapse_ws(c)
    return F.when(F.length(t) > 0, F.size(F.split(t, " "))).otherwise(0)


def turns_to_transcript(turns: DataFrame, call: str, order: str, speaker: str, text: str) -> DataFrame:
    """One transcript per call: ``speaker: text`` joined in order."""
    line = F.concat(F.col(speaker), F.lit(": "), F.col(text))
    rows = turns.groupBy(call).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("rows"))
    return rows.select(call, F.array_join(F.col("rows.l"), " ").alias("transcript"))


def single_speaker(c: Column) -> Column:
    return strip(F.concat(F.lit("Caller: "), c))


def segments_to_transcript(segments: Column) -> Column:
    """Trimmed, non-empty segment texts joined by spaces."""
    return strip(F.array_join(F.filter(F.transform(segments, lambda s: strip(s["text"])), lambda t: t != ""), " "))


def recording_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


#: Recordings that are accepted.
SUFFIXES = (".wav", ".mp3", ".m4a", ".ogg", ".webm")


# Verdicts and labels of the levels.
def verdict_labels(level: Column) -> dict[str, Column]:
    """Verdict, label and one line of advice for a level."""
    pick = lambda high, mid, low: F.when(level == "high", high).when(level == "suspicious", mid).otherwise(low)
    return {
        "verdict": pick("SCAM WARNING", "BE CAREFUL", "LOOKS SAFE"),
        "label": pick("High risk", "Suspicious", "Low risk"),
        "advice": pick("End the call and share nothing.", "Check with someone before you act.", "Nothing to do for now."),
    }


def severity_label(severity: Column) -> Column:
    return F.when(severity == 1, "Low").when(severity == 2, "Medium").when(severity == 3, "High").otherwise("Note")
