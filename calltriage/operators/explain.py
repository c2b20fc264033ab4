"""Plain-language explanations, built as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMED = 0.5
SHOWN = 5
LOW = "No trick heard up to now. Hang up if somebody wants codes, money or control of your device."
VOICE = "- A computer may be speaking. Announcements do so, too, so weigh this with the rest."
PHRASING = "- The sentences are like those of recorded scams, though none of the listed tricks is among them."
WEAK = "- Small hints add up here; none of them says much alone."
ADVICE = "Keep codes and money to yourself, and install nothing while you are on this call."
#: By level: how a text with tricks begins, and one without.
LIKELY, POSSIBLE = "Very likely a scam", "Possibly a scam"
RISKY, CAREFUL = "Risky, although no known trick was heard", "Be careful, although no known trick was heard"
#: What a score without tricks rests on: words and voice, voice, words, neither.
BASES = (": words and voice.", ": the voice.", ": the words.", ": little of each.")


def flags(text_score: Column, audio_score: Column) -> tuple[Column, Column]:
    at = lambda c: F.coalesce(c >= NAMED, F.lit(False))
    return at(text_score), at(audio_score)


def reasons(hits: Column, text_score: Column, audio_score: Column) -> Column:
    """The reason lines: the five gravest hits, or what else drove the score; never none."""
    content, voice = flags(text_score, audio_score)
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct((-h["severity"]).alias("s"), h["pos"].alias("p"), h["advice"].alias("a"))))
    lines = F.transform(F.slice(ordered, 1, SHOWN), lambda x: F.concat(F.lit("- "), x["a"]))
    more = F.when(F.size(hits) > SHOWN, F.concat(F.lit("...and "), F.size(hits) - SHOWN, F.lit(" more.")))
    with_hits = F.concat(lines, F.array_compact(F.array(more, F.when(voice, VOICE))))
    without = F.array_compact(F.array(F.when(content, PHRASING), F.when(voice, VOICE), F.when(~content & ~voice, WEAK)))
    return F.when(F.size(hits) > 0, with_hits).otherwise(without)


def headline(level: Column, hits: Column, text_score: Column, audio_score: Column) -> Column:
    """Counts tricks only if there are hits."""
    content, voice = flags(text_score, audio_score)
    high = level == "high"
    n = F.concat(F.size(hits), F.when(F.size(hits) == 1, " known trick").otherwise(" known tricks"))
    basis = F.when(content & voice, BASES[0]).when(voice, BASES[1]).when(content, BASES[2]).otherwise(BASES[3])
    found = F.concat(F.when(high, LIKELY).otherwise(POSSIBLE), F.lit(": "), n, F.lit(" heard."))
    return F.when(F.size(hits) > 0, found).otherwise(F.concat(F.when(high, RISKY).otherwise(CAREFUL), basis))


def explanation(level: Column, hits: Column, text_score: Column, audio_score: Column) -> Column:
    lines = F.concat(F.array(headline(level, hits, text_score, audio_score)), reasons(hits, text_score, audio_score), F.array(F.lit(ADVICE)))
    return F.when(level == "low", LOW).otherwise(F.array_join(lines, "\n"))
