"""Scam signatures: rules as data, evaluated as literal regex columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .termmodel import _slices

FLAGS = "(?iuU)"
MAX_SNIPPETS = 3
PAD = 15
#: Characters of texts that are searched for anchors at a time.
CHUNK = 1 << 20
PLACES = "array<struct<at:int,part:string>>"
OPEN, CLOSE = "\u0001", "\u0002"


@dataclass(frozen=True)
class Rule:
    id: str
    scam_type: str
    severity: int
    patterns: tuple[str, ...]
    advice: str
    #: Lower-case ASCII strings of which every match holds one; texts without any are not searched. None: all are.
    anchors: tuple[str, ...] = ()
    #: No match holds one of ``. ? !`` or asks for one beside it; with anchors, only sentences that hold one are searched.
    one_sentence: bool = False


# What counts as a secret, and what turns a request into its opposite.
NO_PLACE = r"(?!\s*(?:code|location))"
SECRET = (
    rf"(?:otp|one[- ]time password|pin{NO_PLACE}|cvv|card number|expiry date|"
    r"verification code|security code|(?:\d{1,2}|two|three|four|five|six)[- ]?digit code)"
)
NEGATIONS = ("not", "never", "don't", "doesn't", "won't", "wouldn't", "need to", "needed to", "needs to", "no need to")
NO_NEGATION = "".join(f"(?<!{n} )" for n in NEGATIONS)
REQUEST = r"\b(?:share|tell me|read (?:me|out)|give me|send me|provide|confirm)\b"

# Rule ids, scam types, severities and patterns.
_RULES = (
    Rule("otp_pin_cvv_request", "bank_fraud", 3, (NO_NEGATION + REQUEST + r"[^.?!\n]{0,25}\b" + SECRET + r"\b", r"\bwhat(?:'s| is)\s+(?:the|your)\s+" + SECRET + r"\b", r"\botp\b[^.?!\n]{0,20}\bread it\b"), "Someone wanted a one-time code, PIN or card secret, which no bank asks for by phone.", ("otp", "time password", "pin", "cvv", "card number", "expiry date", "verification code", "security code", "digit code")),
    Rule("digital_arrest_or_warrant_threat", "govt_impersonation", 3, (r"\bdigital arrest\b", r"\barrest warrant\b", r"\bfir (?:has been|is|has|being) registered\b", r"\bunder arrest\b", r"\bstay on (?:the )?(?:video )?call\b"), "Arrest was threatened over the phone; officers do not do that.", ("arrest", " registered", "stay on ")),
    Rule("remote_access_app_request", "tech_support", 2, (r"\b(?:download|install|open)\b[^.?!\n]{0,25}\b(?:anydesk|teamviewer|quicksupport)\b", r"\b(?:anydesk|teamviewer|quicksupport)\b", r"\bremote access\b[^.?!\n]{0,20}\b(?:app|screen)\b"), "A remote-control app was suggested, which would open your device to the caller.", ("anydesk", "teamviewer", "quicksupport", "remote access")),
    Rule("upi_collect_qr_trick", "refund_scam", 3, (r"\bcollect request\b", r"\bscan (?:this|the|my)?\s*qr code\b", r"\benter your (?:upi )?pin\b[^.?!\n]{0,30}\b(?:receive|refund|get)\b", r"\bfor receiving\b[^.?!\n]{0,20}\bpin\b", r"\breverse qr\b"), "Receiving money never needs a PIN or a scanned code; that sends money.", ("collect request", "qr code", "enter your ", "for receiving", "reverse qr")),
    Rule("secrecy_demand", "unknown_scam", 2, (r"\bdo(?:n't| not) (?:tell|inform)\b[^.?!\n]{0,25}\b(?:anyone|family|bank|police)\b", r"\bnot even your family\b", r"\bkeep this (?:call|conversation)? ?confidential\b", r"\btelling anybody\b"), "Secrecy was demanded, a way to keep you from asking for help.", (" tell", " inform", "not even your", "keep this ", "telling anybody")),
    Rule("urgency_deadline", "unknown_scam", 1, (r"\b(?:within|in the next)\s+(?:ten|10|five|5|one|1|two|2|sixty|60|thirty|30)\s+(?:minutes?|hours?|seconds?)\b", r"\bexpires? in\s+(?:sixty|60|thirty|30)\s+seconds\b", r"\blast warning\b", r"\btoday only\b", r"\bevery minute of delay\b"), "A short deadline was set to hurry you.", ("within", "in the next", "expire", "last warning", "today only", "minute of delay")),
    Rule("prize_lottery_fee", "prize_scam", 2, (r"\b(?:lottery|lucky draw|kbc|jackpot)\b[^.?!\n]{0,40}\b(?:won|winner)\b", r"\b(?:processing fee|government tax|clearance fee)\b[^.?!\n]{0,25}\b(?:prize|winner|winning|release)\b", r"\bwon\b[^.?!\n]{0,25}\b(?:lakh|crore)\b"), "A prize was promised against a fee; real prizes cost nothing.", ("lottery", "lucky draw", "kbc", "jackpot", "processing fee", "government tax", "clearance fee", "lakh", "crore")),
    Rule("kyc_expiry_threat", "bank_fraud", 2, (r"\bkyc\b[^.?!\n]{0,20}\b(?:expired|expire|incomplete|update)\b", r"\baccount\b[^.?!\n]{0,25}\b(?:blocked|suspended|frozen)\b[^.?!\n]{0,25}\b(?:today|kyc|rbi)\b"), "An account was said to be blocked over missing papers; a branch handles that.", ("kyc", "account")),
    Rule("safe_account_rbi_transfer", "govt_impersonation", 3, (r"\bsafe account\b", r"\b(?:rbi|reserve bank)\b[^.?!\n]{0,30}\b(?:transfer|audit|verification)\b", r"\bfunds? must be audited\b", r"\bsecure government account\b"), "You were told to move money to keep it safe; no bank asks for that.", ("safe account", "rbi", "reserve bank", "must be audited", "secure government account")),
    Rule("loan_app_photo_threat", "loan_scam", 3, (r"\b(?:morph(?:ed)?|edited|shameful)\b[^.?!\n]{0,20}\bphotos?\b", r"\bcontact list\b[^.?!\n]{0,20}\b(?:access|gallery)\b", r"\bsend (?:your|the)?\s*photos?\b[^.?!\n]{0,25}\b(?:contacts|family|everyone)\b"), "Pictures were used as a threat over a loan; that is blackmail.", ("photo", "contact list")),
    Rule("army_marketplace_claim", "marketplace_scam", 2, (r"\b(?:army|crpf|jawan|commanding officer)\b[^.?!\n]{0,40}\b(?:transfer|posted|buy|pay|qr)\b", r"\barmy (?:canteen|id)\b"), "A buyer claimed to be a soldier with an unusual way to pay.", ("army", "crpf", "jawan", "commanding officer")),
    Rule("investment_guaranteed_return", "investment_scam", 2, (r"\bguaranteed\b[^.?!\n]{0,20}\b(?:return|profit|income)\b", r"\bdouble your money\b", r"\brisk[- ]?free\b[^.?!\n]{0,20}\b(?:profit|return)\b", r"\b\d{1,3}\s?%\s?(?:return|profit)\b[^.?!\n]{0,20}\b(?:month|monthly|week|guaranteed)\b"), "Certain high returns were promised; no investment has them.", ("guaranteed", "double your money", "risk", "return", "profit")),
)
RULES = tuple(replace(r, one_sentence=True) for r in _RULES)


def register(rules: tuple[Rule, ...], rule: Rule, spark) -> tuple[Rule, ...]:
    """``rules`` with one more; its id must be new and its patterns must compile in Spark."""
    if any(r.id == rule.id for r in rules):
        raise ValueError(f"a rule named {rule.id} exists")
    spark.range(1).select(*[F.lit("").rlike(FLAGS + p) for p in rule.patterns]).collect()
    return (*rules, rule)


def folded(text: Column) -> Column:
    """In lower case, with the letters that Unicode folds to ASCII ones as these."""
    odd, plain = "\u017f\u0131\u0130\u212a", "siik"
    # few texts have such letters, and only these are rewritten letter by letter
    return F.lower(F.when(reduce(or_, [F.contains(text, F.lit(c)) for c in odd]), F.translate(text, odd, plain)).otherwise(text))


def _sentence_rules(rules) -> list[Rule]:
    return [r for r in rules if r.anchors and r.one_sentence]


def near(text: Column, rules) -> Column:
    """The sentences of a text that hold an anchor, and their first characters' places in the ``unmarked`` text: all that rules of one sentence have to search.

    One pass looks for the anchors of all rules. It may keep a sentence without any.
    """
    found = {re.escape(a).replace("i", "[i\u0131\u0130]") for r in _sentence_rules(rules) for a in r.anchors}
    pattern = f"(?i){'|'.join(sorted(found))}"

    @F.arrow_udf(PLACES)
    def run(texts: pa.Array) -> pa.Array:
        made = [_near(texts.slice(at, n), pattern) for at, n in _slices(texts, CHUNK)]
        return pa.concat_arrays(made) if made else _near(texts, pattern)

    return run(F.coalesce(text, F.lit("")))


def _near(texts: pa.StringArray, pattern: str) -> pa.ListArray:
    split = pc.split_pattern_regex(texts, "[.?!]")
    row, parts = np.asarray(pc.list_parent_indices(split)), pc.list_flatten(split)
    kept = plain = parts
    if pc.any(pc.match_substring_regex(texts, f"[{OPEN}{CLOSE}]")).as_py():
        plain = pc.replace_substring_regex(parts, f"[{OPEN}{CLOSE}]", "")
    hit = pc.match_substring_regex(parts, pattern)
    if plain is not kept:
        hit = pc.or_(hit, pc.match_substring_regex(plain, pattern))
    hit = np.asarray(hit)
    ends = np.cumsum(np.asarray(pc.utf8_length(plain)).astype(np.int64) + 1)
    first = np.concatenate([[0], ends[:-1]])[: len(ends)]
    begins = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
    first = first - np.repeat(first[begins], np.diff(np.append(np.flatnonzero(begins), len(row))))
    counts = np.bincount(row[hit], minlength=len(texts))
    values = pa.StructArray.from_arrays([pa.array(first[hit].astype(np.int32)), kept.filter(pa.array(hit))], ["at", "part"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def flag(text: Column, rule: Rule, low: Column | None = None) -> Column:
    """True if any pattern of the rule occurs; null or empty text: false. ``low`` is the ``folded`` text."""
    hit = reduce(or_, [text.rlike(FLAGS + p) for p in rule.patterns])
    if rule.anchors:  # patterns are only tried where an anchor stands
        low = folded(text) if low is None else low
        hit = F.when(reduce(or_, [F.contains(low, F.lit(a)) for a in rule.anchors]), hit)
    return F.coalesce(hit, F.lit(False))


def without(rule: Rule, *parts: str) -> Rule:
    """The rule with parts of its patterns left out, such as a guard."""
    return replace(rule, patterns=tuple(reduce(lambda p, x: p.replace(x, ""), parts, p) for p in rule.patterns))


def _flagged(calls: DataFrame, rules, text: str) -> DataFrame:
    """Adds the flags and, if any rule is one of sentences, ``__places``."""
    own, low, some, some_low, short = F.col(text), F.col("__low"), F.col("__some"), F.col("__some_low"), _sentence_rules(rules)
    d, given = calls, own
    if short:
        if calls.isStreaming:  # a Python function can't take the rows of a stateful operator as they are; a generator copies them
            d, given = d.withColumn("__given", F.explode(F.array(own))), F.col("__given")
        d = d.withColumn("__places", near(given, rules)).withColumn("__some", F.array_join("__places.part", ".")).withColumn("__some_low", folded(some))
    if any(r.anchors and r not in short for r in rules):
        d = d.withColumn("__low", folded(own))
    return d.withColumns({f"sig_{r.id}": flag(some, r, some_low) if r in short else flag(own, r, low) for r in rules}).drop("__given", "__low", "__some", "__some_low")


def with_flags(calls: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    return _flagged(calls, rules, text).drop("__places")


def unmarked(text: Column) -> Column:
    """The text without the two characters that mark matches."""
    return F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)), F.translate(text, OPEN + CLOSE, "")).otherwise(text)


def whole(clean: Column) -> Column:
    """A text as its only stretch."""
    return F.array(F.struct(F.lit(0).alias("at"), clean.alias("part"))).cast(PLACES)


def _spans(place: Column, pattern: str) -> Column:
    """Start and end of each match of a pattern in a stretch, as places in the text."""
    parts = F.filter(F.split(F.regexp_replace(place["part"], FLAGS + pattern, f"{OPEN}$0{CLOSE}"), CLOSE), lambda x: F.contains(x, F.lit(OPEN)))
    return F.aggregate(
        parts,
        F.struct(place["at"].alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("s")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x) - 1).alias("at"),
            F.concat(acc["s"], F.array(F.struct((acc["at"] + F.instr(x, OPEN) - 1).alias("a"), (acc["at"] + F.length(x) - 1).alias("b")))).alias("s"),
        ),
        lambda acc: acc["s"],
    )


def snippets(clean: Column, rule: Rule, places: Column | None = None) -> Column:
    """Up to three distinct matches with 15 characters around them, in pattern order, of an ``unmarked`` text; they are searched in ``places`` of it."""
    places = whole(clean) if places is None else places

    def found(pattern: str) -> Column:
        return F.flatten(F.transform(places, lambda x: _spans(x, pattern)))

    def cut(s: Column) -> Column:
        first = F.greatest(s["a"] - PAD, F.lit(0))
        return F.regexp_replace(F.substring(clean, first + 1, s["b"] + PAD - first), r"(?U)^\s+|\s+$", "")

    return F.slice(F.array_distinct(F.transform(F.concat(*[found(p) for p in rule.patterns]), cut)), 1, MAX_SNIPPETS)


def with_hits(calls: DataFrame, rules=RULES, text: str = "text", with_snippets: bool = False) -> DataFrame:
    """Adds ``hits``: an array of structs, one for each rule that matched, in rule order."""
    d, short = _flagged(calls, rules, text), _sentence_rules(rules)
    if with_snippets:
        d = d.withColumn("__clean", unmarked(F.col(text)))
        if short:
            d = d.withColumn("__clean_places", F.transform("__places", lambda x: F.struct(x["at"].alias("at"), unmarked(x["part"]).alias("part"))))

    def one(i: int, r: Rule) -> Column:
        fields = [F.lit(r.id).alias("id"), F.lit(r.scam_type).alias("scam_type"), F.lit(r.severity).alias("severity"), F.lit(r.advice).alias("advice"), F.lit(i).alias("pos")]
        if with_snippets:
            fields.append(snippets(F.col("__clean"), r, F.col("__clean_places") if r in short else None).alias("matches"))
        return F.when(F.col(f"sig_{r.id}"), F.struct(*fields))

    return d.withColumn("hits", F.array_compact(F.array(*[one(i, r) for i, r in enumerate(rules)]))).drop("__clean", "__places", "__clean_places", *[f"sig_{r.id}" for r in rules])


def hits_long(calls: DataFrame, id_col: str = "call_id", **kw) -> DataFrame:
    """One row per call and matched rule."""
    # for a plain explode, Spark asks for the array's size below the rules, which matches all of them once more
    return with_hits(calls, **kw).select(id_col, F.explode_outer("hits").alias("h")).filter("h is not null").select(id_col, "h.*")


def summary(with_hits_: DataFrame) -> DataFrame:
    """Adds n_hits, hit_ids and max_severity (0 without hits)."""
    return with_hits_.withColumns({"n_hits": F.size("hits"), "hit_ids": F.array_join(F.col("hits.id"), ","), "max_severity": F.coalesce(F.array_max(F.col("hits.severity")), F.lit(0))})
