"""Column functions of risk scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Settings


def clamp01(c: Column) -> Column:
    """Into [0, 1]; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def classify_level(score: Column, s: Settings = Settings()) -> Column:
    """high, suspicious or low; both thresholds are inclusive."""
    return F.when(score >= s.high, "high").when(score >= s.suspicious, "suspicious").otherwise("low")


def severity_weight(severity: Column, s: Settings = Settings()) -> Column:
    w = F.lit(s.other_severity_weight)
    for k, v in s.severity_weights.items():
        w = F.when(severity == k, v).otherwise(w)
    return w


def signature_subscore(severities: Column, s: Settings = Settings()) -> Column:
    """Sum of the severities' weights, 1 at most; no hits give 0."""
    return F.least(F.aggregate(severities, F.lit(0.0), lambda a, x: a + severity_weight(x, s)), F.lit(1.0))


def components(text: Column, severities: Column, audio: Column, s: Settings = Settings()) -> Column:
    """The available signals by name; a missing signal has no entry."""
    sig = F.when(F.size(severities) > 0, signature_subscore(severities, s))
    return F.map_filter(F.create_map(F.lit("text"), clamp01(text), F.lit("signature"), clamp01(sig), F.lit("audio"), clamp01(audio)), lambda k, v: v.isNotNull())


def noisy_or(text: Column, severities: Column, audio: Column, s: Settings = Settings()) -> Column:
    """1 - product of (1 - weighted signal) over the available signals."""
    sig = F.when(F.size(severities) > 0, signature_subscore(severities, s))
    rest = F.lit(1.0)
    for signal, weight in ((text, s.text_weight), (sig, s.signature_weight), (audio, s.audio_weight)):
        rest = rest * F.coalesce(1 - clamp01(signal * weight), F.lit(1.0))
    return 1 - rest


def display_score(score: Column) -> Column:
    """Percent, halves rounded up; null shows 0."""
    return F.floor(F.coalesce(score, F.lit(0.0)) * 100 + 0.5)


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def softmax2(first: Column, second: Column) -> Column:
    """Probability of the second of two logits."""
    return 1 / (1 + F.exp(first - second))
