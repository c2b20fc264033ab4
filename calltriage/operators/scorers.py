"""Pluggable scorers: by name, loaded or not, and null where they fail."""

from __future__ import annotations

import logging
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .audio import fit_window

LOG = logging.getLogger(__name__)
#: Waveforms that a voice model gets at a time.
BATCH = 64
#: Models that a worker process keeps.
KEPT_MODELS = 3
_MODELS: OrderedDict = OrderedDict()


def worker_model(key: str, load: Callable[[], Callable]) -> Callable:
    """The model of a key, made once in a worker process and kept for its later tasks."""
    if key not in _MODELS:
        _MODELS[key] = load()
    _MODELS.move_to_end(key)
    while len(_MODELS) > KEPT_MODELS:
        _MODELS.popitem(last=False)
    return _MODELS[key]


@dataclass(frozen=True)
class TextScorer:
    """A text's score in [0, 1] as a column; ``score`` is None if there is no model."""

    name: str
    score: Callable[[Column], Column] | None = None

    @property
    def is_loaded(self) -> bool:
        return self.score is not None

    def column(self, text: Column) -> Column:
        """The score; null without a model and for blank texts."""
        return F.when(self.applies(text), self.score(text)) if self.is_loaded else F.lit(None).cast("double")

    def applies(self, text: Column) -> Column:
        """Whether there is anything to score."""
        return F.coalesce(F.regexp_replace(text, r"(?U)\s+", "") != "", F.lit(False))


@dataclass(frozen=True)
class AudioScorer:
    """A voice model: ``logits`` takes a batch of equally long waveforms, one a row, and gives a logit for each.

    A model too large to be sent with every task is given as ``load`` instead,
    which makes it once in each worker process.
    """

    name: str
    logits: Callable[[np.ndarray], np.ndarray] | None = None
    length: int | None = None
    load: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None
    key: str = field(default_factory=lambda: uuid.uuid4().hex, repr=False, compare=False)

    @property
    def is_loaded(self) -> bool:
        return self.logits is not None or self.load is not None

    def applies(self, samples: Column) -> Column:
        """Whether there is anything to score."""
        return F.coalesce(F.size(samples) > 0, F.lit(False))

    def column(self, samples: Column) -> Column:
        """The probability of a made voice; null without a model, without samples and where the model fails.

        Waveforms are padded or cut to the model's length and scored in
        batches. If a batch fails, its waveforms are tried one by one.
        """
        if not self.is_loaded:
            return F.lit(None).cast("double")
        given, load, key = self.logits, self.load, self.key

        def tried(logits: Callable, x: np.ndarray) -> np.ndarray:
            try:
                return np.asarray(logits(x), np.float64).reshape(len(x))
            except Exception as e:  # a model that fails counts as a missing signal
                if len(x) > 1:
                    return np.concatenate([tried(logits, x[i : i + 1]) for i in range(len(x))])
                LOG.warning("voice scoring failed: %s", e)
                return np.full(1, np.nan)

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            logits = given or worker_model(key, load)
            for s in batches:
                z = np.full(len(s), np.nan)
                at = np.flatnonzero(s.notna())
                for i in range(0, len(at), BATCH):
                    rows = at[i : i + BATCH]
                    z[rows] = tried(logits, np.stack([np.asarray(s.iloc[k], np.float32) for k in rows]))
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                yield pd.Series(p).astype(object).where(~np.isnan(z), None)

        return run(F.when(self.applies(samples), fit_window(samples, self.length)))


@dataclass
class Registry:
    """Scorers by name, in the order in which they are preferred."""

    scorers: dict = field(default_factory=dict)

    def register(self, scorer) -> Registry:
        """A new name goes last; a known one raises."""
        if scorer.name in self.scorers:
            raise ValueError(f"a scorer named {scorer.name} exists")
        self.scorers[scorer.name] = scorer
        return self

    def loaded(self) -> list[str]:
        return [n for n, s in self.scorers.items() if s.is_loaded]

    def ensemble(self, signal: Column) -> Column:
        """The highest score of all loaded scorers; null if none has one."""
        found = [self.scorers[n].column(signal) for n in self.loaded()]
        return F.greatest(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("double")

    def select(self):
        """The scorer to use: an ensemble if several are loaded, else the one that is; without any, one that has no scores."""
        found = self.loaded()
        if len(found) == 1:
            return self.scorers[found[0]]
        return TextScorer("ensemble", self.ensemble) if found else TextScorer("none")


def with_scores(df: DataFrame, known: Registry, signal: Column, seen: Observation | None = None) -> DataFrame:
    """Adds ``score_<name>`` for each loaded scorer.

    ``seen`` is given, with the first action, ``tried_<name>`` (rows that had
    something to score) and ``failed_<name>`` (those of them without a score).
    Spark counts a task's rows once, whatever is repeated.
    """
    names = known.loaded()
    out = df.select("*", *[known.scorers[n].column(signal).alias(f"score_{n}") for n in names])
    if seen is None or not names:
        return out
    had = {n: known.scorers[n].applies(signal) for n in names}
    return out.observe(seen, *[c for n in names for c in (F.count_if(had[n]).alias(f"tried_{n}"), F.count_if(had[n] & F.col(f"score_{n}").isNull()).alias(f"failed_{n}"))])


def failures(df: DataFrame, known: Registry, signal: Column) -> DataFrame:
    """(scorer, tried, failed) of all loaded scorers, in one pass over the rows."""
    names = known.loaded()
    had = [known.scorers[n].applies(signal).alias(f"had_{n}") for n in names]
    rows = with_scores(df, known, signal).select(*had, *[F.col(f"score_{n}") for n in names])
    each = F.array(*[F.struct(F.lit(n).alias("scorer"), F.count_if(f"had_{n}").alias("tried"), F.count_if(F.col(f"had_{n}") & F.col(f"score_{n}").isNull()).alias("failed")) for n in names])
    return rows.agg(each.alias("s")).select(F.inline("s"))
