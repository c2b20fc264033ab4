"""The registered queries of the library's own operators."""

from __future__ import annotations

from . import corpora, evaluation, models, scoring

MODULES = [scoring, corpora, evaluation, models]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
