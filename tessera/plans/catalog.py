"""All queries of the library and their SQL."""

from __future__ import annotations

from . import asking, audits, curation, evaluation, landing, linking, shaping, similarity, wording
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


__all__ = ["asking", "audits", "curation", "evaluation", "landing", "linking", "shaping", "similarity", "wording", "oracle_sql", "queries"]
