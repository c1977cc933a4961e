"""All registered queries and their DuckDB equivalents, collected from the query modules."""

from __future__ import annotations

from tonemill.plans import corpus, models, relations, scores  # noqa: F401
from tonemill.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
