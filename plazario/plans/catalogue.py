"""The core catalogue: every registered query that needs nothing from the training-data subpackage."""

from __future__ import annotations

from plazario.plans import delivery_queries, posting_queries

_MODULES = [delivery_queries, posting_queries]


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.oracle_sql().items()}
