"""Query plans: every registered query of the signal engine."""

from __future__ import annotations


def all_queries() -> tuple[dict, dict]:
    """(queries, oracle SQL) of all plan modules."""
    from . import q_company, q_market, q_records, q_validation, q_verdict, registry  # noqa: F401

    return dict(registry.QUERIES), dict(registry.SQL)
