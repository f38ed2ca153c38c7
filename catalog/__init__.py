"""Registered queries: the package's plans over the given tables, each with its SQL check."""

from __future__ import annotations


def registry() -> dict:
    """Name -> (query, check SQL or None)."""
    from . import climate_queries, decision_queries, history_queries, landing_queries

    return {**history_queries.QUERIES, **climate_queries.QUERIES, **decision_queries.QUERIES, **landing_queries.QUERIES}
