"""Registered queries over the given tables."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("usage_queries", "security_queries", "company_queries", "text_queries", "table_queries", "source_queries", "stream_queries", "import_queries", "store_queries")


def load() -> tuple[dict, dict]:
    """Import all query modules; returns (queries, reference SQL)."""
    for name in _MODULES:
        import_module(f"usagelens.catalog.{name}")
    from usagelens.catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
