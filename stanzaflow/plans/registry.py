"""All core queries and their SQL."""

from __future__ import annotations

from stanzaflow.plans import catalogue, general, pairs, reviewing, sheets, smaller, texts, windows

MODULES = [general, texts, pairs, catalogue, sheets, reviewing, smaller, windows]


def queries() -> dict:
    """Name to callable (spark, sf_dir) of every core query."""
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    """Name to SQL of every core query that SQL can express."""
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
