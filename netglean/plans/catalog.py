"""All queries of the engine, and their SQL."""

from __future__ import annotations

from netglean.plans import captures, queries

QUERIES = queries.QUERIES | captures.QUERIES


def sql() -> dict[str, str]:
    return queries.sql() | captures.sql()
