"""Named queries over the test tables, each with the SQL that checks it."""

from __future__ import annotations

from .registry import ORACLE, QUERIES, flagship

__all__ = ["flagship", "oracle_sql", "queries"]


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
