"""Queries and their SQL, side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df, *columns: str, digits: int = 6):
    """Floats rounded, as sums depend on their order in the last bits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def flagship(spark, sf_dir):
    return QUERIES["degree_centrality"](spark, sf_dir)


from . import derived, detect, graph, property_graph, relational, similar, stats, streams, temporal  # noqa: E402, F401
