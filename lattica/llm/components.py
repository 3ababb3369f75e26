"""Connected components of a table of links, by alternating large and small stars.

Each round replaces a node's neighbours by links to its smallest one. A hub's links are
aggregated map-side and joined back with one row a node, so its size is no one task's burden.
Rounds are logarithmic in practice; lineage is cut by reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

#: Rows for one task.
ROWS = 200_000


def _star(links: DataFrame, large: bool, tasks: int) -> DataFrame:
    """Links (u, v), u != v, in one direction. Large: to all larger neighbours; small: among the
    smaller ones."""
    if large:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = both.coalesce(tasks)
    least = both.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u").coalesce(tasks)
    if large:
        return moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def tasks_for(rows: int) -> int:
    """Tasks for a small table: shuffles of a loop otherwise leave a file for every partition."""
    return max(4, rows // ROWS)


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node that has a link."""
    B.checkpoints(links.sparkSession)
    now = links.select(F.col(links.columns[0]).cast("long").alias("u"), F.col(links.columns[1]).cast("long").alias("v")).where("u != v")
    now = now.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().checkpoint()
    tasks, before = tasks_for(now.count()), None
    while True:
        after = _star(_star(now, True, tasks).where("u != v"), False, tasks).where("u != v").distinct().coalesce(tasks).checkpoint()
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = after
        if mark == before:
            break
        before = mark
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct().coalesce(tasks).checkpoint()
