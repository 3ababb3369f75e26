"""Line rules: a table of rules against source lines, with suppression and block state.

A rule is a cheap substring test and a regular expression; both reach the JVM as one generated
expression, the substring first. Extensions and file predicates come before lines are split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    hint: str = ""
    severity: int = 1
    category: str = "quality"
    near: str = ""  # a pattern wanted within `window` lines
    absent: str = ""  # a pattern that must not be within `window` lines
    window: int = 0


def suppressed(lines: DataFrame, marker: str) -> DataFrame:
    """Lines with the marker on them or on the line before, or in the file's first 10 with a file
    marker."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    low = F.lower("line")
    own = low.contains(marker)
    before = F.coalesce(F.lag(low).over(w).contains(marker), F.lit(False))
    whole = F.max(F.when(F.col("line_no") <= 10, low.contains(f"{marker}-file")).otherwise(False)).over(Window.partitionBy("doc_id"))
    return lines.withColumn("suppressed", own | before | whole)


def apply(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, line_no, rule, severity of all matches; one pass over the lines."""
    hits, w = [], Window.partitionBy("doc_id").orderBy("line_no")
    around = {(p, r.window): f"_w{i}" for i, (p, r) in enumerate((p, r) for r in rules for p in (r.near, r.absent) if p)}
    lines = lines.withColumns({c: F.max(F.col("line").rlike(p)).over(w.rowsBetween(-n, n)) for (p, n), c in around.items()})
    for r in rules:
        test = F.col("line").rlike(r.pattern)
        if r.hint:
            test = F.lower("line").contains(r.hint) & test
        for pattern, wanted in ((r.near, True), (r.absent, False)):
            if pattern:
                found = F.col(around[pattern, r.window])
                test = test & (found if wanted else ~found)
        hits.append(F.when(test, F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).cast("long").alias("severity"))))
    return lines.select("doc_id", "line_no", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("h")).select("doc_id", "line_no", "h.rule", "h.severity")


def runs(lines: DataFrame, matches, least: int = 5) -> DataFrame:
    """Islands of at least `least` consecutive lines that match: doc_id, first, last, n."""
    m = lines.where(matches)
    key = F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return m.withColumn("g", key).groupBy("doc_id", "g").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("g")


def depth(lines: DataFrame, opening: str = "(", closing: str = ")") -> DataFrame:
    """Nesting depth after each line by a running sum of brackets, not below 0 per file's minimum."""
    count = lambda c: F.length("line") - F.length(F.replace(F.col("line"), F.lit(c), F.lit("")))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("depth", F.sum(count(opening) - count(closing)).over(w))
