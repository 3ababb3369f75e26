"""Findings: filters, set operations, pagination, voting, scoring and post-processing.

A finding has id, detector, severity (0 info .. 4 critical), file, line, confidence, title.
Every step is a DataFrame -> DataFrame function, so a pipeline is their composition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("info", "low", "medium", "high", "critical")
#: Penalty of one finding by severity, info to critical.
PENALTY = (0.0, 0.1, 0.5, 2.0, 5.0)
#: Lowest score of each grade.
GRADES = ((97, "A+"), (93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"), (77, "C+"), (73, "C"), (70, "C-"), (67, "D+"), (63, "D"), (60, "D-"))


def by_severity(f: DataFrame, least: int) -> DataFrame:
    return f.where(F.col("severity") >= least)


def by_confidence(f: DataFrame, least: float, missing: float = 0.7) -> DataFrame:
    return f.where(F.coalesce("confidence", F.lit(missing)) >= least)


def enabled(f: DataFrame, disabled: list[str]) -> DataFrame:
    return f.where(~F.col("detector").isin(disabled)) if disabled else f


def glob_to_regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" if glob[i] in ".+()[]{}^$|\\" else "") + glob[i], i + 1
    return f"^{out}$"


def not_excluded(f: DataFrame, globs: list[str], column: str = "file") -> DataFrame:
    return reduce(lambda d, g: d.where(~F.col(column).rlike(glob_to_regex(g))), globs, f)


def deduplicated(f: DataFrame) -> DataFrame:
    """The first (smallest id) of each (detector, title, file, line)."""
    nth = F.row_number().over(Window.partitionBy("detector", "title", "file", "line").orderBy("id"))
    return f.withColumn("_n", nth).where("_n = 1").drop("_n")


def page(f: DataFrame, number: int, size: int) -> DataFrame:
    """A page of findings by severity, file, line, detector, title and id. A limit of the feature;
    Spark keeps a bounded heap in each task."""
    order = [F.desc("severity"), "file", "line", "detector", "title", "id"]
    return f.orderBy(*order).offset((number - 1) * size).limit(size)


def capped(f: DataFrame, most: int) -> DataFrame:
    """Per detector its `most` worst findings."""
    nth = F.row_number().over(Window.partitionBy("detector").orderBy(F.desc("severity"), "id"))
    return f.withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")


def severity_summary(f: DataFrame) -> DataFrame:
    """One row for each detector with a count for each severity, and the total."""
    return f.groupBy("detector").agg(*(F.sum((F.col("severity") == i).cast("long")).alias(s) for i, s in enumerate(SEVERITIES)), F.count(F.lit(1)).alias("total"))


def fuzzy_new(head: DataFrame, base: DataFrame, near: int = 3) -> DataFrame:
    """Findings of head without one of base of the same detector and file within `near` lines.

    The range is an equi join: base rows are put into line buckets of width near + 1 and their
    neighbours, so no pair further apart is made."""
    width = near + 1
    b = base.select("detector", "file", F.col("line").alias("base_line"), F.explode(F.array(*(F.floor(F.col("line") / width) + d for d in (-1, 0, 1)))).alias("bucket"))
    h = head.withColumn("bucket", F.floor(F.col("line") / width))
    return h.join(b, (h["detector"] == b["detector"]) & (h["file"] == b["file"]) & (h["bucket"] == b["bucket"]) & (F.abs(h["line"] - b["base_line"]) <= near), "left_anti").drop("bucket")


def watch_delta(head: DataFrame, base: DataFrame) -> DataFrame:
    """new and fixed findings by exact (detector, file, line)."""
    key = ["detector", "file", "line"]
    h, b = head.select(key).distinct(), base.select(key).distinct()
    return h.join(b, key, "left_anti").withColumn("change", F.lit("new")).union(b.join(h, key, "left_anti").withColumn("change", F.lit("fixed")))


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and changed, added, removed or unchanged, from (path, hash) tables."""
    j = old.toDF("path", "old_hash").join(new.toDF("path", "new_hash"), "path", "full_outer")
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("unchanged")
    return j.select("path", kind.alias("change"))


def compound_smells(f: DataFrame, width: int = 50) -> DataFrame:
    """Buckets of lines in which at least two detectors report."""
    g = f.groupBy("file", F.floor(F.col("line") / width).cast("long").alias("bucket")).agg(F.countDistinct("detector").alias("detectors"), F.count(F.lit(1)).alias("n"), F.max("severity").alias("severity"))
    return g.where("detectors >= 2")


def votes(f: DataFrame, least_detectors: int = 2, least_confidence: float = 0.6) -> DataFrame:
    """Consensus for each (file, line bucket): detectors, mean, weighted and Bayesian confidence,
    highest and majority severity."""
    c = F.coalesce("confidence", F.lit(0.7))
    e = f.withColumn("c", c).groupBy("file", F.floor(F.col("line") / 10).cast("long").alias("place"), "detector").agg(F.max("c").alias("c"), F.max("severity").alias("severity"))
    miss = F.exp(F.sum(F.log(F.greatest(1 - F.col("c"), F.lit(1e-9)))))
    counts = [F.sum((F.col("severity") == i).cast("long")).alias(f"s{i}") for i in range(5)]
    g = e.groupBy("file", "place").agg(F.count(F.lit(1)).alias("detectors"), F.avg("c").alias("mean_confidence"), (F.sum(F.col("c") * (F.col("severity") + 1)) / F.sum(F.col("severity") + 1)).alias("weighted_confidence"), (1 - miss).alias("bayes_confidence"), F.max("severity").alias("max_severity"), *counts)
    most = F.greatest(*(f"s{i}" for i in range(5)))
    mode = reduce(lambda w, i: w.when(F.col(f"s{i}") == most, i), range(3, -1, -1), F.when(F.col("s4") == most, 4))
    return g.where((F.col("detectors") >= least_detectors) & (F.col("mean_confidence") >= least_confidence)).select("file", "place", "detectors", "mean_confidence", "weighted_confidence", "bayes_confidence", "max_severity", mode.cast("long").alias("majority_severity"))


def compound_risk(f: DataFrame, factors: dict[str, tuple[str, float]]) -> DataFrame:
    """file, risk: weighted presence of risk factors; detector -> (factor, weight)."""
    names = sorted({k for k, _ in factors.values()})
    weight = {k: w for k, w in factors.values()}
    flags = [F.max(F.col("detector").isin([d for d, (k, _) in factors.items() if k == n]).cast("double")).alias(n) for n in names]
    g = f.groupBy("file").agg(*flags)
    hits = sum((F.col(n) for n in names), F.lit(0.0))
    base = sum((F.col(n) * weight[n] for n in names), F.lit(0.0))
    return g.select("file", *names, F.least(F.lit(1.0), base + F.when(hits >= 3, 0.1).otherwise(0.0)).alias("risk"))


def file_debt(f: DataFrame, sizes: DataFrame, metrics: DataFrame) -> DataFrame:
    """file, debt: .35 finding density, .25 coupling, .20 churn, .10 ownership spread, .10 age, each
    capped at 1 and scaled to 100. metrics: file, coupling, churn, authors, age_days."""
    density = f.groupBy("file").agg(F.sum(F.element_at(F.array(*map(F.lit, (0.0, 1.0, 2.0, 4.0, 8.0))), (F.col("severity") + 1).cast("int"))).alias("points"))
    j = sizes.join(density, "file", "left").join(metrics, "file", "left").na.fill(0)
    one = lambda c: F.least(F.lit(1.0), c)
    debt = 0.35 * one(F.col("points") / F.greatest(F.col("loc") / 100.0, F.lit(1.0)) / 10) + 0.25 * one(F.col("coupling") / 20.0) + 0.20 * one(F.col("churn") / 20.0) + 0.10 * one(F.col("authors") / 10.0) + 0.10 * one(F.col("age_days") / 365.0)
    return j.select("file", (100 * debt).alias("debt"))


def enriched(f: DataFrame, is_test=None, is_bundled=None, is_non_production=None) -> DataFrame:
    """Confidence from its default and what is known of the place, kept in .05 to .99."""
    place = Window.partitionBy("file", "line")
    others = F.size(F.collect_set("detector").over(place)) - 1
    delta = F.lit(0.0)
    for cond, d in ((is_bundled, -0.4), (is_non_production, -0.15), (is_test, -0.2)):
        if cond is not None:
            delta = delta + F.when(cond, d).otherwise(0.0)
    value = F.coalesce("confidence", F.lit(0.7)) + delta + 0.1 * F.least(others, F.lit(3))
    return f.withColumn("confidence", F.least(F.lit(0.99), F.greatest(F.lit(0.05), value)))


def grade(score):
    return reduce(lambda w, g: w.when(score >= g[0], g[1]), GRADES[1:], F.when(score >= GRADES[0][0], GRADES[0][1])).otherwise("F")


def health(f: DataFrame, pillar_of, weights: dict[str, float], security_multiplier: float = 3.0, size_factor: float = 1.0) -> DataFrame:
    """One row: a score for each pillar, overall and grade. A pillar starts at 100, loses its
    findings' weighted penalties and keeps 25; overall is the weighted mean in 5..100, at most 99.9
    with any finding of medium or above."""
    penalty = F.element_at(F.array(*map(F.lit, PENALTY)), (F.col("severity") + 1).cast("int")) * F.when(F.col("detector") == "security", security_multiplier).otherwise(1.0)
    p = f.withColumn("pillar", pillar_of)
    sums = [F.coalesce(F.sum(F.when(F.col("pillar") == k, penalty)), F.lit(0.0)).alias(k) for k in weights]
    a = p.agg(*sums, F.coalesce(F.max("severity"), F.lit(0)).alias("worst"))
    scores = {k: F.least(F.lit(100.0), F.greatest(F.lit(25.0), 100 - F.col(k) * size_factor)) for k in weights}
    total = sum(weights.values())
    overall = sum((scores[k] * (w / total) for k, w in weights.items()), F.lit(0.0))
    overall = F.greatest(F.lit(5.0), F.when(F.col("worst") >= 2, F.least(F.lit(99.9), overall)).otherwise(overall))
    return a.select(*(scores[k].alias(k) for k in weights), overall.alias("overall")).withColumn("grade", grade(F.col("overall")))


def without_overlap(f: DataFrame, loser: str, winner: str, *also: str) -> DataFrame:
    """Drops findings of `loser` at a (file, line) where `winner` reports too; `also` names further
    columns to agree on, as the symbol."""
    key = ["file", "line", *also]
    seen = f.where(F.col("detector") == winner).select(*key).distinct().withColumn("_hit", F.lit(True))
    return f.join(seen, key, "left").where(~((F.col("detector") == loser) & F.coalesce("_hit", F.lit(False)))).drop("_hit")


def labelled(f: DataFrame, labels: DataFrame) -> DataFrame:
    """Drops findings that users marked as false positives."""
    return f.join(labels.where("not is_true_positive").select(F.col("finding_id").alias("id")), "id", "left_anti")


def baseline_split(f: DataFrame, base: DataFrame, key: list[str]) -> DataFrame:
    """status new or baselined for findings, fixed for baseline entries that are gone."""
    b = base.select(key).distinct()
    now = f.join(b.withColumn("_in", F.lit(True)), key, "left").withColumn("status", F.when(F.col("_in"), "baselined").otherwise("new")).drop("_in")
    fixed = b.join(f.select(key).distinct(), key, "left_anti").withColumn("status", F.lit("fixed"))
    return now.unionByName(fixed, allowMissingColumns=True)
