"""The ordered post-processing of findings, and false-positive scoring.

Order: default confidence, enrichment, user labels, minimum confidence, severity overrides, path
excludes, caps by file, dead-code overlap, exact duplicates, compound smells, downgrade of
security findings outside production, category thresholds of the heuristic score, ranking."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.code import is_test
from . import findings as O

#: Least heuristic score of a finding by category.
THRESHOLDS = {"security": 0.35, "quality": 0.52, "ml": 0.45, "performance": 0.52}
DEFAULT_THRESHOLD = 0.5


@dataclass
class Settings:
    min_confidence: float = 0.0
    disabled: list[str] = field(default_factory=list)
    overrides: dict[str, int] = field(default_factory=dict)
    excludes: list[str] = field(default_factory=list)
    max_per_file: int | None = None
    rank: bool = False


def heuristic_score(df: DataFrame) -> DataFrame:
    """Adds tp_score: how likely a finding is true, from its category, severity, place and text."""
    s = 0.5 + F.when(F.col("category") == "security", 0.25).otherwise(0.0) + F.when(F.col("severity") == 4, 0.2).when(F.col("severity") == 3, 0.1).when(F.col("severity") == 0, -0.05).otherwise(0.0)
    s = s - F.when(is_test(F.col("file")), 0.3).otherwise(0.0) - F.when(F.col("file").rlike(r"(^|/)(vendor|node_modules|dist|build|generated|examples?)/"), 0.25).otherwise(0.0)
    s = s - F.when(F.col("title").rlike(r"(?i)\b(mock|fixture|sample|demo)\b"), 0.15).otherwise(0.0) + F.when(F.col("cwe_id").isNotNull(), 0.05).otherwise(0.0)
    return df.withColumn("tp_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))


def apply(f: DataFrame, settings: Settings | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Findings (id, detector, severity, title, file, line_start, line_end, category, cwe_id,
    confidence) after all steps, with tp_score and compound."""
    s = settings or Settings()
    f = f.withColumn("line", F.coalesce("line_start", F.lit(0)))
    f = O.enriched(O.enabled(f, s.disabled), is_test=is_test(F.col("file")), is_bundled=F.col("file").rlike(r"\.min\.js$|(^|/)bundle"), is_non_production=F.col("file").rlike(r"(^|/)(scripts|examples?|docs|bench\w*)/"))
    if labels is not None:
        f = O.labelled(f, labels)
    f = O.by_confidence(f, s.min_confidence)
    for name, severity in s.overrides.items():
        f = f.withColumn("severity", F.when(F.col("detector") == name, severity).otherwise(F.col("severity")))
    f = O.not_excluded(f, s.excludes)
    if s.max_per_file:  # a cap the user asks for
        w = Window.partitionBy("file").orderBy(F.desc("severity"), "id")
        f = f.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= s.max_per_file).drop("_n")
    f = O.deduplicated(O.without_overlap(f, "DeadCodeDetector", "UnreachableCodeDetector"))
    bucket = F.floor(F.col("line") / 50)
    smells = O.compound_smells(f).select("file", F.col("bucket").alias("_b"), F.lit(True).alias("_c"))
    f = f.withColumn("_b", bucket).join(smells, ["file", "_b"], "left").withColumn("compound", F.coalesce("_c", F.lit(False))).drop("_b", "_c")
    outside = is_test(F.col("file")) | F.col("file").rlike(r"(^|/)(scripts|examples?|docs|bench\w*)/")
    f = f.withColumn("severity", F.when(outside & (F.col("category") == "security"), F.greatest(F.lit(0), F.col("severity") - 1)).otherwise(F.col("severity")))
    least = F.lit(DEFAULT_THRESHOLD)
    for category, t in THRESHOLDS.items():
        least = F.when(F.col("category") == category, t).otherwise(least)
    f = heuristic_score(f)
    f = f.where((F.col("tp_score") >= least) | (F.col("category").isin("quality") & (F.col("tp_score") >= 0.45))).drop("line")
    return f.orderBy(F.desc("tp_score"), "id") if s.rank else f
