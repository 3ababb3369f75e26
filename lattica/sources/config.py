"""Project configuration (TOML) and the label store (JSON lines)."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.postprocess import Settings

LABELS = "finding_id string, detector string, is_true_positive boolean, reason string, ts timestamp"
SEVERITY = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}


@dataclass
class Config:
    settings: Settings = field(default_factory=Settings)
    options: dict[str, dict] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=lambda: {"structure": 0.4, "quality": 0.3, "architecture": 0.3})


def load(text: str) -> Config:
    """[detectors.<name>] enabled, severity and options; [exclude] paths; [scoring.weights], which
    are normalised to sum to 1; min_confidence and max_per_file at the top."""
    raw = tomllib.loads(text)
    c = Config()
    for name, table in raw.get("detectors", {}).items():
        if not table.get("enabled", True):
            c.settings.disabled.append(name)
        if "severity" in table:
            c.settings.overrides[name] = SEVERITY[table["severity"]]
        c.options[name] = {k: v for k, v in table.items() if k not in ("enabled", "severity")}
    c.settings.excludes = list(raw.get("exclude", {}).get("paths", []))
    c.settings.min_confidence = float(raw.get("min_confidence", 0.0))
    c.settings.max_per_file = raw.get("max_per_file")
    weights = raw.get("scoring", {}).get("weights")
    if weights:
        total = sum(weights.values())
        c.weights = {k: v / total for k, v in weights.items()}
    return c


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The latest label of each finding."""
    rows = spark.read.schema(LABELS).json(path)
    return rows.groupBy("finding_id").agg(F.max_by(F.struct("detector", "is_true_positive", "reason"), F.coalesce("ts", F.lit("1970-01-01").cast("timestamp"))).alias("x")).select("finding_id", "x.*")


def append_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("append").json(path)
