"""Sinks: findings as JSON lines, SARIF 2.1, Markdown and text.

JSON lines are written by Spark's own writer, one file a partition. SARIF and the summaries are
single documents; their rows are built as JSON in the plan and streamed to the driver, never
collected at once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .findings import SEVERITIES, severity_summary

LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def severity_name(column="severity"):
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.col(column) + 1).cast("int"))


def json_lines(findings: DataFrame, path: str, mode: str = "overwrite") -> None:
    findings.withColumn("severity", severity_name()).write.mode(mode).json(path)


def sarif_rows(findings: DataFrame) -> DataFrame:
    """One JSON result object for each finding."""
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[severity_name()]
    region = F.when(F.col("line_start").isNotNull(), F.struct(F.greatest(F.lit(1), F.col("line_start")).alias("startLine"), F.greatest(F.lit(1), F.coalesce("line_end", "line_start")).alias("endLine")))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    print_ = F.struct(F.hex("id").alias("primary"))
    return findings.select(F.to_json(F.struct(F.col("detector").alias("ruleId"), level.alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.array(place).alias("locations"), print_.alias("partialFingerprints"))).alias("result"))


def sarif(findings: DataFrame, path: str, tool: str = "lattica") -> None:
    """A SARIF 2.1.0 log; results in a stable order."""
    rules = [{"id": r[0]} for r in findings.select("detector").distinct().orderBy("detector").collect()]  # the registry's size at most
    ordered = findings.orderBy(F.desc("severity"), "file", "line_start", "detector", "id")
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": ')
        f.write(json.dumps({"name": tool, "rules": rules}) + '}, "results": [')
        for i, r in enumerate(sarif_rows(ordered).toLocalIterator()):
            f.write(("," if i else "") + "\n" + r["result"])
        f.write("\n]}]}\n")


def markdown(findings: DataFrame, top: int = 50) -> str:
    """A summary table by detector and the `top` worst findings."""
    out = ["# Findings", "", "| Detector | " + " | ".join(SEVERITIES) + " | total |", "|" + "---|" * (len(SEVERITIES) + 2)]
    for r in severity_summary(findings).orderBy(F.desc("critical"), F.desc("high"), "detector").collect():
        out.append("| " + " | ".join(str(r[c]) for c in ("detector", *SEVERITIES, "total")) + " |")
    out += ["", f"## Worst {top}", ""]
    for r in findings.orderBy(F.desc("severity"), "file", "line_start", "detector").limit(top).collect():
        out.append(f"- **{SEVERITIES[r['severity']]}** `{r['file']}:{r['line_start'] or 1}` {r['title']}")
    return "\n".join(out) + "\n"


def text(findings: DataFrame, top: int = 20) -> str:
    total = findings.count()
    worst = findings.orderBy(F.desc("severity"), "file", "line_start", "detector").limit(top).collect()
    return "\n".join([f"{total} findings", *(f"{SEVERITIES[r['severity']]:>8}  {r['file']}:{r['line_start'] or 1}  {r['title']}" for r in worst)]) + "\n"
