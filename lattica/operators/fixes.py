"""Text rewrites for findings that have a safe mechanical fix: one projection over their lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: detector -> (pattern, replacement), Java regular expressions.
REWRITES = {
    "implicit-coercion": (r"(?<![=!<>])(==|!=)(?!=)", "$1="),
    "require-grad-typo": (r"\brequire_grad\b", "requires_grad"),
    "forward-method": (r"\.forward\(", "("),
    "InsecureTlsDetector": (r"verify\s*=\s*False", "verify=True"),
    "PickleDeserializationDetector": (r"yaml\.load\(", "yaml.safe_load("),
    "torch-load-unsafe": (r"torch\.load\(([^()]*)\)", "torch.load($1, weights_only=True)"),
    "insecure-crypto": (r"hashlib\.(md5|sha1)\(", "hashlib.sha256("),
    "django-security": (r"^(\s*DEBUG\s*=\s*)True", "$1False"),
    "insecure-random": (r"\brandom\.(choice|randint|randrange|random)\(", "secrets.SystemRandom().$1("),
    "debug-code": (r"^\s*(print|pprint|console\.(log|debug)|breakpoint|dbg!|println!)\s*\(.*$|^\s*debugger;?\s*$", ""),
}


def suggested(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """file, line_no, detector, before, after of findings whose line a rewrite changes."""
    j = findings.join(lines.select(F.col("path").alias("file"), F.col("line_no").alias("line_start"), F.col("text").alias("before")), ["file", "line_start"])
    after = reduce(lambda w, kv: w.when(F.col("detector") == kv[0], F.regexp_replace("before", kv[1][0], kv[1][1])), REWRITES.items(), F.when(F.lit(False), F.col("before"))).otherwise(F.col("before"))
    return j.withColumn("after", after).where("before != after").select("file", F.col("line_start").alias("line_no"), "detector", "before", "after")
