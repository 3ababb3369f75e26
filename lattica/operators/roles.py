"""Roles of classes and functions, what they excuse, and how unusual a module is."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severity of a class finding is multiplied so, by role.
CLASS_SEVERITY = {"FrameworkCore": 0.0, "Facade": 0.3, "Orchestrator": 0.3, "EntryPoint": 0.5, "Utility": 0.7, "DataClass": 0.6, "Application": 1.0}
ORCHESTRATORS = r"Controller|Router|Dispatcher|Handler|Orchestrator|Coordinator"
COUPLING = ("DegreeCentralityDetector", "ShotgunSurgeryDetector", "FeatureEnvyDetector", "InappropriateIntimacyDetector")
#: Lines of a part of a file; places and spans meet in it.
WIDTH = 64
DEAD = ("UnreachableCodeDetector", "DeadCodeDetector")


def class_role(name: Column, methods: Column, complexity: Column, delegates: Column, external: Column, usages: Column, framework: str = r"^(Flask|Django|Express|FastAPI)$") -> Column:
    """The first role that fits a class: its name, then its measures (mean complexity of methods, share
    that only delegate, classes it needs, classes that use it)."""
    return (
        F.when(name.rlike(framework), "FrameworkCore")
        .when(name.rlike(ORCHESTRATORS), "Orchestrator")
        .when((methods >= 5) & (delegates >= 0.6) & (external >= 4) & (complexity <= 3.0), "Orchestrator")
        .when((methods >= 10) & (complexity <= 3.0) & (delegates >= 0.6), "Facade")
        .when((usages >= 5) & (methods >= 10), "EntryPoint")
        .when((complexity <= 1.5) & (methods <= 20), "DataClass")
        .when((methods <= 15) & (usages >= 3), "Utility")
        .otherwise("Application")
    )


def without_excused(findings: DataFrame, functions: DataFrame, roles: DataFrame) -> DataFrame:
    """Findings without coupling ones in utilities, handlers and tests and dead-code ones in handlers and
    tests. functions: id, path, line_start, line_end; roles: id, context. A finding is in the
    innermost function at its line."""
    asked = findings.where(F.col("detector").isin(*COUPLING, *DEAD)).select(F.col("id").alias("finding"), "detector", "file", "line")
    # Places instead of findings, and the winner of each span's functions, meet: neither grows with repeats.
    spans = functions.groupBy(F.col("path").alias("file"), F.col("line_start").alias("line_from"), F.col("line_end").alias("line_to")).agg(F.max("id").alias("id"))
    spans = spans.where("line_from <= line_to").withColumn("part", F.explode(F.sequence(F.floor(F.col("line_from") / WIDTH), F.floor(F.col("line_to") / WIDTH))))
    places = asked.select("file", "line").distinct().withColumn("part", F.floor(F.col("line") / WIDTH))
    inside = places.join(spans, ["file", "part"]).where("line between line_from and line_to")
    best = inside.groupBy("file", "line").agg(F.max_by("id", F.struct("line_from", -F.col("line_to"), "id")).alias("id"))
    at = asked.join(best, ["file", "line"])
    hit = at.join(roles.select("id", "context"), "id")
    calm = F.col("detector").isin(*COUPLING) & F.col("context").isin("Utility", "Handler", "Test") | F.col("detector").isin(*DEAD) & F.col("context").isin("Handler", "Test")
    return findings.join(hit.where(calm).select(F.col("finding").alias("id")), "id", "left_anti")


def module_distance(profiles: DataFrame, features: list[str], ridge: float = 1e-6) -> DataFrame:
    """module, distance: Mahalanobis distance of each module's features from their mean, 0 if there are
    fewer than 3 modules. Moments are one aggregated row; its small matrix is inverted on the driver."""
    f = [F.col(c).cast("double") for c in features]
    pairs = [(i, j) for i in range(len(f)) for j in range(i, len(f))]
    one = profiles.agg(F.count(F.lit(1)).alias("n"), *(F.avg(x).alias(f"m{i}") for i, x in enumerate(f)), *(F.covar_pop(f[i], f[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    if one["n"] < 3:
        return profiles.select("module", F.lit(0.0).alias("distance"))
    cov = np.zeros((len(f), len(f)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = one[f"c{i}_{j}"]
    inverse = np.linalg.inv(cov + ridge * np.eye(len(f)))
    d = [x - F.lit(one[f"m{i}"]) for i, x in enumerate(f)]
    square = sum((d[i] * d[j] * float(inverse[i, j]) for i in range(len(f)) for j in range(len(f))), F.lit(0.0))
    return profiles.select("module", F.sqrt(F.greatest(F.lit(0.0), square)).alias("distance"))
