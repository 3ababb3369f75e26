"""What commits and blame say of files and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIX = r"(?i)fix|bug|patch|hotfix|resolve"
STABLE_DAYS = 180


def enriched(commits: DataFrame) -> DataFrame:
    """file, author, last_modified, commit_count: of the last commit of each file (ties: the larger
    hash), and how many there are."""
    last = F.struct("ts", "hash")
    return commits.groupBy("file").agg(F.max_by("author", last).alias("author"), F.max("ts").alias("last_modified"), F.countDistinct("hash").alias("commit_count"))


def blame_ownership(blame: DataFrame) -> DataFrame:
    """file, author, share of a file's lines. blame: file, line, author."""
    per = blame.groupBy("file", "author").agg(F.count(F.lit(1)).alias("n"))
    return per.join(per.groupBy("file").agg(F.sum("n").alias("total")), "file").select("file", "author", (F.col("n") / F.col("total")).alias("share"))


def top_authors(owned: DataFrame, modules: DataFrame, top: int = 3) -> DataFrame:
    """module, rank, author, weight: the `top` authors by summed normalised authorship."""
    w = owned.join(modules, "file").groupBy("module", "author").agg(F.round(F.sum("norm"), 9).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("module").orderBy(F.desc("weight"), "author"))
    return w.withColumn("rank", rank).where(F.col("rank") <= top).select("module", "rank", "author", "weight")


def weak_labels(findings: DataFrame, commits: DataFrame) -> DataFrame:
    """id, is_true_positive, weight, source: a finding in a file that a fix touched is likely true
    (0.7), one in a file that no commit touched for half a year likely not (0.5); others get no
    label. commits: file, message, age_days."""
    per = commits.groupBy("file").agg(F.max(F.col("message").rlike(FIX)).alias("fixed"), F.min("age_days").alias("last"))
    j = findings.select("id", "file").join(per, "file")
    source = F.when(F.col("fixed"), "fix_commit").when(F.col("last") > STABLE_DAYS, "stable_code")
    return j.withColumn("source", source).where("source is not null").select("id", (F.col("source") == "fix_commit").alias("is_true_positive"), F.when(F.col("fixed"), 0.7).otherwise(0.5).alias("weight"), "source")


def churn(changes: DataFrame) -> DataFrame:
    """file, insertions, deletions, commits, authors, last_modified. changes: file, hash, author, ts,
    insertions, deletions."""
    return changes.groupBy("file").agg(F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.countDistinct("hash").alias("commits"), F.countDistinct("author").alias("authors"), F.max("ts").alias("last_modified"))


def calibration_outliers(calibrated: DataFrame, top: int = 10) -> DataFrame:
    """name, ratio: the `top` thresholds furthest from their default, relative to it; one whose default
    is zero counts as furthest but is left out after the cut. calibrated: name, value, standard."""
    tiny = 2.220446049250313e-16
    gap, standard = F.abs(F.col("value") - F.coalesce("standard", F.lit(0.0))), F.abs(F.coalesce("standard", F.lit(0.0)))
    ratio = F.when(standard > tiny, gap / F.when(standard > tiny, standard)).when(F.abs("value") > tiny, F.lit(float("inf"))).otherwise(0.0)
    return calibrated.select("name", ratio.alias("ratio")).orderBy(F.desc("ratio"), "name").limit(top).where((F.col("ratio") > 0) & (F.col("ratio") < float("inf")))
