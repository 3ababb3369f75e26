"""Analytics over commits: co-change, ownership, churn. `rows` has hash, author, ts, age_days and
file, each file of a commit once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..folders import tasks

HALF_LIFE, LEAST_WEIGHT, MOST_FILES, LEAST_DECAY = 90.0, 0.5, 30, 0.001


def analysed(rows: DataFrame, half_life: float = HALF_LIFE, most_files: int = MOST_FILES, least_decay: float = LEAST_DECAY) -> DataFrame:
    """Rows of commits that count, with decay = 2 ** (-age / half_life). Commits older than the
    decay limit and those with too many files don't count."""
    size = F.count(F.lit(1)).over(Window.partitionBy("hash"))
    decay = F.exp(F.lit(-math.log(2)) * F.col("age_days") / half_life)
    return rows.withColumn("decay", decay).where(F.col("decay") >= least_decay).withColumn("size", size).where(F.col("size") <= most_files).drop("size")


def pairs(counted: DataFrame, least_weight: float = LEAST_WEIGHT, many: bool = False) -> DataFrame:
    """a < b, weight (decayed), n (commits) of files that change together. Self join on the commit
    key only; a commit has at most MOST_FILES rows. many: pairs hardly repeat, so they
    are dealt to a number of tasks that follows the files before they are counted."""
    left = counted.select("hash", F.col("file").alias("a"), "decay")
    right = counted.select("hash", F.col("file").alias("b"))
    both = left.join(right, "hash").where("a < b")
    if many:
        both = both.repartition(4 * tasks(counted), "a", "b")
    both = both.groupBy("a", "b").agg(F.sum("decay").alias("weight"), F.count(F.lit(1)).alias("n"))
    return both.where(F.col("weight") >= least_weight)


def file_totals(counted: DataFrame) -> DataFrame:
    return counted.groupBy("file").agg(F.sum("decay").alias("weight"), F.count(F.lit(1)).alias("n"))


def confidence(found: DataFrame, totals: DataFrame) -> DataFrame:
    """min(n_ab / n_a, n_ab / n_b)."""
    a, b = totals.select(F.col("file").alias("a"), F.col("n").alias("n_a")), totals.select(F.col("file").alias("b"), F.col("n").alias("n_b"))
    return found.join(a, "a").join(b, "b").select("a", "b", "weight", "n", F.least(F.col("n") / F.col("n_a"), F.col("n") / F.col("n_b")).alias("confidence"))


def lift(found: DataFrame, counted: DataFrame) -> DataFrame:
    """(w_ab + 1)(T + n^2) / ((w_a + n)(w_b + n)), n files, T the weight of all commits."""
    totals = file_totals(counted)
    whole = counted.select("hash", "decay").distinct().agg(F.sum("decay").alias("t")).crossJoin(totals.agg(F.count(F.lit(1)).alias("n_files")))  # one row
    a, b = totals.select(F.col("file").alias("a"), F.col("weight").alias("w_a")), totals.select(F.col("file").alias("b"), F.col("weight").alias("w_b"))
    n = F.col("n_files")
    value = (F.col("weight") + 1) * (F.col("t") + n * n) / ((F.col("w_a") + n) * (F.col("w_b") + n))
    return found.join(a, "a").join(b, "b").crossJoin(F.broadcast(whole)).select("a", "b", "weight", value.alias("lift"))


def coupling_degree(counted: DataFrame, many: bool = False) -> DataFrame:
    """file, degree: distinct partners before any weight filter."""
    all_pairs = pairs(counted, 0.0, many).select("a", "b")
    return all_pairs.union(all_pairs.select("b", "a")).groupBy(F.col("a").alias("file")).agg(F.count(F.lit(1)).alias("degree"))


def hidden_coupling(found: DataFrame, degree: DataFrame, structural: DataFrame, hub: int, least_n: int = 3, least_confidence: float = 0.15) -> DataFrame:
    """Pairs with enough commits and confidence, no structural link, and no hub at either end."""
    calm = degree.where(F.col("degree") <= hub).select("file")
    known = structural.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    kept = found.where((F.col("n") >= least_n) & (F.col("confidence") >= least_confidence)).join(known, ["a", "b"], "left_anti")
    return kept.join(calm.select(F.col("file").alias("a")), "a", "left_semi").join(calm.select(F.col("file").alias("b")), "b", "left_semi").select("a", "b", "weight", "n", "confidence")


def ownership(rows: DataFrame, half_life: float = 150.0) -> DataFrame:
    """file, author, doa, norm: degree of authorship and its min-max normalisation in the file.

    doa = 3.293 + 1.098 first + 0.164 DL - 0.321 ln(1 + AC): first for the author of the oldest
    commit, DL the author's decayed commits, AC those of others."""
    decay = F.exp(F.lit(-math.log(2)) * F.col("age_days") / half_life)
    by = rows.repartition(tasks(rows), "file").groupBy("file", "author").agg(F.sum(decay).alias("dl"), F.min(F.struct("ts", "hash")).alias("first_at"), F.min("age_days").alias("last_age"))
    w = Window.partitionBy("file")
    by = by.withColumn("fa", (F.col("first_at") == F.min("first_at").over(w)).cast("double")).withColumn("ac", F.sum("dl").over(w) - F.col("dl"))
    doa = 3.293 + 1.098 * F.col("fa") + 0.164 * F.col("dl") - 0.321 * F.log(1 + F.greatest("ac", F.lit(0.0)))
    by = by.withColumn("doa", doa)
    low, high = F.min("doa").over(w), F.max("doa").over(w)
    norm = F.when(high == low, 1.0).otherwise((F.col("doa") - low) / (high - low))
    return by.select("file", "author", "doa", norm.alias("norm"), "last_age")


def bus_factor(owned: DataFrame, least_norm: float = 0.75, least_doa: float = 3.293) -> DataFrame:
    """file, bus_factor (authors in the strict sense), hhi of normalised authorship (1 if none)."""
    is_author = ((F.col("norm") > least_norm) & (F.col("doa") > least_doa)).cast("long")
    s = F.sum("norm")
    hhi = F.when(s <= 0, 1.0).otherwise(F.sum(F.col("norm") * F.col("norm")) / (s * s))
    return owned.groupBy("file").agg(F.sum(is_author).alias("bus_factor"), hhi.alias("hhi"))


def module_ownership(per_file: DataFrame, modules: DataFrame) -> DataFrame:
    """module, files, avg_bus_factor, p10_bus_factor (value at ceil(n / 10) - 1), avg_hhi, at_risk
    (share with one author or none), risk in 0..1."""
    j = per_file.join(modules, "file")
    agg = j.groupBy("module").agg(F.count(F.lit(1)).alias("files"), F.avg("bus_factor").alias("avg_bus_factor"), F.sort_array(F.collect_list("bus_factor")).alias("all"), F.avg("hhi").alias("avg_hhi"), F.avg((F.col("bus_factor") <= 1).cast("double")).alias("at_risk"))
    p10 = F.element_at("all", F.ceil(F.col("files") * 0.1).cast("int"))
    risk = F.greatest(F.lit(0.0), 1 - F.col("avg_bus_factor") / 5) * 0.4 + F.col("avg_hhi") * 0.3 + F.col("at_risk") * 0.3
    return agg.select("module", "files", "avg_bus_factor", p10.alias("p10_bus_factor"), "avg_hhi", "at_risk", F.least(F.lit(1.0), F.greatest(F.lit(0.0), risk)).alias("risk"))


def churn(rows: DataFrame, days: float = 90.0, high: int = 5) -> DataFrame:
    """file, commits, authors, last_age over the last `days`, with a high-churn flag."""
    recent = rows.where(F.col("age_days") <= days)
    return recent.groupBy("file").agg(F.count(F.lit(1)).alias("commits"), F.countDistinct("author").alias("authors"), F.min("age_days").alias("last_age")).withColumn("high", F.col("commits") >= high)


def fix_velocity(rows: DataFrame) -> DataFrame:
    """file, within 24, 48 and 72 hours: commits that follow an earlier one of the file so soon."""
    gap = (F.lag("age_days").over(Window.partitionBy("file").orderBy(F.col("ts"), F.col("hash"))) - F.col("age_days")) * 24
    g = rows.withColumn("gap", gap).where("gap is not null")
    return g.groupBy("file").agg(*(F.sum((F.col("gap") <= h).cast("long")).alias(f"within_{h}h") for h in (24, 48, 72)))
