"""Distributions, thresholds, surprise and roles over long tables of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpoint_folder

LEAST_VALUES = 40
#: Shares that the lines of one trigram are dealt into.
SHARES = 8
#: Trigrams whose prices (a key and two numbers, about 100 bytes as a hash table) are broadcast.
MOST_PRICED = 500_000


#: Distinct values that one task orders.
RUN = 500_000


def running(df: DataFrame, by: list[str], order: str, count: str, upto: str) -> DataFrame:
    """Adds the running sum of a count in order of a value, within groups `by`. Rows are dealt by ranges of
    group and value; each range adds up its own, and the sums before a range come from one row a
    range and group, so no group is one task's to sort."""
    checkpoint_folder(df.sparkSession)
    n = max(1, df.count() // RUN)
    placed = df.repartitionByRange(n, *by, order).withColumn("_part", F.spark_partition_id()).checkpoint()
    own = Window.partitionBy("_part", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = placed.groupBy("_part", *by).agg(F.sum(count).alias("_s"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", *by, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    return placed.withColumn("_own", F.sum(count).over(own)).join(before, ["_part", *by]).withColumn(upto, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def ranked(values: DataFrame) -> DataFrame:
    """(metric, value) as (metric, value, copies, below): counts aggregated before any ordering,
    so what is ordered is one row for each distinct value."""
    counts = values.where("value is not null").groupBy("metric", "value").agg(F.count(F.lit(1)).alias("copies"))
    return running(counts, ["metric"], "value", "copies", "upto").withColumn("below", F.col("upto") - F.col("copies"))


def distribution(values: DataFrame, shares=(0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """metric, n, mean, stddev (population), percentiles by nearest rank round(p * (n - 1)), max."""
    r = ranked(values)
    mean_of = F.sum(F.col("value") * F.col("copies"))
    r = r.join(r.groupBy("metric").agg(F.sum("copies").alias("n")), "metric")
    at = [F.max(F.when((F.floor(F.lit(p) * (F.col("n") - 1) + 0.5) >= F.col("below")) & (F.floor(F.lit(p) * (F.col("n") - 1) + 0.5) < F.col("upto")), F.col("value"))).alias(f"p{int(p * 100)}") for p in shares]
    s = r.groupBy("metric").agg(F.max("n").alias("n"), (mean_of / F.sum("copies")).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("value") * F.col("value") * F.col("copies")) / F.sum("copies") - F.pow(mean_of / F.sum("copies"), 2))).alias("stddev"), *at, F.max("value").alias("max"))
    return s


def adaptive_threshold(profile: DataFrame, default_warn: float, default_high: float) -> DataFrame:
    """metric, warn, high: the larger of default and percentile where there are enough values."""
    enough = F.col("n") >= LEAST_VALUES
    return profile.select("metric", F.when(enough, F.greatest(F.lit(default_warn), F.col("p90"))).otherwise(default_warn).alias("warn"), F.when(enough, F.greatest(F.lit(default_high), F.col("p95"))).otherwise(default_high).alias("high"))


def z_scores(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Adds z = (value - mean) / population deviation, 0 for a constant group. Moments are
    aggregated map-side and joined back, so no group is one task's window."""
    by = by or []
    m = df.groupBy(*by).agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_sd"))
    j = df.join(m, by) if by else df.crossJoin(F.broadcast(m))  # one row on the right
    return j.withColumn("z", F.when(F.col("_sd") > 0, (F.col(column) - F.col("_mean")) / F.col("_sd")).otherwise(0.0)).drop("_mean", "_sd")


def mahalanobis(df: DataFrame, x: str, y: str, ridge: float = 1e-6) -> DataFrame:
    """Adds the distance of (x, y) from the mean under the population covariance plus a ridge."""
    m = df.agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), (F.var_pop(x) + ridge).alias("_a"), (F.var_pop(y) + ridge).alias("_d"), F.covar_pop(x, y).alias("_b"))
    j = df.crossJoin(F.broadcast(m))  # one row on the right
    dx, dy, det = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my"), F.col("_a") * F.col("_d") - F.col("_b") * F.col("_b")
    square = (F.col("_d") * dx * dx - 2 * F.col("_b") * dx * dy + F.col("_a") * dy * dy) / det
    return j.withColumn("distance", F.sqrt(F.greatest(F.lit(0.0), square))).drop("_mx", "_my", "_a", "_b", "_d")


def percentile_bucket(df: DataFrame, score: str, name: str, key: str = "id") -> DataFrame:
    """Adds the integer percentile floor(rank * 100 / n), rank from 0 by (score, key): the running count
    over ranges of both, so neither distinct scores nor ties are one task's to sort."""
    one = df.withColumn("_at", F.struct(score, key)).withColumn("_one", F.lit(1).cast("long"))
    n = df.count()
    return running(one, [], "_at", "_one", "_upto").withColumn(name, F.floor((F.col("_upto") - 1) * 100 / F.lit(n)).cast("long")).drop("_at", "_one", "_upto")


def interpolated_percentile(value, p25, p50, p75, p90):
    """Piecewise linear percentile of a value between four quartile marks."""
    def part(low, high, a, b):
        return F.lit(a) + F.when(high > low, (value - low) / (high - low) * (b - a)).otherwise(0.0)

    return F.when(value <= p25, F.when(p25 > 0, value / p25 * 25.0).otherwise(25.0)).when(value <= p50, part(p25, p50, 25.0, 50.0)).when(value <= p75, part(p50, p75, 50.0, 75.0)).when(value <= p90, part(p75, p90, 75.0, 90.0)).otherwise(F.least(F.lit(99.0), F.lit(90.0) + F.when(p90 > 0, (value - p90) / p90 * 10.0).otherwise(0.0)))


def role(fan_in, fan_out, exported, is_test, central, spread):
    """The first role that fits: Test, Hub, Utility, EntryPoint, Orchestrator, Leaf, Unknown."""
    return F.when(is_test, "Test").when(central, "Hub").when((fan_in >= 10) | (spread >= 5), "Utility").when(exported & (fan_in <= 2), "EntryPoint").when(fan_out >= 10, "Orchestrator").when((fan_in <= 2) & (fan_out <= 2), "Leaf").otherwise("Unknown")


def precision_weights(df: DataFrame, columns: list[str]) -> DataFrame:
    """signal, weight: inverse variance of each signal, normalised to 1."""
    inverse = [F.when(F.var_pop(c) > 0, 1 / F.var_pop(c)).otherwise(0.0).alias(c) for c in columns]
    one = df.agg(*inverse)
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("signal"), (F.col(c) / total).alias("weight")) for c in columns))).alias("x")).select("x.*")


def trigram_surprisal(lines: DataFrame, k: float = 0.1, least_tokens: int = 5000, most_priced: int = MOST_PRICED) -> DataFrame:
    """doc_id, line_no, bits: mean bits a token of each line under an add-k trigram model learnt
    from all lines (unseen contexts use the unigram); 0 where the model or the line is too short.

    lines: doc_id, line_no, tokens. Counts are aggregated map-side; prices of up to `most_priced` trigrams
    are broadcast by key, more of them meet the lines by shuffles."""
    checkpoint_folder(lines.sparkSession)
    gram = F.transform("tokens", lambda t, i: F.struct(F.when(i >= 2, F.get("tokens", (i - 2).cast("int"))).alias("p2"), F.when(i >= 1, F.get("tokens", (i - 1).cast("int"))).alias("p1"), t.alias("t")))
    every = lines.select(F.explode(gram).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("c3")).select("g.*", "c3").checkpoint()  # line starts included
    whole = every.groupBy("t").agg(F.sum("c3").alias("c1")).agg(F.sum("c1").alias("total"), F.count(F.lit(1)).alias("v"))
    c3 = every.where("p2 is not null")
    priced = c3.join(c3.groupBy("p2", "p1").agg(F.sum("c3").alias("c2")).hint("merge"), ["p2", "p1"]).crossJoin(F.broadcast(whole))  # one row
    price = (-F.log2((F.col("c3") + k) / (F.col("c2") + k * F.col("v")))).alias("price")
    key = F.xxhash64("p2", "p1", "t").alias("key")
    keyed = priced.select(key, "p2", "p1", "t", price, "total").checkpoint()
    kinds = keyed.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys")).first()
    flat = lines.select("doc_id", "line_no", F.explode(gram).alias("g")).select("doc_id", "line_no", "g.*").where("p2 is not null")
    if kinds["n"] <= most_priced and kinds["n"] == kinds["keys"]:
        # Keys of 64 bits that no two trigrams share: the prices go to the lines, and a line's sum is made where it is.
        j = flat.select("doc_id", "line_no", key).join(F.broadcast(keyed.select("key", "price", "total")), "key").withColumn("n", F.lit(1))
    else:
        # A common trigram is on very many lines: it is there once for each share, and lines pick one.
        dealt = keyed.drop("key").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        # A line's own trigrams are counted where the line is; what is shuffled is a row for each kind.
        three = flat.groupBy("doc_id", "line_no", "p2", "p1", "t").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(SHARES)).cast("int"))
        j = three.join(dealt.hint("merge"), ["p2", "p1", "t", "share"])
    bits = j.groupBy("doc_id", "line_no").agg((F.sum(F.col("price") * F.col("n")) / F.sum("n")).alias("bits"), F.max("total").alias("total"))
    return lines.select("doc_id", "line_no").join(bits.hint("merge"), ["doc_id", "line_no"], "left").select("doc_id", "line_no", F.when(F.col("total") >= least_tokens, F.col("bits")).otherwise(0.0).alias("bits"))
