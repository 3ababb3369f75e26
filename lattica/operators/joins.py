"""Range, as-of and name-resolution joins as equi joins on buckets or aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def innermost(points: DataFrame, spans: DataFrame, on: str, point: str, start: str, end: str, width: int = 64) -> DataFrame:
    """Each point with the span of the same key that holds it; of several the latest start, then
    the smallest id. Spans are put into every bucket of `width` they touch, so a point meets only
    spans near it. Points outside all spans keep nulls."""
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("_b", F.floor(F.col(point) / width))
    hit = p.join(s, [on, "_b"]).where((F.col(start) <= F.col(point)) & (F.col(point) <= F.col(end)))
    best = hit.groupBy(on, point).agg(F.max(F.struct(F.col(start).alias("s"), (-F.col("id")).alias("neg"))).alias("m"))
    return points.join(best, [on, point], "left").select(on, point, (-F.col("m.neg")).alias("span_id"), F.col("m.s").alias("span_start"))


def overlapping(left: DataFrame, right: DataFrame, on: str, width: int = 64, per_task: int = 5_000_000) -> DataFrame:
    """Pairs of spans (l_id, r_id) with start, end of the same key that overlap. A pair is made in
    the bucket where the later of the two starts, hence once. A task compares about `per_task` pairs."""
    def dealt(df, side):
        return df.select(on, F.col("id").alias(f"{side}_id"), F.col("start").alias(f"{side}_s"), F.col("end").alias(f"{side}_e"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_b"))

    # Shares of the right side, to each of which the left side goes, so that no key is one task's.
    a, b = dealt(left, "l"), dealt(right, "r")
    one = a.groupBy(on, "_b").agg(F.count(F.lit(1)).alias("m")).join(b.groupBy(on, "_b").agg(F.count(F.lit(1)).alias("n")), [on, "_b"]).select((F.col("m") * F.col("n")).alias("k"))
    most, total = one.agg(F.coalesce(F.max("k"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    if (shares := most // per_task + 1) > 1:
        a = a.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        b = b.withColumn("_s", F.pmod(F.xxhash64("r_id", "r_s"), F.lit(shares)).cast("int"))
        keys, tasks = [on, "_b", "_s"], min(20_000, 2 * total // per_task + 1)
        a, b = a.repartition(tasks, *keys).hint("shuffle_hash"), b.repartition(tasks, *keys)
        j = b.join(a, keys)
    else:
        j = a.join(b, [on, "_b"])
    return j.where("l_s <= r_e and l_e >= r_s").where(F.floor(F.greatest("l_s", "r_s") / width) == F.col("_b")).select(on, "l_id", "r_id")


def as_of(queries: DataFrame, values: DataFrame, on: str, at: str) -> DataFrame:
    """Each query row with the last value of its key at or before it. Both sides are one stream by
    key and time; the last value is carried forward in a running window."""
    from pyspark.sql import Window

    q = queries.select(on, at, "query_id", F.lit(None).cast("double").alias("value"), F.lit(None).cast("long").alias("value_id"))
    v = values.select(on, at, F.lit(None).cast("long").alias("query_id"), "value", "value_id")
    w = Window.partitionBy(on).orderBy(F.col(at), F.col("query_id").isNotNull(), F.col("value_id"), F.col("query_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = v.unionByName(q).withColumn("found", F.last(F.when(F.col("value_id").isNotNull(), F.struct("value_id", "value")), True).over(w))
    return seen.where("query_id is not null").select("query_id", on, F.col("found.value_id").alias("value_id"), F.col("found.value").alias("value"))


def unique_names(calls: DataFrame, definitions: DataFrame, name: str) -> DataFrame:
    """Calls resolved by name, dropping names with more than one definition."""
    one = definitions.groupBy(name).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("target")).where("_n = 1").drop("_n")
    return calls.join(one, name)


def callers_of_changed(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Callers of changed nodes that aren't changed themselves."""
    c = changed.select("id").distinct()
    near = edges.join(c.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return near.join(c, "id", "left_anti")
