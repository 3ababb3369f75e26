"""Event-time windows, sessions, deduplication and findings deltas over file streams.

Each `run_*` drives a stream to the end of what is there (availableNow) and returns the result
as a table; in production the same queries keep running with a processing-time trigger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import shared


def folder(spark: SparkSession, name: str) -> str:
    """State and results go to the shared folder the cluster names."""
    return f"{shared(spark)}/streams/{name}-{uuid.uuid4().hex}"


def read(spark: SparkSession, path: str, schema, name_filter: str = "*.parquet") -> DataFrame:
    """A directory as a stream of Parquet files."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name_filter).parquet(path)


def drained(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """What an append stream wrote by the time all input was read."""
    target, state = folder(spark, name), folder(spark, f"{name}-state")
    q = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def tumbling(events: DataFrame, size: str, late: str) -> DataFrame:
    """Counts and sums by event type and window; windows are final once the watermark passes."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """A row for each user's run of events no further apart than the gap."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("session_window.start").alias("start"), "user_id", "n")


def distinct(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def apply_changes(stream: DataFrame, spark: SparkSession, state_path: str, key: str, out) -> None:
    """foreachBatch: each batch of (key, hash, deleted) is compared with the state table; rows that
    are new, changed or removed go to `out(changes, epoch)` and the state is replaced as a new
    version, so a batch that is run again finds the version before it."""
    name = f"{state_path}/v"

    def batch(rows: DataFrame, epoch: int) -> None:
        last = rows.groupBy(key).agg(F.max(F.struct("ts", "hash", "deleted")).alias("x")).select(key, "x.hash", "x.deleted")
        old = spark.read.parquet(f"{name}{epoch - 1}") if epoch else spark.createDataFrame([], f"{key} string, hash string")
        j = last.join(old.withColumnRenamed("hash", "old"), key, "left")
        kind = F.when(F.col("deleted"), "removed").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("hash"), "changed")
        out(j.withColumn("change", kind).where("change is not null and not (deleted and old is null)").select(key, "change"), epoch)
        kept = old.join(last, key, "left_anti").unionByName(last.where("not deleted").select(key, "hash"))
        kept.write.mode("overwrite").parquet(f"{name}{epoch}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{state_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
