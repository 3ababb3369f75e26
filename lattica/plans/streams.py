"""Streaming queries, run over the events table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import projection as P
from ..streaming import changes as C
from .registry import query, rounded


def _events(spark, sf_dir):
    schema = P.table(spark, sf_dir, "events").schema
    s = C.read(spark, sf_dir, schema, "events.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts))::BIGINT AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL HAVING time_bucket(INTERVAL 6 HOUR, min(ts)) + INTERVAL 6 HOUR <= {CLOSED}")
def stream_tumbling(spark, sf_dir):
    out = C.drained(C.tumbling(_events(spark, sf_dir), "6 hours", "1 hour"), spark, "tumbling")
    return rounded(out.select(F.unix_micros("start").alias("start_us"), "event_type", "n", "total"), "total", digits=4)


@query(f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT epoch_us(min(ts))::BIGINT AS start_us, user_id, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}""")
def stream_session(spark, sf_dir):
    out = C.drained(C.sessions(_events(spark, sf_dir), "30 minutes", "1 hour"), spark, "session")
    return out.select(F.unix_micros("start").alias("start_us"), "user_id", "n")


@query("SELECT event_id FROM events")
def stream_dedup(spark, sf_dir):
    e = _events(spark, sf_dir)
    return C.drained(C.distinct(e.union(e), ["event_id"], "1 hour").select("event_id"), spark, "dedup")
