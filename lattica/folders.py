"""The shared folder for checkpoints, state and tables between steps."""

from __future__ import annotations

import tempfile


def tasks(df, mb: float = 8) -> int:
    """Tasks for a shuffle of rows read from these files, so that a task's share doesn't grow with them: one
    for each `mb` MB of files, at least as many as the session has."""
    leaves, size = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        own = int(leaves.apply(i).stats().sizeInBytes())
        size += own if own < 1 << 50 else 0  # of checkpoints nothing is known
    return min(20_000, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size / (mb * 2**20)) + 1))


def shared(spark) -> str:
    """The folder that spark.checkpoint.dir names, or the one set on the context. Only a session that
    runs on this one machine may do without, as in tests: it gets a temporary folder, once."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")
