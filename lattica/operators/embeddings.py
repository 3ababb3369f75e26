"""node2vec: skip-gram vectors with negative sampling over uniform random walks.

Walks are drawn in tasks from the graph's arrays, which pass the driver once and are broadcast (about 8
bytes an edge and 8 a node). What grows with walks and vectors never meets in one place: nodes are dealt
into P buckets by place, pairs of a centre and a context into P x P blocks, each distinct pair once with its
count. In a round, task i holds the centre vectors of bucket i and the context vectors of bucket i + r and
goes through the block of both; P rounds are an epoch. Vectors travel between rounds as files in the shared
folder, of which those of the last round are kept.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..folders import shared
from . import kernels

#: Places a bucket holds, so that a training task takes about 1 GB; fewer on small graphs, for parallel tasks.
BUCKET, LEAST = 500_000, 8_000
#: Buckets that a graph of many nodes has at least.
SPREAD = 12
#: Start nodes whose walks are held at once.
STARTS = 4096
#: Pairs that share a draw of contexts as negatives (fewer on small tables), and contexts drawn for them.
GROUP, DRAWN = 128, 16
#: Pairs of a step at most, and the weight of a pair in a step; a pair counted more often has several turns.
STEP, TURN = 2048, 8
#: Length that a vector's change in a step has at most: what holds hubs, which meet many pairs of a step, steady.
CLIP = 1.0
#: Rows of a matrix, and pairs, that travel as one value.
ROWS, PAIRS = 4096, 1_000_000

#: Values are large: pages and row groups are closed after a few of them, not after a hundred.
_PAGES = {"compression": "none", "parquet.block.size": 2**24, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1, "parquet.enable.dictionary": "false"}

_BLOCK = "i int, j int, c binary, x binary, n binary"
_STATE = "kind int, bucket int, part int, vectors binary, counts binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 mixed bits of each unsigned integer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _drawn(keys: np.ndarray, turn: int, below) -> np.ndarray:
    """A number below `below` for each key."""
    bits = _mixed(keys + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(32)
    return (bits * np.asarray(below, np.uint64) >> np.uint64(32)).astype(np.int64)


def walk_keys(places: np.ndarray, per_node: int, seed: int) -> np.ndarray:
    return _mixed(np.repeat(places.astype(np.uint64), per_node) * np.uint64(per_node) + np.tile(np.arange(per_node, dtype=np.uint64), len(places)) + np.uint64(seed * 0xD1342543DE82EF95 % 2**64))


def walk_arrays(start: np.ndarray, near: np.ndarray, places: np.ndarray, length: int, per_node: int, seed: int) -> np.ndarray:
    """A row for each walk of each place; a walk that reaches a place without neighbours stays (-1 follows)."""
    keys = walk_keys(places, per_node, seed)
    walks = np.full((len(keys), length), -1, np.int32)
    walks[:, 0] = at = np.repeat(places, per_node)
    going = np.arange(len(keys))
    for step in range(1, length):
        first, degree = start[at], start[at + 1] - start[at]
        if (degree == 0).any():
            alive = degree > 0
            going, first, degree = going[alive], first[alive], degree[alive]
        at = near[first + _drawn(keys[going], step, degree)]
        walks[going, step] = at
    return walks


def window_pairs(walks: np.ndarray, keys: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and contexts: each place of a walk sees up to 1 to `window` places on both sides, drawn for it."""
    wide = np.stack([_drawn(keys, 1000 + p, window) + 1 for p in range(walks.shape[1])], 1)
    centres, contexts = [], []
    for d in range(1, min(window, walks.shape[1] - 1) + 1):
        a, b = walks[:, :-d], walks[:, d:]
        for centre, context, w in ((a, b, wide[:, :-d]), (b, a, wide[:, d:])):
            seen = (w >= d) & (a >= 0) & (b >= 0)
            centres.append(centre[seen])
            contexts.append(context[seen])
    return (np.concatenate(centres), np.concatenate(contexts)) if centres else (np.zeros(0, np.int32),) * 2


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray, now: np.ndarray | None = None, clip: float = CLIP) -> None:
    """to[at] += rows, also for repeated places, whose sum is shortened to `clip`. Changes `rows`. now: to[at], if it is there."""
    order = np.argsort(at)
    a = at[order]
    again = np.flatnonzero(a[1:] == a[:-1]) + 1
    if len(again):
        lead = np.arange(len(a))
        lead[again] = 0
        np.maximum.accumulate(lead, out=lead)
        first, later = order[lead[again]], order[again]
        np.add.at(rows, first, rows.take(later, axis=0))
        rows[later] = rows.take(first, axis=0)
    square = np.einsum("ij,ij->i", rows, rows)
    long = np.flatnonzero(square > clip * clip)
    if len(long):
        rows[long] *= (clip / np.sqrt(square[long]))[:, None]
    rows += to.take(at, axis=0) if now is None else now
    to[at] = rows


def train_block(w, v, noise, c, x, n, rates: tuple[float, float], negatives: int, rng) -> None:
    """One pass over pairs (c, x) counted n: SGD on log s(w v) plus, for `negatives` contexts drawn from noise,
    log s(-w v), in steps of pairs that hardly share a row. Changes w and v."""
    turns = np.ceil(n / TURN).astype(np.int64)
    order = rng.permutation(np.repeat(np.arange(len(c), dtype=np.int32), turns))
    share = (n / turns).astype(np.float32)
    cdf = np.cumsum(noise, dtype=np.float64)
    cdf /= cdf[-1]
    eighth = min(len(w), len(v)) // 8
    group = max(1, min(GROUP, eighth))
    step = max(group, min(STEP, eighth) // group * group)
    for k in range(0, len(order), step):
        own = order[k : k + step]
        rate = rates[0] + (rates[1] - rates[0]) * k / len(order)
        b, groups = len(own), -(-len(own) // group)
        weight = np.zeros(groups * group, np.float32)
        weight[:b] = share[own] * np.float32(rate)
        own = np.concatenate((own, np.repeat(own[:1], groups * group - b)))  # filled up with pairs of weight 0
        ci, xi = c[own], x[own]
        a, p = w.take(ci, axis=0), v.take(xi, axis=0)
        drawn = np.minimum(np.searchsorted(cdf, rng.random(groups * DRAWN)), len(cdf) - 1)
        others = v.take(drawn, axis=0).reshape(groups, DRAWN, -1)
        pull = weight / (1 + np.exp(np.clip(np.einsum("ij,ij->i", a, p), -10, 10)))
        a3 = a.reshape(groups, group, -1)
        push = np.matmul(a3, others.transpose(0, 2, 1))
        np.clip(push, -10, 10, out=push)
        np.negative(push, out=push)
        np.exp(push, out=push)
        push += 1
        push = (weight * np.float32(-negatives / DRAWN)).reshape(groups, group, 1) / push
        push[drawn.reshape(groups, 1, DRAWN) == xi.reshape(groups, group, 1)] = 0
        gain = np.matmul(push, others).reshape(len(own), -1)
        less = np.matmul(push.transpose(0, 2, 1), a3).reshape(len(drawn), -1)
        gain += pull[:, None] * p
        _add_rows(w, ci, gain, a)
        _add_rows(v, np.concatenate((xi, drawn)), np.concatenate((pull[:, None] * a, less)))


def _block_rows(keys: np.ndarray, counts: np.ndarray, buckets: int, size: int):
    """Rows of _BLOCK for sorted keys (block, c, x)."""
    import pyarrow as pa

    block = keys // (size * size)
    ends = np.append(np.flatnonzero(np.diff(block)) + 1, len(keys)) if len(keys) else np.zeros(0, np.int64)
    low = 0
    for end in ends:
        for at in range(low, end, PAIRS):
            k = keys[at : min(at + PAIRS, end)]
            inside = k % (size * size)
            row = [[int(block[low]) // buckets - 1], [int(block[low]) % buckets], [(inside // size).astype(np.int32).tobytes()], [(inside % size).astype(np.int32).tobytes()], [counts[at : min(at + PAIRS, end)].astype(np.float32).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["i", "j", "c", "x", "n"])
        low = end


def _state_rows(kind: int, bucket: int, vectors: np.ndarray, counts: np.ndarray | None):
    import pyarrow as pa

    for part, at in enumerate(range(0, len(vectors), ROWS)):
        row = [[kind], [bucket], [part], [vectors[at : at + ROWS].tobytes()], [b"" if counts is None else counts[at : at + ROWS].tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["kind", "bucket", "part", "vectors", "counts"])


def _joined(parts: list, column: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(p[column] for p in parts), kind)


class _Files:
    """Tables in a folder of their own below the shared one."""

    def __init__(self, spark):
        self.spark, self.root = spark, f"{shared(spark)}/node2vec-{uuid.uuid4().hex}"

    def kept(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.options(**_PAGES).partitionBy(*by).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def skip_gram(edges: DataFrame, length: int = 20, per_node: int = 10, size: int = 128, window: int = 5, negatives: int = 5, epochs: int = 5, rates: tuple[float, float] = (0.025, 0.0001), seed: int = 1, most: int = kernels.MOST_EDGES, buckets: int | None = None) -> DataFrame:
    """id, embedding of every node of an edge to another node, by `per_node` walks from each over edges in
    both directions. Rows: their vectors as centres after `epochs` passes over all pairs of all walks."""
    spark = edges.sparkSession
    ids, start, near = kernels.undirected_arrays(edges, most)
    total = len(ids)
    if not total:
        return spark.createDataFrame([], "id long, embedding array<double>")
    buckets = min(total, buckets or max(min(SPREAD, -(-total // LEAST)), -(-total // BUCKET)))
    held = -(-total // buckets)
    files, graph, names = _Files(spark), spark.sparkContext.broadcast((start, near)), spark.sparkContext.broadcast(ids)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)

    def pairs(batches):
        start, near = graph.value
        for batch in batches:
            mine = batch.column(0).to_numpy()
            for at in range(0, len(mine), STARTS):
                places = mine[at : at + STARTS]
                walks = walk_arrays(start, near, places, length, per_node, seed)
                c, x = (a.astype(np.int64) for a in window_pairs(walks, walk_keys(places, per_node, seed), window))
                key = ((c % buckets + 1) * buckets + x % buckets) * (held * held) + c // buckets * held + x // buckets
                seen = walks[walks >= 0].astype(np.int64)  # how often each place occurs, as block -1
                key = np.concatenate((key, seen % buckets * (held * held) + seen // buckets))
                yield from _block_rows(*np.unique(key, return_counts=True), buckets, held)

    def merged(table):
        import pyarrow as pa

        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        c, x, n = (np.concatenate([np.frombuffer(v.as_buffer(), t) for v in table[k]]) for k, t in (("c", np.int32), ("x", np.int32), ("n", np.float32)))
        key, where = np.unique(c * np.int64(held) + x, return_inverse=True)
        counts = np.bincount(where, n)
        return pa.Table.from_batches(_block_rows(((i + 1) * buckets + j) * (held * held) + key, counts, buckets, held))

    def first(batches):
        for batch in batches:
            for row in batch.to_pylist():
                j, x, n = row["j"], np.frombuffer(row["x"], np.int32), np.frombuffer(row["n"], np.float32)
                here = len(range(j, total, buckets))
                noise = np.zeros(here, np.float32)
                noise[x] = n**0.75
                reach = np.sqrt(6 / (2 * size))
                rng = np.random.default_rng((seed, j))
                yield from _state_rows(0, j, ((2 * rng.random((here, size), np.float32) - 1) * np.float32(reach)), None)
                yield from _state_rows(1, j, np.zeros((here, size), np.float32), noise)

    def trained(turn, progress):
        ends = tuple(rates[0] - (rates[0] - rates[1]) * p for p in progress)

        def task(batches):
            kept = {0: [], 1: [], 2: []}
            for batch in batches:
                for row in batch.to_pylist():
                    kept[row["kind"]].append((row["part"], row["bucket"], row["vectors"], row["x"], row["counts"]))
            if not kept[0]:
                return
            centre, context, blocks = (sorted(kept[k], key=lambda r: (r[0], r[2][:64], r[3][:64])) for k in range(3))
            w, v = (_joined(rows, 2, np.float32).reshape(-1, size).copy() for rows in (centre, context))
            noise = _joined(context, 4, np.float32)
            if blocks:
                rng = np.random.default_rng((seed, turn, centre[0][1]))
                train_block(w, v, noise, _joined(blocks, 2, np.int32), _joined(blocks, 3, np.int32), _joined(blocks, 4, np.float32), ends, negatives, rng)
            yield from _state_rows(0, centre[0][1], w, None)
            yield from _state_rows(1, context[0][1], v, noise)

        return task

    def named(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                w = np.frombuffer(row["vectors"], np.float32).astype(np.float64)
                at = (np.arange(len(w) // size) + row["part"] * ROWS) * buckets + row["bucket"]
                yield pa.RecordBatch.from_arrays([pa.array(names.value[at]), pa.ListArray.from_arrays(pa.array(np.arange(0, len(w) + 1, size, dtype=np.int32)), pa.array(w))], ["id", "embedding"])

    try:
        spark.conf.set(cleanup, "true")
        tasks = max(spark.sparkContext.defaultParallelism, -(-total // (4 * STARTS)))
        raw = spark.range(0, total, 1, min(tasks, -(-total // 256))).mapInArrow(pairs, _BLOCK)
        blocks = files.kept(raw.groupBy("i", "j").applyInArrow(merged, _BLOCK).withColumn("r", F.when(F.col("i") < 0, -1).otherwise(F.pmod(F.col("j") - F.col("i"), F.lit(buckets)))), "blocks", "r")
        state = files.kept(blocks.where("r = -1").select("i", "j", "c", "x", "n").mapInArrow(first, _STATE), "0")
        rounds = epochs * buckets
        for turn in range(rounds):
            r = turn % buckets
            moved = state.select(F.when(F.col("kind") == 0, F.col("bucket")).otherwise(F.pmod(F.col("bucket") - r, F.lit(buckets))).alias("task"), "kind", "bucket", "part", "vectors", F.lit(b"").alias("x"), "counts")
            moved = moved.union(blocks.where(F.col("r") == r).select("i", F.lit(2), "j", F.lit(0), "c", "x", "n"))
            state = files.kept(moved.repartitionById(buckets, "task").drop("task").mapInArrow(trained(turn, (turn / rounds, (turn + 1) / rounds)), _STATE), str(turn + 1))
            files.drop(str(turn))
        files.drop("blocks")
    finally:
        if before is None:
            spark.conf.unset(cleanup)
        else:
            spark.conf.set(cleanup, before)
    return state.where("kind = 0").mapInArrow(named, "id long, embedding array<double>")
