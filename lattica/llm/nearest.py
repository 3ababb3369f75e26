"""Approximate nearest neighbours by multiprobe p-stable hashing.

Inner products become distances on a sphere: vectors are dealt into ranges of norms (RANGES to
each factor of two below the largest), divided by the largest norm of their range and get one more coordinate
that fills their norm up to 1; queries are scaled to norm 1. A range of no more vectors than a
query has probes is taken whole. Each of TABLES
hash tables has HASHES Gaussian projections cut into steps of WIDTH. A query visits its own
bucket and PROBES - 1 perturbed ones, in the order of their expected success: the order of sets
of perturbations is computed once from the expected squared distances to bucket borders, ranked
from near to far, and a query only ranks its own borders. Candidates of all tables are merged
and scored exactly, in double precision, on the original vectors.

Vectors are dealt by their id into parts of about PART vectors, and queries into blocks; the
tables of a part are built where it is scored, so no bucket is ever one task's burden and equal
vectors are spread over all parts. Only candidates are scored: single precision finds those that
can be among the best, double precision ranks them. A part returns each query's best in one packed
row; where a query's buckets hold fewer than it has to return, all vectors of the part are its
candidates, so each query gets BEST rows, or all there are.

Every row is indexed; recall against brute force (over 0.9 on the test tables) and the share of
pairs that are candidates (about a quarter of them, as the test vectors hardly cluster) are
measured in the tests. Vectors that are null, zero or hold null or non-finite components take no part, nor
do those of another length than most. Null ids take no part; rows that repeat an id are both
candidates, and a query never gets its own id. Ties go to the smaller id. Columns other than
vec_id and embedding aren't read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

BEST = 20
TABLES, HASHES, WIDTH, PROBES = 128, 32, 4.0, 500
#: Vectors of a part and queries of a block: a mask of their pairs fills 16 MB.
PART, QUERY_BLOCK, REPLY = 16_384, 1024, 128
RANGES = 8
#: Bits of a slot that tells a bucket with vectors from one without before it is searched.
SLOT = 20
SCHEMA = "query_id long, rank int, vec_id long, score double"


def perturbations(hashes: int, probes: int) -> np.ndarray:
    """Sets of perturbations, likeliest first, as 0/1 rows over ranked borders (near to far)."""
    m = 2 * hashes
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4.0 * (hashes + 1) * (hashes + 2))
    far = 1 - (m + 1 - j) / (hashes + 1.0) + (m + 1 - j) * (m + 2 - j) / (4.0 * (hashes + 1) * (hashes + 2))
    cost = np.where(j <= hashes, near, far)
    out, heap = [()], [(cost[0], (0,))]
    while heap and len(out) < probes:
        c, s = heapq.heappop(heap)
        if len({min(x, m - 1 - x) for x in s}) == len(s):  # one border of a projection at most
            out.append(s)
        x = s[-1]
        if x + 1 < m:
            heapq.heappush(heap, (c - cost[x] + cost[x + 1], (*s[:-1], x + 1)))
            heapq.heappush(heap, (c + cost[x + 1], (*s, x + 1)))
    rows = np.zeros((len(out), m), np.int64)
    for i, s in enumerate(out):
        rows[i, list(s)] = 1
    return rows


class Tables:
    """Hash functions, equal in every task for a seed. A bucket's key is the sum of its cells, each
    times a random integer small enough for the sum to be exact in double precision; buckets that
    share a key share their vectors, which only adds candidates."""

    def __init__(self, size: int, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size, self.width = size, width
        self.a = rng.normal(size=(tables, size, hashes))
        self.b = rng.uniform(0, width, (tables, 1, hashes))
        self.m = rng.integers(1 << 30, 1 << 40, (tables, hashes)).astype(float)
        self.sets = perturbations(hashes, probes).astype(float)

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.a[table] + self.b[table]) / self.width

    def keys(self, x: np.ndarray, table: int) -> np.ndarray:
        return (np.floor(self.cells(x, table)) @ self.m[table]).astype(np.int64)

    def probe_keys(self, q: np.ndarray, table: int) -> np.ndarray:
        place = self.cells(q, table)
        low = np.floor(place)
        gap = np.concatenate((place - low, 1 - place + low), 1)  # to the border below, above
        rank = np.argsort(gap, axis=1)
        step = np.concatenate((-self.m[table], self.m[table]))[rank]
        return ((low @ self.m[table])[:, None] + step @ self.sets.T).astype(np.int64)


def sphere(x: np.ndarray, largest: float) -> np.ndarray:
    x = x / largest
    return np.concatenate((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))), 1)


def norm_ranges(x: np.ndarray, largest: float) -> list[np.ndarray]:
    """Places of the vectors of each range of norms that has any."""
    norm = np.sqrt((x * x).sum(1))
    place = np.floor(RANGES * np.log2(np.maximum(largest / norm, 1)))
    return [np.flatnonzero(place == p) for p in np.unique(place)]


def candidates(tables: Tables, x: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
    """A mask of queries by vectors: which share a visited bucket in some table."""
    norm = np.sqrt((q * q).sum(1, keepdims=True))
    queries = np.concatenate((q / norm, np.zeros((len(q), 1))), 1)
    mask = np.zeros((len(q), len(x)), bool)
    spheres = []
    for pick in norm_ranges(x, largest):
        if len(pick) <= len(tables.sets):
            mask[:, pick] = True
        else:
            own = x[pick]
            spheres.append((pick, sphere(own, float(np.sqrt((own * own).sum(1)).max()))))
    slots, flat = np.zeros(1 << SLOT, bool), mask.reshape(-1)
    for t in range(len(tables.a) if spheres else 0):
        probe = tables.probe_keys(queries, t).ravel()
        slot = probe & (len(slots) - 1)
        for pick, data in spheres:
            key = tables.keys(data, t)
            own = key & (len(slots) - 1)
            slots[own] = True
            likely = np.flatnonzero(slots[slot])
            slots[own] = False
            order = np.argsort(key, kind="stable")
            bucket, first, size = np.unique(key[order], return_index=True, return_counts=True)
            wanted = probe[likely]
            at = np.minimum(np.searchsorted(bucket, wanted), len(bucket) - 1)
            found = bucket[at] == wanted
            hit, row = at[found], likely[found] // len(tables.sets)
            many = size[hit]
            inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            flat[np.repeat(row * len(x), many) + pick[order[np.repeat(first[hit], many) + inner]]] = True
    return mask


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order, so that equal vectors tie exactly."""
    out = x[..., 0] * q[..., 0]
    for i in range(1, x.shape[-1]):
        out = out + x[..., i] * q[..., i]
    return out


def best_of(ids, scores, best):
    order = np.lexsort((ids, -scores))[:best]
    return ids[order], scores[order]


def search(vectors: DataFrame, is_query, best: int = BEST, tables: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of vectors that is_query holds for."""
    value = F.col("embedding").cast("array<double>")
    sound = F.forall(value, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    square = F.aggregate(value, F.lit(0.0), lambda s, x: s + x * x)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("v")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound & (square > 0))
    shape = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("norm")).orderBy(F.desc("rows"), "n").first()
    if shape is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    dims, largest, total = shape["n"], float(shape["norm"]), shape["rows"]
    rows = rows.where(F.size("v") == dims)
    parts, query_blocks = max(1, -(-total // PART)), max(1, -(-total // (20 * QUERY_BLOCK)))
    options = tables or {}

    def packer(batches):
        for batch in batches:
            part = batch.column(0).to_numpy()
            ids = batch.column(1).to_numpy()
            x = batch.column(2).flatten().to_numpy().reshape(-1, dims)
            for p in np.unique(part):
                pick = part == p
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([ids[pick].tobytes()], pa.binary()), pa.array([x[pick].tobytes()], pa.binary())], names=["part", "ids", "x"])

    def packed(df, count, seed):
        return df.select(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(count)).cast("int").alias("part"), "vec_id", "v").mapInArrow(packer, "part int, ids binary, x binary")

    pairs = parts * query_blocks
    data = packed(rows, parts, 1).withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.lit(query_blocks - 1)), lambda b: F.col("part") * query_blocks + b)))
    asked = packed(rows.where(is_query), query_blocks, 2).withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: p * query_blocks + F.col("part"))))

    def load(rows):
        ids = np.frombuffer(b"".join(rows["ids"].to_pylist()), np.int64)
        x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float64).reshape(-1, dims)
        order = np.argsort(ids, kind="stable")
        return ids[order], x[order]

    def score(data: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if data.num_rows and asked.num_rows:
            ids, x = load(data)
            qids, q = load(asked)
            hashes = Tables(dims + 1, **options)
            mask = candidates(hashes, x, q, largest)
            rough = (x / largest).astype(np.float32)
            for lo in range(0, len(qids), REPLY):
                own, k = q[lo : lo + REPLY], qids[lo : lo + REPLY]
                found = [], [], []
                for i in range(len(own)):
                    others = ids != k[i]
                    near = np.flatnonzero(mask[lo + i] & others)
                    if len(near) < min(best, int(others.sum())):
                        near = np.flatnonzero(others)
                    if len(near) > best:
                        r = rough[near] @ (own[i] / np.abs(own[i]).max()).astype(np.float32)
                        edge = np.partition(r, len(r) - best)[len(r) - best]
                        near = near[r >= edge - 1e-6 * dims]  # more than single precision may err here
                    a, s = best_of(ids[near], exact(x[near], own[i]), best)
                    found[0].append(np.full(len(a), i)), found[1].append(a), found[2].append(s)
                a = [np.concatenate(y) for y in found]
                out.append((int(asked["part"][0].as_py()), lo // REPLY, k.tobytes(), a[0].astype(np.int64).tobytes(), a[1].tobytes(), a[2].tobytes()))
        columns = list(zip(*out)) if out else [()] * 6
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["query_block", "reply", "queries", "query", "ids", "scores"])

    replies = data.repartition(max(1, min(pairs, 4096)), "pair").groupBy("pair").cogroup(asked.groupBy("pair")).applyInArrow(score, "query_block int, reply int, queries binary, query binary, ids binary, scores binary")

    def merge(rows: pa.Table) -> pa.Table:
        names = np.frombuffer(rows["queries"][0].as_py(), np.int64)
        query, ids, scores = (np.frombuffer(b"".join(rows[c].to_pylist()), k) for c, k in (("query", np.int64), ("ids", np.int64), ("scores", np.float64)))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
        keep = rank <= best
        return pa.table({"query_id": names[query[keep]], "rank": pa.array(rank[keep], pa.int32()), "vec_id": ids[keep], "score": scores[keep]})

    return replies.groupBy("query_block", "reply").applyInArrow(merge, SCHEMA)


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    return search(T.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
