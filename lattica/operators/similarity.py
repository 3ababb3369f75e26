"""Similarity the engine has for code: duplicate windows, Jaccard over shingles, MinHash bands,
exact and quantised nearest neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..folders import shared

HASHES, BANDS = 100, 20
#: Queries whose scores against a block a task holds at once.
SLICE = 64


def duplicate_windows(lines: DataFrame, size: int = 6) -> DataFrame:
    """text of each run of `size` non-blank lines that occurs more than once, with its count and
    number of files. lines: doc_id, line_no, line."""
    kept = lines.where("trim(line) != ''").withColumn("line", F.trim("line"))
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(0, size - 1)
    runs = kept.withColumn("run", F.collect_list("line").over(w)).where(F.size("run") == size)
    return runs.groupBy(F.array_join("run", "\n").alias("text")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("files")).where("n > 1")


def shingles(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, distinct k-word shingles of texts (as strings), for texts of at least k words."""
    w = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    d = docs.select("doc_id", w.alias("w")).where(F.size("w") >= k)
    return d.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.array_join(F.slice("w", i + 1, k), " ")))).alias("shingle"))


def jaccard_classes(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, representative: the smallest doc_id with the same shingle set (Jaccard 1), for every
    text that has shingles. Pairs of all documents are the pairs of representatives, expanded by
    this, and those inside a class."""
    sets = shingles(docs, k).groupBy("doc_id").agg(F.sort_array(F.collect_set("shingle")).alias("set"))
    # Joined on the sets' own values: a hash of a set alone could unite two classes.
    return sets.join(sets.groupBy("set").agg(F.min("doc_id").alias("representative")), "set").select("doc_id", "representative")


def _copies(sets: DataFrame) -> DataFrame:
    """a, b, jaccard of each text and the first with the same shingle set."""
    first = sets.groupBy("name", "n").agg(F.min("doc_id").alias("a"))
    return sets.select("doc_id", "name", "n").join(first, ["name", "n"]).where("doc_id != a").select("a", F.col("doc_id").alias("b"), F.lit(1.0).alias("jaccard"))


def _hashed(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, set, n, name of texts, and rep, set, n of the first of each class of equal sets. A shingle is
    its 64-bit hash and a set's name the MD5 of those, so strings stay where they are; a shuffle holds 8
    bytes a shingle. Unequal shingles of one pair share a hash with probability below 1e-12."""
    shared(docs.sparkSession)
    w = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    d = docs.select("doc_id", w.alias("w")).where(F.size("w") >= k)
    own = d.select("doc_id", F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.xxhash64(F.array_join(F.slice("w", i + 1, k), " ")))).alias("own"))
    sets = own.groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("own")))).alias("set"))
    sets = sets.select("doc_id", "set", F.size("set").alias("n"), F.md5(F.array_join(F.transform("set", lambda x: x.cast("string")), ",")).alias("name")).checkpoint()
    first = sets.groupBy("name", "n").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return sets, sets.join(first, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "set", "n")


def _verified(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """a, b, jaccard of the candidates that reach `least`. The first texts of pairs meet their sets once
    for all their pairs."""
    x, y = reps.select(F.col("rep").alias("a"), F.col("set").alias("x")), reps.select(F.col("rep").alias("b"), F.col("set").alias("y"))
    by = pairs.groupBy("b").agg(F.collect_list("a").alias("as")).join(y, "b").select("b", "y", F.explode("as").alias("a"))
    k = F.size(F.array_intersect("x", "y"))
    return by.join(x, "a").select("a", "b", (k / (F.size("x") + F.size("y") - k)).alias("jaccard")).where(F.col("jaccard") >= least)


def jaccard_pairs(docs: DataFrame, least: float = 0.7, k: int = 3) -> DataFrame:
    """a < b, jaccard of all pairs at or above `least`, by prefix filtering: with shingles ordered
    from rare to common, similar sets share one among their first size - ceil(least * size) + 1.
    Texts with equal shingle sets are compared once, as the first of their class; each other one is
    paired with that first at 1.0, so a group of n copies takes n - 1 rows and no link is lost."""
    sets, reps = _hashed(docs, k)
    rare = sets.select(F.explode("set").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = reps.select("rep", "n", F.explode("set").alias("shingle")).join(rare, "shingle").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    # Shingles of one text alone come first: ranks of the others follow them.
    ranked = ranked.select("rep", "n", F.posexplode("shared").alias("pos", "x"), (F.col("n") - F.size("shared")).alias("own")).select("rep", "n", "x.shingle", (F.col("own") + F.col("pos") + 1).alias("rank"))
    prefix = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1)
    other = prefix.toDF("b", "m", "shingle", "at")
    # The first shared shingle's ranks bound the overlap; a pair too far apart by all its ranks isn't a candidate.
    near = F.least(F.col("n") - F.col("rank"), F.col("m") - F.col("at")) + 1 >= F.lit(least / (1 + least)) * (F.col("n") + F.col("m")) - 1e-6
    pairs = prefix.select(F.col("rep").alias("a"), "n", "shingle", "rank").join(other, "shingle").where((F.col("a") < F.col("b")) & (F.least("n", "m") >= F.lit(least) * F.greatest("n", "m")) & near).select("a", "b").distinct()
    return _verified(pairs, reps, least).union(_copies(sets))


def _bands(hashes: int = HASHES, bands: int = BANDS, seed: int = 17):
    """A vectorised function from arrays of hashes to one number for each band of minima."""
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 2**63, hashes).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, hashes).astype(np.uint64)

    def run(sets: pd.Series) -> pd.Series:
        out = []
        for s in sets:
            h = np.asarray(s, np.int64).view(np.uint64)
            h = h ^ (h >> np.uint64(32))
            low = (odd[:, None] * h[None, :] + add[:, None]).min(1).reshape(bands, -1)
            key = np.arange(bands, dtype=np.uint64)
            for column in low.T:
                key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out.append(key.view(np.int64))
        return pd.Series(out)

    return F.pandas_udf(run, "array<long>")


def minhash_pairs(docs: DataFrame, least: float = 0.7, k: int = 3) -> DataFrame:
    """The same pairs (copies with the first of their class) with candidates from MinHash bands (BANDS of HASHES / BANDS rows), verified
    exactly. Signatures are minima of universal hashes (a * h + b, a odd, modulo 2^64)."""
    sets, reps = _hashed(docs, k)
    # The universal hashes of a shingle's 64-bit hash are vector arithmetic.
    band = _bands()(F.col("set"))
    buckets = reps.select("rep", "n", F.explode(band).alias("bucket"))
    other = buckets.toDF("b", "m", "bucket")
    pairs = buckets.select(F.col("rep").alias("a"), "n", "bucket").join(other, "bucket").where((F.col("a") < F.col("b")) & (F.least("n", "m") >= F.lit(least) * F.greatest("n", "m"))).select("a", "b").distinct()
    return _verified(pairs, reps, least).union(_copies(sets))


def estimated_jaccard(x: str, y: str):
    """The share of places where two signatures of equal length have the same minimum."""
    same = F.zip_with(x, y, lambda a, b: (a == b).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, v: s + v) / F.size(x)


def _blocks(vectors: DataFrame, size: int):
    n = max(1, vectors.count() // size)
    return vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("part"), "vec_id", F.col("embedding").cast("array<double>").alias("v")), n


def nearest_exact(queries: DataFrame, vectors: DataFrame, k: int, block: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: cosine top k of a stated query set against all rows, scored in
    blocks: each block of vectors meets each block of queries once and returns k rows a query."""
    v, parts = _blocks(vectors, block)
    q, groups = _blocks(queries, 2_000)
    left = v.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.col("part") * groups + g))).select("pair", "vec_id", "v")
    right = q.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: p * groups + F.col("part")))).select("pair", F.col("vec_id").alias("query_id"), "v")

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        ids, x = a["vec_id"].to_numpy(), np.stack(a["v"].to_numpy())
        qid, y = b["query_id"].to_numpy(), np.stack(b["v"].to_numpy())
        x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
        by = np.argsort(ids, kind="stable")
        ids, x = ids[by], x[by]
        parts = []
        for i in range(0, len(y), SLICE):
            s = y[i : i + SLICE] @ x.T
            s[qid[i : i + SLICE, None] == ids[None, :]] = -np.inf
            rough = np.round(s, 12)
            if k < s.shape[1]:
                at, to = np.nonzero(rough >= -np.partition(-rough, k - 1, axis=1)[:, k - 1 : k])
            else:
                at, to = np.nonzero(rough > -np.inf)
            order = np.lexsort((to, -rough[at, to], at))  # ties: the smaller id
            at, to = at[order], to[order]
            first = np.arange(len(at)) - np.searchsorted(at, at) < k
            at, to = at[first], to[first]
            parts.append(pd.DataFrame({"query_id": qid[i + at], "vec_id": ids[to], "score": s[at, to]}))
        out = pd.concat(parts)
        return out[np.isfinite(out["score"])]

    got = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInPandas(score, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "score")


class Quantizer:
    """Seeded random rotation, then 4-bit levels that suit a normal coordinate, scaled by the norm."""

    #: Positive optimal 16-level quantiser points of the standard normal.
    POINTS = (0.1284, 0.3881, 0.6568, 0.9424, 1.2562, 1.6181, 2.0690, 2.7326)

    def __init__(self, dims: int, seed: int = 42):
        q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
        self.rotation = q * np.sign(np.diag(r))
        levels = np.concatenate((-np.array(self.POINTS)[::-1], self.POINTS)) / np.sqrt(dims)
        self.levels, self.edges = levels, (levels[1:] + levels[:-1]) / 2

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(packed codes, two to a byte; norms)."""
        norm = np.linalg.norm(x, axis=1)
        unit = x / np.maximum(norm, 1e-30)[:, None]
        code = np.searchsorted(self.edges, unit @ self.rotation).astype(np.uint8)
        code = np.pad(code, ((0, 0), (0, code.shape[1] % 2)))
        return code[:, ::2] | code[:, 1::2] << 4, norm

    def decode(self, packed: np.ndarray, dims: int) -> np.ndarray:
        code = np.stack((packed & 15, packed >> 4), 2).reshape(len(packed), -1)[:, :dims]
        return self.levels[code] @ self.rotation.T


def nearest_quantized(queries: DataFrame, vectors: DataFrame, k: int, dims: int, factor: int = 4, seed: int = 42) -> DataFrame:
    """query_id, rank, vec_id, score: a shortlist of k * factor by quantised cosine, then the exact
    cosine on the reconstruction of the query and the original vectors."""
    v, parts = _blocks(vectors, 20_000)
    q, groups = _blocks(queries, 2_000)
    left = v.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.col("part") * groups + g))).select("pair", "vec_id", "v")
    right = q.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: p * groups + F.col("part")))).select("pair", F.col("vec_id").alias("query_id"), "v")

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        quant = Quantizer(dims, seed)
        ids, x = a["vec_id"].to_numpy(), np.stack(a["v"].to_numpy())
        qid, y = b["query_id"].to_numpy(), np.stack(b["v"].to_numpy())
        unit = quant.decode(quant.encode(x)[0], dims)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-30)
        y = y / np.linalg.norm(y, axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        parts = [slice_(ids, x, unit, qid[i : i + SLICE], y[i : i + SLICE]) for i in range(0, len(y), SLICE)]
        return pd.concat(parts)

    def slice_(ids, x, unit, qid, y):
        rough = y @ unit.T
        rough[qid[:, None] == ids[None, :]] = -np.inf
        short = np.argsort(-rough, axis=1, kind="stable")[:, : k * factor]
        exact = np.einsum("qd,qsd->qs", y, x[short])
        exact[~np.isfinite(np.take_along_axis(rough, short, 1))] = -np.inf
        top = np.argsort(-exact, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"query_id": np.repeat(qid, top.shape[1]), "vec_id": ids[np.take_along_axis(short, top, 1)].ravel(), "score": np.take_along_axis(exact, top, 1).ravel()})
        return out[np.isfinite(out["score"])]

    got = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInPandas(score, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "score")
