"""Quality by regularised quadratic discriminant analysis.

Each document becomes a fixed number of statistics of its whole text, transformed towards
normality (logarithms of lengths, arcsines of shares). Per class, counts, sums and products are
summed over all labelled training rows (each task sends one small row for each class); class
covariances shrink towards the pooled one and a multiple of the identity. A score is the
posterior of label 1 from the difference of Mahalanobis log-densities, by Cholesky factors that
are computed once and sent with the job. Model size depends on the number of statistics only.

Null and empty texts have all statistics at their empty value and get a score like any other.
Rows without a label, with a null one or with one other than 0 and 1 don't train; a doc_id that
has several labels trains with each. Without both classes the score is the share of class 1 (0.5
if there are no labels). Labels, lang, source and doc_id are no inputs of a score. Columns other
than doc_id, text and the label aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import textops as T

#: Shrinkage towards the pooled covariance and towards the identity; decision threshold.
POOL, RIDGE, THRESHOLD = 0.1, 0.02, 0.3
FOLDS = 5
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

_UPPER = T.byte_class([(65, 90)])
_LOWER = T.byte_class([(97, 122), (128, 255)])
_DIGIT = T.byte_class([(48, 57)])
_MARK = T.byte_class([(33, 47), (58, 64), (91, 96), (123, 126)])
_PLAIN = T.byte_class([(39, 39), (44, 44), (46, 46)])


def _sum(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text."""
    n_bytes = np.diff(offsets)
    starts, ends, first, (h,) = T.words(data, offsets, T.SPACED)
    n = np.diff(first)
    size = ends - starts
    doc = np.repeat(np.arange(len(n)), n)
    words, chars = np.maximum(n, 1), np.maximum(n_bytes, 1)
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    if len(h):
        new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=len(n))
    runs = np.diff(np.append(np.flatnonzero(new), len(h))) if len(h) else np.zeros(0, np.int64)
    most = np.zeros(len(n), np.int64)
    np.maximum.at(most, doc[order][new], runs)
    again = np.zeros(len(h), bool)
    pair = np.zeros(len(h), bool)
    if len(h):
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        two = T.window_hash(h, 2)
        o2 = np.lexsort((two, doc[:-1])) if len(two) else np.zeros(0, np.int64)
        same = (two[o2][1:] == two[o2][:-1]) & (doc[:-1][o2][1:] == doc[:-1][o2][:-1])
        pair[o2[1:][same]] = True
    upper, lower, digit = _UPPER[data], _LOWER[data], _DIGIT[data]
    mark = _MARK[data] & ~_PLAIN[data]
    line = data == 10
    bar = data == 124
    lone = np.bincount(doc, weights=(size == 1), minlength=len(n))
    last = data[ends - 1] if len(ends) else data[:0]
    marked = np.bincount(doc, weights=_MARK[last] & ~_PLAIN[last], minlength=len(n))
    stop = np.bincount(doc, weights=(last == 46), minlength=len(n))
    mean = np.bincount(doc, weights=size, minlength=len(n)) / words
    spread = np.sqrt(np.maximum(0, np.bincount(doc, weights=size.astype(float) ** 2, minlength=len(n)) / words - mean**2))

    def share(x, of):
        return np.arcsin(np.sqrt(np.clip((x + 0.0) / of, 0, 1)))

    return np.stack([
        np.log1p(n), np.log1p(mean), np.log1p(spread),
        share(_sum(upper, offsets), chars), share(_sum(digit, offsets), chars), share(_sum(mark, offsets), chars),
        share(_sum(bar, offsets), chars), share(marked, words), share(stop, words), share(lone, words),
        np.log1p(distinct) / np.log1p(words), share(most, words),
        share(np.bincount(doc, weights=again, minlength=len(n)), words), share(np.bincount(doc, weights=pair, minlength=len(n)), words),
        np.log1p(_sum(line, offsets)) - np.log1p(n), share(_sum(lower, offsets), chars),
    ], 1)


def _rows(batch_column):
    data, offsets = T.text_buffers(batch_column)
    out = [statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in T.slices(offsets)]
    return np.concatenate(out) if out else np.zeros((0, WIDTH))


WIDTH = statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]


class Discriminant:
    """Fitted from counts, sums and products of both classes."""

    def __init__(self, count: np.ndarray, total: np.ndarray, product: np.ndarray, pool: float = POOL, ridge: float = RIDGE):
        self.prior = float((count[1] + 1) / (count.sum() + 2))
        self.fitted = bool((count > 1).all())
        if not self.fitted:
            return
        mean = total / count[:, None]
        scatter = product - count[:, None, None] * mean[:, :, None] * mean[:, None, :]
        pooled = scatter.sum(0) / count.sum()
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-12))
        self.mean = mean / self.scale
        outer = np.outer(self.scale, self.scale)
        self.factor, self.log_det = [], []
        for c in (0, 1):
            cov = ((1 - pool) * scatter[c] / count[c] + pool * pooled) / outer
            cov = (1 - ridge) * cov + ridge * np.eye(len(cov))
            low = np.linalg.cholesky(cov)
            self.factor.append(np.linalg.inv(low))
            self.log_det.append(2 * np.log(np.diag(low)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.prior)
        x = x / self.scale
        density = [-0.5 * (((x - self.mean[c]) @ self.factor[c].T) ** 2).sum(1) - 0.5 * self.log_det[c] for c in (0, 1)]
        logit = np.clip(density[1] - density[0] + np.log(self.prior / (1 - self.prior)), -500, 500)
        return 1 / (1 + np.exp(-logit))


def held_out(folds: int = FOLDS):
    """Rows of one fold by the checksum of their id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def described(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of each row, made once: texts don't move, 8 * WIDTH bytes a row do."""

    def run(batches):
        for batch in batches:
            x = _rows(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    spark = docs.sparkSession
    T.small_batches(spark)
    B.checkpoints(spark)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x binary").checkpoint()


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, WIDTH)


def fit(described_docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS) -> Discriminant:
    """From all labelled rows outside the held-out fold."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1)").where(~held_out(folds))
    train = described_docs.join(rows, "doc_id").select("y", "x")

    def moments(batches):
        count, total, product = np.zeros(2), np.zeros((2, WIDTH)), np.zeros((2, WIDTH, WIDTH))
        for batch in batches:
            y, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for c in (0, 1):
                own = x[y == c]
                count[c] += len(own)
                total[c] += own.sum(0)
                product[c] += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(count), *(pa.array([a[c].ravel().tolist() for c in (0, 1)], pa.list_(pa.float64())) for a in (total, product))], names=["y", "n", "s", "p"])

    sums = train.mapInArrow(moments, "y int, n double, s array<double>, p array<double>").select("y", F.concat(F.array("n"), "s", "p").alias("v"))
    sums = sums.select("y", F.posexplode("v")).groupBy("y", "pos").agg(F.sum("col").alias("v")).orderBy("y", "pos").collect()  # 2 classes by 1 + d + d * d
    if not sums:
        return Discriminant(np.zeros(2), np.zeros((2, WIDTH)), np.zeros((2, WIDTH, WIDTH)))
    v = np.array([r["v"] for r in sums]).reshape(2, -1)
    return Discriminant(v[:, 0], v[:, 1 : 1 + WIDTH], v[:, 1 + WIDTH :].reshape(2, WIDTH, WIDTH))


def scores(described_docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD, folds: int = FOLDS) -> DataFrame:
    def run(batches):
        for batch in batches:
            p = model.score(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return described_docs.select("doc_id", held_out(folds).alias("held_out"), "x").mapInArrow(run, SCHEMA)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = described(T.table(spark, sf_dir, "documents"))
    return scores(docs, fit(docs, T.table(spark, sf_dir, "labels")))
