"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the distinct lower-case words of the whole text and their first four and five
bytes, each hashed to one of BUCKETS columns (presence, not count, so that length has little
say). P(grade > k) = sigmoid(w.x - t_k) with one weight vector for all thresholds and rising
thresholds; the expected severity is the sum of these probabilities over k. Weights are fitted
by accelerated gradient descent with an L2 penalty, over the columns that differ significantly
between toxic and other rows of the sample.

Grades are whole numbers from 0. A table that only says toxic or not is graded first: features
that are significant and mostly in toxic rows are counted, and toxic rows are cut into MILD, MEDIUM and SEVERE by how many distinct ones they
hold. Grade 1 and above still means exactly the label, so the first threshold is the decision.

Fitting takes at most SAMPLE labelled rows, those whose ids hash lowest; it is the one bound on
training and doesn't touch scoring, which reads all rows. What goes to the driver is that
sample's features; what is broadcast is BUCKETS weights.

Null and empty texts have no features and get the intercept's score. Rows with a null label
don't train; one with several labels trains with each. Without labels of two grades nothing is
toxic. Columns other than doc_id, text and the label aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

U64 = np.uint64
BUCKETS = 1 << 18
#: Labelled rows that fitting takes at most.
SAMPLE = 12_000
STEPS, L2 = 300, 1e-4
THRESHOLD = 0.5
#: Standard deviations from which a column counts, and counts where the next grade begins.
SIGNIFICANT, GRADE_EDGES = 4.0, (5, 9)
SCHEMA = "doc_id long, expected_severity double, p_toxic double, grade int, toxic boolean"


def features(data: np.ndarray, offsets: np.ndarray):
    """(document, column) pairs, distinct and in order, of a run of texts."""
    starts, ends, first, (h,) = T.words(data, offsets, T.ALNUM, lower=True)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    low = T._LOWER[data]
    parts = [T.mix(h ^ U64(1))]
    docs = [doc]
    for k in (4, 5):
        long = np.flatnonzero(ends - starts >= k)
        at = starts[long]
        x = np.zeros(len(long), U64)
        for j in range(k):
            x = x * U64(257) + low[at + j].astype(U64)
        parts.append(T.mix(x * U64(16) + U64(k)))
        docs.append(doc[long])
    column = (np.concatenate(parts) % U64(BUCKETS)).astype(np.int64)
    both = np.unique(np.concatenate(docs) * BUCKETS + column)
    return both // BUCKETS, both % BUCKETS


def _each(column):
    """(first row, features) by slices of a batch."""
    data, offsets = T.text_buffers(column)
    for a, b in T.slices(offsets):
        yield a, b, *features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def telling(row, column, positive: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Columns whose share of positive rows differs significantly from the overall share."""
    n1, n = int(positive.sum()), len(positive)
    inside = np.bincount(column, positive[row], buckets)
    expected = np.bincount(column, minlength=buckets) * (n1 / max(1, n))
    return np.abs(inside - expected) >= SIGNIFICANT * np.sqrt(expected + 0.1)


class Ordinal:
    """Cumulative-link logistic regression over rows given as (row, column) pairs."""

    def __init__(self, buckets: int = BUCKETS):
        self.weight, self.edges = np.zeros(buckets), np.zeros(0)

    def fit(self, row, column, grade, steps: int = STEPS, l2: float = L2):
        """Accelerated gradient descent on the summed log-losses of all thresholds."""
        grade = np.asarray(grade)
        top = int(grade.max()) if len(grade) else 0
        if not len(grade) or top == 0 or grade.min() == top:
            return self
        n, buckets = len(grade), len(self.weight)
        keep = telling(row, column, grade > 0, buckets)[column]
        row, column = row[keep], column[keep]
        used, at = np.unique(column, return_inverse=True)
        above = np.stack([grade > k for k in range(top)], 1).astype(float)
        share = np.clip(above.mean(0), 1 / (2 * n), 1 - 1 / (2 * n))
        state = np.concatenate((np.zeros(len(used)), -np.log(share / (1 - share))))
        v = np.ones(len(used))
        for _ in range(20):  # the largest curvature, by power iteration
            v = v / max(1e-12, np.linalg.norm(v))
            v = np.bincount(at, np.bincount(row, v[at], n)[row], len(used))
        rate = 1 / (0.25 * top * (np.linalg.norm(v) + n) / n + l2)
        ahead, t = state, 1.0
        for _ in range(steps):
            w, edges = ahead[: len(used)], ahead[len(used) :]
            z = np.bincount(row, w[at], n)
            off = (1 / (1 + np.exp(-np.clip(z[:, None] - edges, -500, 500))) - above) / n
            g = np.concatenate((np.bincount(at, off.sum(1)[row], len(used)) + l2 * w, -off.sum(0)))
            new = ahead - rate * g
            new[len(used) :] = np.maximum.accumulate(new[len(used) :])
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, state, t = new + (t - 1) / t2 * (new - state), new, t2
        self.weight[used], self.edges = state[: len(used)], state[len(used) :]
        return self

    def above(self, row, column, n: int) -> np.ndarray:
        """P(grade > k) for each row and k."""
        z = np.bincount(row, self.weight[column], n)
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.edges, -500, 500)))


def grades(row, column, toxic: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Grades 1 to 3 for toxic rows by their number of toxic words, 0 for others."""
    more = np.bincount(column, toxic[row], buckets) > 0.5 * np.bincount(column, minlength=buckets)
    strong = telling(row, column, toxic, buckets) & more
    held = np.bincount(row, strong[column], len(toxic))
    return np.where(toxic, 1 + sum((held >= e).astype(int) for e in GRADE_EDGES), 0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, graded: bool = False) -> Ordinal:
    """From a bounded sample of labelled rows; graded: the label already has more than 0 and 1."""
    T.small_batches(docs.sparkSession)
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y >= 0 and doc_id is not null")
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")

    def run(batches):
        for batch in batches:
            found = []
            for a, b, row, column in _each(batch.column(2)):
                cuts = np.searchsorted(row, np.arange(b - a + 1))
                found += [column[cuts[i] : cuts[i + 1]].astype(np.int32).tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "y", "columns"])

    rows = sorted(tuple(r) for r in train.mapInArrow(run, "doc_id long, y int, columns binary").toLocalIterator())
    column = [np.frombuffer(r[2], np.int32) for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(c) for c in column])
    column = np.concatenate(column).astype(np.int64) if column else np.zeros(0, np.int64)
    y = np.array([r[1] for r in rows], np.int64)
    if not graded:
        y = grades(row, column, y > 0)
    return Ordinal().fit(row, column, y)


def severities(docs: DataFrame, model: Ordinal, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs, as SCHEMA."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.edges))

    def run(batches):
        own = Ordinal(1)
        own.weight, own.edges = shared.value
        for batch in batches:
            p = [own.above(row, column, b - a) for a, b, row, column in _each(batch.column(1))]
            p = np.concatenate(p) if p else np.zeros((0, len(own.edges)))
            toxic = p[:, 0] if p.shape[1] else np.zeros(len(p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(1)), pa.array(toxic), pa.array((p >= 0.5).sum(1).astype(np.int32)), pa.array(toxic >= threshold)], names=["doc_id", "expected_severity", "p_toxic", "grade", "toxic"])

    T.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def without_toxic(docs: DataFrame, model: Ordinal, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that aren't toxic, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.edges))
    at = docs.columns.index("text")

    def run(batches):
        own = Ordinal(1)
        own.weight, own.edges = shared.value
        for batch in batches:
            p = [own.above(row, column, b - a) for a, b, row, column in _each(batch.column(at))]
            p = np.concatenate(p) if p else np.zeros((0, len(own.edges)))
            keep = p[:, 0] < threshold if p.shape[1] else np.ones(batch.num_rows, bool)
            yield batch.filter(pa.array(keep))

    T.small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = T.table(spark, sf_dir, "documents")
    return severities(docs, fit(docs, T.table(spark, sf_dir, "labels")))
