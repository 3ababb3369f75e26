"""Benchmark decontamination with Wu-Manber multi-pattern search over words.

A pattern is a window of `window` consecutive words of a benchmark item, or all words of a
shorter item. Patterns of one length are searched together: a table indexed by the hash of a
block of words says how far the search may jump from there, entries with shift 0 lead to the
patterns that end in that block. Patterns whose fingerprints fit are then compared directly: each
word of the text, byte by byte, with the pattern's word.

The patterns of a search are bounded: items are dealt into parts of at most PART_WORDS words
(and one item, should it be longer). Each part is one broadcast and one pass over the
documents; with more than one part, what the passes find is united by document. One pass
needs no shuffle. A worker builds the tables of a part once and keeps those of the last part.

Nulls: a null text has no words. An item with a null item_id still hits words but isn't
counted, and an item_id that occurs on several rows counts once. Empty benchmark: no hits.
Each row of documents gives one row, repeated and null doc_ids included. Columns other than
doc_id, item_id and text aren't read; the filter hands them on, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

U64 = np.uint64
WINDOW = 13
#: Benchmark words in one search: about 20 MB of tables at most.
PART_WORDS = 400_000
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]


class Search:
    """Wu-Manber tables for patterns of one length, as rows of places in a vocabulary."""

    def __init__(self, rows: np.ndarray, vocabulary: Vocabulary):
        self.rows, self.vocabulary = rows, vocabulary
        patterns = vocabulary.prints[rows]
        self.patterns, self.length = patterns, patterns.shape[1]
        self.block = min(2, self.length)
        spread = 1 << int(np.ceil(np.log2(max(1 << 12, 16 * patterns.size))))
        self.mask = U64(min(spread, 1 << 24) - 1)
        shift = np.full(int(self.mask) + 1, min(255, self.length - self.block + 1), np.uint8)
        for end in range(self.block - 1, self.length):
            slot = self.blocks(patterns[:, end - self.block + 1 : end + 1])
            np.minimum.at(shift, (slot & self.mask).astype(np.int64), min(255, self.length - 1 - end))
        self.shift = shift
        suffix = self.blocks(patterns[:, -self.block :])
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def blocks(self, h: np.ndarray) -> np.ndarray:
        return T.mix(h[..., 0] * U64(0x9E3779B97F4A7C15) + h[..., 1]) if self.block == 2 else T.mix(h[..., 0])

    def find(self, h: np.ndarray, text: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of all occurrences in a run of words, edges of documents ignored.
        text: (lower-cased bytes, starts, ends) of the words."""
        n, m = len(h), self.length
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = self.blocks(np.stack([h[:-1], h[1:]], -1)) if self.block == 2 else self.blocks(h[:, None])
        jump = self.shift[(ends & self.mask).astype(np.int64)].tobytes()
        lead, stops, at = self.block - 1, [], m - self.block
        last = len(jump)
        while at < last:  # jumps over what no pattern can end in
            s = jump[at]
            if s:
                at += s
            else:
                stops.append(at)
                at += 1
        stops = np.array(stops, np.int64)
        a = np.searchsorted(self.suffix, ends[stops])
        count = np.searchsorted(self.suffix, ends[stops], "right") - a
        which = np.repeat(np.arange(len(stops)), count)
        pattern = self.order[np.arange(count.sum()) - (np.cumsum(count) - count)[which] + a[which]]
        start = stops[which] + lead - m + 1
        same = np.ones(len(start), bool)
        for j in range(m):
            same[same] = h[start[same] + j] == self.patterns[pattern[same], j]
        start, pattern = start[same], pattern[same]
        if not len(start):
            return start, pattern
        # Windows overlap, so each word of the text is compared once with each word it stands for.
        pair = (start[:, None] + np.arange(m)) * len(self.vocabulary.prints) + self.rows[pattern]
        pairs, at = np.unique(pair, return_inverse=True)
        equal = self.vocabulary.equal(pairs % len(self.vocabulary.prints), pairs // len(self.vocabulary.prints), *text)
        whole = equal[at.reshape(pair.shape)].all(1)
        return start[whole], pattern[whole]


class Vocabulary:
    """The distinct words of items: their bytes laid end to end and their fingerprints."""

    def __init__(self, words: list[bytes], prints: list[int]):
        self.prints = np.array(prints, U64)
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.size = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def equal(self, place: np.ndarray, word: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether words of a text are the words at these places, byte by byte."""
        size = self.size[place]
        out = ends[word] - starts[word] == size
        pick = np.flatnonzero(out)
        size = size[pick]
        heads = np.cumsum(size) - size
        inner = np.arange(size.sum()) - np.repeat(heads, size)
        other = data[np.repeat(starts[word[pick]], size) + inner] != self.data[np.repeat(self.start[place[pick]], size) + inner]
        if len(pick):
            out[pick] = ~np.logical_or.reduceat(other, heads)
        return out


def _patterns(items: list[tuple], window: int):
    """Searches by length, with the items of each pattern."""
    texts = pa.array([t or "" for _, t in items], pa.string())
    data, offsets = T.text_buffers(texts)
    starts, ends, first, (h,) = T.words(data, offsets, T.ALNUM, lower=True)
    raw, number, prints = T.lowered(data).tobytes(), {}, []
    own = np.empty(len(h), np.int64)
    for i, (a, z) in enumerate(zip(starts.tolist(), ends.tolist())):
        word = raw[a:z]
        if (at := number.get(word)) is None:
            at = number[word] = len(prints)
            prints.append(int(h[i]))
        own[i] = at
    vocabulary = Vocabulary(list(number), prints)
    by_length: dict[int, dict[bytes, set]] = {}
    for i, (item, _) in enumerate(items):
        row = own[first[i] : first[i + 1]]
        size = min(window, len(row))
        for k in range(len(row) - size + 1 if size else 0):
            by_length.setdefault(size, {}).setdefault(row[k : k + size].tobytes(), set()).add(item)
    return [(Search(np.frombuffer(b"".join(found), np.int64).reshape(-1, size), vocabulary), [sorted(x for x in s if x is not None) for s in found.values()]) for size, found in sorted(by_length.items())]


#: The tables that a worker built last: (name of the part and window, searches).
_kept: list[tuple] = []


def _tables(name: str, items, window: int):
    if not _kept or _kept[0][0] != (name, window):
        _kept[:] = [((name, window), _patterns(items.value, window))]
    return _kept[0][1]


def _scan(batch, searches, row):
    """Calls row(index, n_words, hit mask of its words, items) for each document."""
    data, offsets = T.text_buffers(batch.column(1))
    for lo, hi in T.slices(offsets):
        own = T.lowered(data[offsets[lo] : offsets[hi]])
        starts, ends, first, (h,) = T.words(own, offsets[lo : hi + 1] - offsets[lo], T.ALNUM)
        hit, items = np.zeros(len(h), bool), {}
        for search, owners in searches:
            start, pattern = search.find(h, (own, starts, ends))
            doc = np.searchsorted(first, start, "right") - 1
            inside = start + search.length <= first[doc + 1] if len(doc) else np.zeros(0, bool)
            start, pattern, doc = start[inside], pattern[inside], doc[inside]
            hit |= T.covered(start, search.length, len(h))
            for d, p in set(zip(doc.tolist(), pattern.tolist())):
                items.setdefault(d, set()).update(owners[p])
        for i in range(hi - lo):
            row(lo + i, int(first[i + 1] - first[i]), hit[first[i] : first[i + 1]], items.get(i, ()))


def _verdict(n_words: int, n_hit: int, items) -> tuple:
    listed = ",".join(sorted(map(str, items)))
    return n_words, n_hit, len(items), hashlib.sha256(listed.encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words


def parts_of(benchmark: DataFrame, part_words: int = PART_WORDS):
    """Items in parts of bounded size, one after the other on the driver."""
    items, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        n = len((row[1] or "").split()) * 2 + 1
        if items and size + n > part_words:
            yield items
            items, size = [], 0
        items.append((row[0], row[1]))
        size += n
    yield items


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """One row for each row of docs, as SCHEMA."""
    spark = docs.sparkSession
    T.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared, name = [spark.sparkContext.broadcast(items) for items in parts_of(benchmark, part_words)], uuid.uuid4().hex

    def once(batches):
        searches = _tables(name, shared[0], window)
        for batch in batches:
            rows = []
            _scan(batch, searches, lambda i, n, hit, items: rows.append(_verdict(n, int(hit.sum()), items)))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, _KINDS))], names=["doc_id", *_NAMES])

    if len(shared) == 1:
        return docs.mapInArrow(once, SCHEMA)

    keyed = docs.withColumn("row", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    found = _united(keyed, shared, window)
    copies = keyed.groupBy(F.col("doc_id").alias("own_id"), F.col("row").alias("own_row")).agg(F.count(F.lit(1)).alias("copies"))
    found = found.join(copies, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("row") == F.col("own_row"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _united(keyed: DataFrame, shared: list, window: int) -> DataFrame:
    """Verdicts over several parts, for each distinct (doc_id, row): rows are told apart by id and
    digest."""

    name = uuid.uuid4().hex

    def part_pass(part):
        def run(batches):
            searches = _tables(f"{name}-{part}", shared[part], window)
            for batch in batches:
                rows = []
                _scan(batch, searches, lambda i, n, hit, items: rows.append((n, np.packbits(hit).tobytes() if hit.any() else b"", sorted(items))))
                columns = list(zip(*rows)) if rows else [()] * 3
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.list_(pa.int64()))], names=["doc_id", "row", "n_words", "bits", "items"])

        return run

    def unite(batches):
        for batch in batches:
            rows = []
            for n, bits, items in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                hit = np.zeros(n, np.uint8)
                for b in bits:
                    if b:
                        hit |= np.unpackbits(np.frombuffer(b, np.uint8), count=n)
                rows.append(_verdict(n, int(hit.sum()), {x for y in items for x in y}))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, _KINDS))], names=["doc_id", "row", *_NAMES])

    passes = [keyed.mapInArrow(part_pass(i), "doc_id long, row string, n_words long, bits binary, items array<long>").dropDuplicates(["doc_id", "row"]) for i in range(len(shared))]
    found = passes[0]
    for p in passes[1:]:
        found = found.unionByName(p)
    found = found.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.collect_list("bits").alias("bits"), F.collect_list("items").alias("items"))
    return found.mapInArrow(unite, "doc_id long, row string, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, in which no word is hit: a long document that holds
    a single passage of the benchmark goes as well, whatever its share of the words (`contaminated`
    of `decontaminate` only reports shares of 5 % or more). One pass without a shuffle if the
    benchmark is one part. Null and empty texts stay, as do rows with null or repeated ids, each
    judged by its own text; an empty benchmark leaves all rows."""
    spark = docs.sparkSession
    T.small_batches(spark)
    shared, name = [spark.sparkContext.broadcast(items) for items in parts_of(benchmark, part_words)], uuid.uuid4().hex
    if len(shared) > 1:
        keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_of(docs).alias("row"))
        bad = _united(keyed, shared, window).where("n_hit > 0").select("doc_id", "row")
        return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (row_of(docs) == bad["row"]), "left_anti")
    at = docs.columns.index("text")

    def run(batches):
        searches = _tables(name, shared[0], window)
        for batch in batches:
            keep: list[bool] = []
            texts = pa.record_batch([batch.column(at), batch.column(at)], names=["doc_id", "text"])
            _scan(texts, searches, lambda i, n, hit, items: keep.append(not hit.any()))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def row_of(docs: DataFrame):
    return F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(T.table(spark, sf_dir, "documents"), T.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark, fold
), pats AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS size, ws[k:k + least(13, len(ws)) - 1] AS g
  FROM items, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS u(k) WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT size FROM pats
), docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, fold
), win AS (
  SELECT doc_id, size, i, ws[i:i + size - 1] AS g FROM docs, sizes, unnest(range(1, greatest(len(ws) - size + 2, 1))) AS u(i)
), hit AS (SELECT doc_id, i, size, item_id FROM win JOIN pats USING (size, g)
), words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + size)) AS r(j) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
