"""Language-model scores by a probabilistic suffix tree over words.

Tokens are words (A-Z lowered) and one end token a document. The root gives the additive base
distribution (c + 0.1) / (N + 0.1 (V + 1)), whose last share stands for any unseen word. A context
of 1 to DEPTH words is a candidate if it was seen in training at least LEAST times, whatever the
corpus' size, and so are next words after it. A context is retained if its next-word distribution differs from that of its longest
retained suffix by more than the description length of its own counts (log-likelihood gain
against 0.5 log2 N bits for each count). Distributions are smoothed by absolute discounting: the
mass freed goes to the suffix' distribution, so every state's probabilities sum to 1. A token is
scored in the state of the longest retained suffix before it.

Counts cover all training rows. Documents are packed into blocks once and kept in the shared
folder; a block sends each distinct word or word sequence once, with its count, to a range of
keys, where totals are made. Totals go back to the blocks that asked, in the order they asked in,
so that neither the vocabulary nor the tree is anywhere in one place. One of the blocks that hold
a sequence (the first) then sends it to its context's range, which decides on the context and
answers the blocks. A sequence can only reach LEAST if both its context and its own suffix do, so
others aren't asked for. Fingerprints of words and sequences have 64 bits.

Null and empty texts are the end token alone. A null doc_id doesn't train and isn't held out.
Every row is scored on its own, repeated ids too. Without training rows all words are unseen.
Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import textops as T

U64 = np.uint64
DEPTH, LEAST = 3, 4
FOLDS = 10
ALPHA, DISCOUNT = 0.1, 0.75
END = U64(0x0E4D0E4D0E4D0E4D)
STEP = U64(0x9E3779B97F4A7C15)
TEXT_BYTES = 12_000_000
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_in_context long"
_BLOCK = "block long, ids binary, known binary, sizes binary, vocabulary binary, body binary, n_train long"
_SENT = "bucket int, block long, keys binary, counts binary"
_SENT_ON = "bucket int, block long, asks binary, contexts binary, totals binary, sizes binary, parents binary"
_TOLD = "level int, step int, block long, bucket int, body binary"


def _folds(ids: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(held out, trains) for each row."""
    rest = np.array([zlib.crc32(str(i).encode()) % FOLDS if k else -1 for i, k in zip(ids.tolist(), known)], np.int64)
    return rest == 0, rest > 0


def _tokens(data, offsets):
    """(fingerprints, first token of each document) with an end token after each."""
    parts, counts = [], []
    for a, b in T.slices(offsets):
        _, _, first, (h,) = T.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], T.SPACED, lower=True)
        n = np.diff(first)
        out = np.full(len(h) + len(n), END)
        at = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
        out[at] = h
        parts.append(out), counts.append(n + 1)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.concatenate(([0], np.cumsum(n)))


def packed(docs: DataFrame) -> DataFrame:
    """Blocks of about TEXT_BYTES, one row each, kept: the distinct fingerprints of a block's tokens
    in order, and each token as a place among them, so that texts are read once."""

    def run(batches):
        held, size, part, turn = [], 0, TaskContext.get().partitionId(), 0
        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= TEXT_BYTES:
                yield flush(held, (part << 24) + turn)
                held, size, turn = [], 0, turn + 1
        if held:
            yield flush(held, (part << 24) + turn)

    def flush(held, name):
        table = pa.Table.from_batches(held)
        column = table["doc_id"]
        known = np.asarray(column.is_valid().combine_chunks().to_numpy(zero_copy_only=False), np.uint8)
        ids = column.fill_null(B.MOST).to_numpy()
        tokens, first = _tokens(*T.text_buffers(table["text"]))
        sizes = np.diff(first)
        n = int(sizes[_folds(ids, known)[1]].sum())
        keys, at = np.unique(tokens, return_inverse=True)
        row = [ids.tobytes(), known.tobytes(), sizes.astype(np.int64).tobytes(), B.squeeze(keys, True), B.squeeze(at.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *(pa.array([x], pa.binary()) for x in row), pa.array([n], pa.int64())], names=["block", "ids", "known", "sizes", "vocabulary", "body", "n_train"])

    T.small_batches(docs.sparkSession)
    B.checkpoints(docs.sparkSession)
    # No more tasks, and so files, than there are blocks of the operators that deal documents.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).coalesce(B.count_for(docs)).mapInArrow(run, _BLOCK).checkpoint()


def _ranges(keys, counts, part, buckets, block):
    """Entries of a block, given by rising key, in one row for each bucket."""
    order = np.argsort(part.astype(np.uint16) if buckets <= 1 << 16 else part, kind="stable")
    keys, counts, part = keys[order], counts[order], part[order]
    # Only ranges that have keys: a block never sends more rows than keys, however many ranges there are.
    first = np.flatnonzero(np.concatenate((part[:1] == part[:1], part[1:] != part[:-1])))
    rows, cuts = part[first], [*zip(first.tolist(), [*first[1:].tolist(), len(part)])]
    return pa.RecordBatch.from_arrays([
        pa.array(rows, pa.int32()), pa.array([block] * len(rows), pa.int64()),
        pa.array([B.squeeze(keys[a:z], True) for a, z in cuts], pa.binary()),
        pa.array([B.squeeze(counts[a:z].astype(np.uint32)) for a, z in cuts], pa.binary()),
    ], names=["bucket", "block", "keys", "counts"])


def _each(batches):
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for i in range(table.num_rows):
            yield table["block"][i].as_py(), *_unpacked(table.slice(i, 1))


def _unpacked(row: pa.Table):
    """(ids, known, distinct fingerprints, each token's place among them, first tokens) of a block."""
    ids = np.frombuffer(row["ids"][0].as_py(), np.int64)
    known = np.frombuffer(row["known"][0].as_py(), np.uint8).astype(bool)
    sizes = np.frombuffer(row["sizes"][0].as_py(), np.int64)
    keys = B.expand(row["vocabulary"][0].as_py(), U64, True)
    return ids, known, keys, B.expand(row["body"][0].as_py(), np.uint32).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)))


def _totals(rows: pa.Table):
    """(distinct keys, totals, for each row where its keys are)."""
    keys = [B.expand(k, U64, True) for k in rows["keys"].to_pylist()]
    counts = [B.expand(c, np.uint32) for c in rows["counts"].to_pylist()]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)
    return distinct, total, np.split(at, np.cumsum([len(k) for k in keys])[:-1])


class Tree:
    """The model in one place, for small corpora: retained contexts. Words and longer sequences have indices in sorted arrays; a sequence's
    code is (index of its first words) * len(words) + (index of its last word)."""

    def __init__(self, words: np.ndarray, word_counts: np.ndarray, n: int, v: int):
        self.words, self.n, self.v = words, n, v
        self.codes: list[np.ndarray] = []
        self.counts = [word_counts]
        self.retained: list[np.ndarray] = []
        self.rest: list[np.ndarray] = []

    def base(self, count):
        return (count + ALPHA) / (self.n + ALPHA * (self.v + 1))

    def indices(self, word: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """For each token, given its own index or -1, and each length: the index of the sequence that
        ends there, or -1."""
        out = [word]
        start = np.zeros(len(word), bool)
        start[first[:-1][np.diff(first) > 0]] = True
        for codes in self.codes:
            before = np.concatenate(([-1], out[-1][:-1]))
            before[start] = -1
            both = (before >= 0) & (out[0] >= 0)
            found = np.full(len(word), -1)
            code = before[both] * len(self.words) + out[0][both]
            found[both] = _index(codes, code)
            out.append(found)
        return out

    def build(self) -> None:
        """Keeps the contexts whose next words pay for themselves, shortest first."""
        w = len(self.words)
        for d, codes in enumerate(self.codes):
            context, word = codes // w, codes % w
            seen = self.counts[d + 1].astype(float)
            size = self.counts[d].astype(float)
            parent = self.given_parent(d, context, word)
            share = np.maximum(seen - DISCOUNT, 0) / size[context]
            explicit = np.bincount(context, share, len(size))
            known = np.bincount(context, parent, len(size))
            gain = np.bincount(context, seen * np.log2(np.maximum(share + (1 - explicit[context]) * parent, 1e-300) / parent), len(size))
            left = size - np.bincount(context, seen, len(size))
            other = np.maximum(1 - known, 1e-9)
            gain += np.where(left > 0, left * np.log2(np.maximum((1 - explicit) * other, 1e-300) / other), 0)
            price = 0.5 * np.log2(max(2, self.n)) * np.bincount(context, minlength=len(size))
            keep = gain > price
            self.retained.append(keep)
            self.rest.append(np.where(keep, 1 - explicit, 1.0))

    def given_parent(self, d: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """P(word | the longest retained proper suffix of a context of d + 1 words)."""
        w = len(self.words)
        p = self.base(self.counts[0][word].astype(float))
        tails = self.tails(d)[context] if d else None
        for k in range(d):  # suffixes of k + 1 words, shortest first
            at = tails[:, k]
            p = self.step(k, at, word, p)
        return p

    def tails(self, d: int) -> np.ndarray:
        """For sequences of d + 1 words: indices of their suffixes of 1..d words."""
        w = len(self.words)
        codes = self.codes[d - 1]
        out = np.empty((len(codes), d), np.int64)
        out[:, 0] = codes % w
        if d > 1:
            shorter = self.tails(d - 1)[codes // w]
            for k in range(1, d):
                out[:, k] = _index(self.codes[k - 1], np.where(shorter[:, k - 1] >= 0, shorter[:, k - 1] * w + codes % w, -1))
        return out

    def step(self, d: int, context: np.ndarray, word: np.ndarray, p: np.ndarray) -> np.ndarray:
        """p with one more context length taken in (contexts of d + 1 words; -1: none)."""
        ok = context >= 0
        ok[ok] = self.retained[d][context[ok]]
        c = context[ok]
        code = np.where(word[ok] >= 0, c * len(self.words) + word[ok], -1)
        at = _index(self.codes[d], code)
        share = np.where(at >= 0, np.maximum(self.counts[d + 1][at] - DISCOUNT, 0) / self.counts[d][c], 0) if len(self.counts[d + 1]) else 0
        p = p.copy()
        p[ok] = share + self.rest[d][c] * p[ok]
        return p

    def log10(self, word, first, count) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base, model, whether a context was used) for each token, given its index among the
        tree's words and its training count."""
        base = self.base(count.astype(float))
        p, used = base, np.zeros(len(word), bool)
        index = self.indices(word, first)
        start = np.zeros(len(word), bool)
        start[first[:-1][np.diff(first) > 0]] = True
        for d in range(len(self.retained)):
            context = np.concatenate(([-1], index[d][:-1]))
            context[start] = -1
            p = self.step(d, context, index[0], p)
            ok = context >= 0
            used[ok] |= self.retained[d][context[ok]]
        return np.log10(base), np.log10(p), used


def _index(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


class _Tokens:
    """A block's tokens with the probabilities of the levels taken so far. `names` are the rising
    fingerprints of the block's sequences of one length, `totals` their counts in training, and
    `at` the place of the one that ends at a token, or -1 if it has less than `least`."""

    def __init__(self, rows: pa.Table, told: pa.Table, n: int, v: int, least: int):
        self.ids, self.known, self.keys, word, self.first = _unpacked(rows)
        self.told = told
        self.names, self.totals = self.keys, self.answers(0, 0, np.int64)
        self.counts, self.base = self.totals, (self.totals + ALPHA) / (n + ALPHA * (v + 1))  # of words
        self.p, self.used = self.base[word], np.zeros(len(word), bool)
        # Places take 4 bytes, as there are several for each token of a block.
        self.word = word = word.astype(np.int32)
        self.at = np.where(self.totals >= least, np.arange(len(self.keys), dtype=np.int32), np.int32(-1))[word]
        self.trains = np.repeat(_folds(self.ids, self.known)[1], np.diff(self.first))

    def answers(self, level: int, step: int, kind) -> np.ndarray:
        pick = np.flatnonzero((self.told["level"].to_numpy() == level) & (self.told["step"].to_numpy() == step))
        bucket, body = self.told["bucket"].to_numpy()[pick], self.told["body"]
        parts = [B.expand(body[int(i)].as_py(), kind) for i in pick[np.argsort(bucket)]]
        return np.concatenate(parts) if parts else np.zeros(0, kind)

    def find(self) -> None:
        """The sequences one word longer, and the contexts before all tokens."""
        self.context = np.concatenate((np.full(1, -1, np.int32), self.at[:-1]))
        self.context[self.first[:-1][np.diff(self.first) > 0]] = -1
        self.where = np.flatnonzero((self.context >= 0) & (self.at >= 0)).astype(np.int32)
        name = self.names[self.context[self.where]]
        name *= STEP
        name += self.keys[self.word[self.where]]
        name = T.mix(name)
        order = np.argsort(name)
        name = name[order]
        new = np.concatenate((name[:1] == name[:1], name[1:] != name[:-1]))
        self.longer, self.place = name[new], np.empty(len(name), np.int32)
        self.place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.asked = np.zeros(len(self.names), bool)
        self.asked[self.context[self.context >= 0]] = True

    def seen(self) -> np.ndarray:
        return np.bincount(self.place[self.trains[self.where]], minlength=len(self.longer))

    def owned(self, told: np.ndarray):
        """(contexts, totals, contexts' totals, probabilities without them) of the sequences that
        this block has to send, by rising context."""
        some = np.zeros(len(self.longer), np.int64)
        some[self.place] = self.where
        own = np.flatnonzero(told & 1)
        own = own[np.argsort(self.context[some[own]], kind="stable")]
        context = self.context[some[own]]
        return self.names[context], told[own] >> 1, self.totals[context], self.p[some[own]]

    def take(self, told: np.ndarray, told_rest: np.ndarray) -> None:
        """The contexts of this length come in; those one word longer are next."""
        rest = np.ones(len(self.names))
        rest[self.asked] = told_rest
        leaves = rest < 1
        at = np.flatnonzero(self.context >= 0)
        at = at[leaves[self.context[at]]]
        self.p[at] *= rest[self.context[at]]
        self.used[at] = True
        seen = self.where[leaves[self.context[self.where]]]
        total = (told >> 1)[self.place[leaves[self.context[self.where]]]]
        self.p[seen] += np.maximum(total - DISCOUNT, 0) / self.totals[self.context[seen]]
        self.at = np.full(len(self.word), -1, np.int32)
        self.at[self.where] = np.where(told > 0, np.arange(len(told), dtype=np.int32), np.int32(-1))[self.place]
        self.names, self.totals = self.longer, told >> 1
        del self.context, self.where, self.place, self.longer


def _replayed(rows: pa.Table, told: pa.Table, n: int, v: int, least: int, levels: int) -> _Tokens:
    own = _Tokens(rows, told, n, v, least)
    for level in range(1, levels + 1):
        own.find()
        own.take(own.answers(level, 1, np.int64), own.answers(level, 2, np.float64))
    return own


def _decided(rows: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(contexts, what each leaves to its suffix: 1 if it isn't retained) of a range of contexts,
    given each sequence of a context and a next word once."""
    context, seen, size, parent = (np.concatenate([B.expand(x, k, k is U64) for x in rows[c].to_pylist()]) for c, k in (("contexts", U64), ("totals", np.int64), ("sizes", np.int64), ("parents", np.float64)))
    if not len(context):
        return context, np.ones(0)
    order = np.lexsort((parent, seen, context))
    context, seen, size, parent = context[order], seen[order].astype(float), size[order].astype(float), parent[order]
    names, first, at = np.unique(context, return_index=True, return_inverse=True)
    size, m = size[first], len(names)
    share = np.maximum(seen - DISCOUNT, 0) / size[at]
    explicit, known = np.bincount(at, share, m), np.bincount(at, parent, m)
    gain = np.bincount(at, seen * np.log2(np.maximum(share + (1 - explicit[at]) * parent, 1e-300) / parent), m)
    left, other = size - np.bincount(at, seen, m), np.maximum(1 - known, 1e-9)
    gain += np.where(left > 0, left * np.log2(np.maximum((1 - explicit) * other, 1e-300) / other), 0)
    price = 0.5 * np.log2(max(2, n)) * np.bincount(at, minlength=m)
    return names, np.where(gain > price, 1 - explicit, 1.0)


def train(blocks: DataFrame, buckets: int, depth: int = DEPTH, least: int = LEAST):
    """(training tokens, distinct words, answers to the blocks: totals of words at level 0; for each
    length of contexts the totals of sequences, with a bit for the block that sends them on, and
    what the contexts leave)."""
    n = blocks.agg(F.sum("n_train")).first()[0] or 0
    shift = U64(64 - (buckets.bit_length() - 1))
    part = lambda keys: (keys >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)

    def count_words(batches):
        for block, ids, known, keys, at, first in _each(batches):
            mask = np.repeat(_folds(ids, known)[1], np.diff(first))
            counts = np.bincount(at[mask], minlength=len(keys))
            yield _ranges(keys, counts, part(keys), buckets, block)

    def total_words(rows: pa.Table) -> pa.Table:
        _, total, where = _totals(rows)
        out = [0] * rows.num_rows, [0] * rows.num_rows, rows["block"].to_pylist(), rows["bucket"].to_pylist(), [B.squeeze(total[w]) for w in where], [int((total > 0).sum()), *[0] * (rows.num_rows - 1)]
        return B.batch(["level", "step", "block", "bucket", "body", "distinct"], out, [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64()])

    words = blocks.mapInArrow(count_words, _SENT).groupBy("bucket").applyInArrow(total_words, f"{_TOLD}, distinct long").coalesce(buckets).checkpoint()
    v = words.agg(F.sum("distinct")).first()[0] or 0
    answers, texts = words.drop("distinct"), blocks.drop("n_train")

    def tell(level, step, rows, bodies):
        return B.batch(["level", "step", "block", "bucket", "body"], [[level] * rows.num_rows, [step] * rows.num_rows, rows["block"].to_pylist(), rows["bucket"].to_pylist(), bodies], [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()])

    def steps(level):

        def count_next(rows: pa.Table, told: pa.Table) -> pa.Table:
            own = _replayed(rows, told, n, v, least, level - 1)
            own.find()
            return pa.Table.from_batches([_ranges(own.longer, own.seen(), part(own.longer), buckets, rows["block"][0].as_py())])

        def total_next(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("block")
            _, total, where = _totals(rows)
            new = np.ones(len(total), bool)
            bodies = []
            for w in where:
                bodies.append(B.squeeze(np.where(total[w] >= least, total[w] * 2 + new[w], 0)))
                new[w] = False
            return tell(level, 1, rows, bodies)

        def send_next(rows: pa.Table, told: pa.Table) -> pa.Table:
            own = _replayed(rows, told, n, v, least, level - 1)
            own.find()
            sent = own.owned(own.answers(level, 1, np.int64))
            asks = own.names[own.asked]
            # A context that is sent is one that is asked for.
            of_asks, of_sent = part(asks), part(sent[0])
            ranges = of_asks[np.flatnonzero(np.concatenate((of_asks[:1] == of_asks[:1], of_asks[1:] != of_asks[:-1])))]
            asked_cuts, cuts = ([*zip(*(np.searchsorted(x, ranges, side).tolist() for side in ("left", "right")))] for x in (of_asks, of_sent))
            ranges = ranges.tolist()
            bodies = [[B.squeeze(x[a:z], x.dtype == U64) for a, z in c] for x, c in ((asks, asked_cuts), *((x, cuts) for x in sent))]
            return B.batch(["bucket", "block", "asks", "contexts", "totals", "sizes", "parents"], [ranges, [rows["block"][0].as_py()] * len(ranges), *bodies], [pa.int32(), pa.int64(), *[pa.binary()] * 5])

        def decide(rows: pa.Table) -> pa.Table:
            names, rest = _decided(rows, n)
            bodies = []
            for asks in rows["asks"].to_pylist():
                at = _index(names, B.expand(asks, U64, True))
                bodies.append(B.squeeze(np.where(at >= 0, rest[at] if len(rest) else 1.0, 1.0)))
            return tell(level, 2, rows, bodies)

        return (count_next, _SENT, total_next), (send_next, _SENT_ON, decide)

    conf, kept = blocks.sparkSession.conf, blocks.sparkSession.conf.get(FREED, None)
    # Each step ends in a checkpoint, so what it shuffled needn't stay on the disks.
    conf.set(FREED, "true")
    try:
        for level in range(1, depth + 1):
            for asking, asked, answering in steps(level):
                requests = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(asking, asked)
                answers = answers.union(requests.groupBy("bucket").applyInArrow(answering, _TOLD).coalesce(buckets).checkpoint())
    finally:
        conf.unset(FREED) if kept is None else conf.set(FREED, kept)
    return n, v, answers


def scores(docs: DataFrame, depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """One row for each row of docs, as SCHEMA."""
    blocks = packed(docs)
    n, v, answers = train(blocks, B.count_for(docs), depth, least)

    def score(rows: pa.Table, told: pa.Table) -> pa.Table:
        own = _replayed(rows, told, n, v, least, depth)
        heads = own.first[:-1]
        known_n, used_n = (np.add.reduceat(x, heads, dtype=np.int64) for x in ((own.counts > 0)[own.word], own.used))
        return pa.table({"doc_id": pa.array(own.ids, mask=~own.known), "held_out": _folds(own.ids, own.known)[0], "n_tokens": np.diff(own.first), "n_known": known_n, "train_tokens": np.full(len(own.ids), n, np.int64), "base_score": np.add.reduceat(np.log10(own.base)[own.word], heads), "score": np.add.reduceat(np.log10(own.p), heads), "n_in_context": used_n})

    return blocks.drop("n_train").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCHEMA)


def op2_language_model(spark, sf_dir: str) -> DataFrame:
    return scores(T.table(spark, sf_dir, "documents"))
