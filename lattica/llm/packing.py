"""Packing by cutting-stock column generation.

Each document becomes token ids and a closing id. Full sequences are cut off first. What is
left is a head, a multiple of GRID tokens, and a tail shorter than GRID. The histogram of heads
and tails (fewer than 100 classes at GRID 64, whatever the input's size) goes to the driver:

* a linear program covers the histogram by patterns (multisets of classes that fit a sequence),
  solved by revised simplex; a knapsack dynamic program over the dual prices proposes the next
  pattern. A head may also be cut once on the grid; such a column turns one class into two, at
  the cost of CUT_COST sequences, so heads are cut only where patterns alone would pad;
* patterns are rounded down and the remaining items are packed largest first, again as patterns;
* pieces get their place by rank: ranks inside a class come from counts by bucket and class, so
  a class that holds a third of all documents is spread over all buckets.

Token ids are needed once: checksums for each possible cut are made with them.

Null texts are empty and give the closing id alone. A null or repeated doc_id is kept as it is;
each row is packed on its own. Empty table: no pieces. Columns other than doc_id and text
aren't read.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import textops as T

LENGTH = 2048
CLOSING = 1
GRID = 64
#: What a cut costs, in sequences: four tokens' worth of padding.
CUT_COST = 4 / LENGTH
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TOKENS = "bucket int, doc_id long, doc_tokens long, head int, tail int, blocks binary, fronts binary, backs binary, tail_crc long"


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, closing: tuple):
    """The byte-level vocabulary; its ids equal those of the .json file beside it (tested)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict([closing]))


def simplex(sizes: np.ndarray, demand: np.ndarray, cuts: list[tuple[int, int, int]], capacity: int, cut_cost: float = CUT_COST, rounds: int = 4000):
    """Column generation for: least sequences so that patterns, less what cuts use up, cover the
    demand. cuts: (class, part, part) by index; a second set of rows keeps them to the items that
    are there, as parts aren't cut again. Returns [(kind, column, amount)]."""
    classes = len(sizes)
    m = 2 * classes
    count = capacity // sizes
    inverse = np.diag(np.concatenate((1.0 / count, np.ones(classes))))
    value = np.concatenate((demand / count, demand))
    cost = np.repeat([1.0, 0.0], classes)
    basis: list = [("pattern", tuple(int(count[j]) if i == j else 0 for i in range(classes))) for j in range(classes)]
    basis += [("uncut", j) for j in range(classes)]
    if cuts:
        ck, ca, cb = (np.array(x) for x in zip(*cuts))
    lower = float((sizes * demand).sum()) / capacity
    order = np.argsort(sizes)
    srt = sizes[order]
    upto = np.searchsorted(srt, np.arange(capacity + 1), "right")
    for turn in range(rounds):
        dual = cost @ inverse
        price, limit = dual[:classes], dual[classes:]
        if turn % 50 == 49 and cost @ value <= lower * (1 + 1e-7) + 1e-9:
            break
        # Knapsack: best[c] is the largest total price in c tokens.
        best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        p = np.maximum(price[order], 0)
        for c in range(1, capacity + 1):
            n = upto[c]
            if n:
                gain = best[c - srt[:n]] + p[:n]
                i = int(gain.argmax())
                best[c], take[c] = (gain[i], i) if gain[i] > best[c - 1] else (best[c - 1], -1)
        gains = [(best[capacity] - 1, "pattern", None)]
        if cuts:
            g = price[ck] - price[ca] - price[cb] + limit[ck] - cut_cost
            i = int(g.argmax())
            gains.append((g[i] * 0.5, "cut", i))
        j = int(price.argmin())
        gains.append((-price[j], "surplus", j))
        j = int(limit.argmax())
        gains.append((limit[j], "uncut", j))
        gain, kind, which = max(gains, key=lambda x: x[0])
        if gain <= 1e-9:
            break
        column = np.zeros(m)
        if kind == "pattern":
            c = capacity
            while c > 0:
                if take[c] < 0:
                    c -= 1
                else:
                    column[order[take[c]]] += 1
                    c -= int(srt[take[c]])
            name, fee = ("pattern", tuple(int(x) for x in column[:classes])), 1.0
        elif kind == "cut":
            column[ck[which]] += 1
            column[classes + ck[which]] = 1
            column[ca[which]] -= 1
            column[cb[which]] -= 1
            name, fee = ("cut", cuts[which]), cut_cost
        else:
            column[which if kind == "surplus" else classes + which] = -1 if kind == "surplus" else 1
            name, fee = (kind, which), 0.0
        way = inverse @ column
        able = way > 1e-9
        if not able.any():
            break
        ratio = np.full(m, np.inf)
        ratio[able] = value[able] / way[able]
        out = int(ratio.argmin())
        step = ratio[out]
        value = value - step * way
        value[out] = step
        value[value < 0] = 0
        inverse[out] /= way[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(way[others], inverse[out])
        cost[out], basis[out] = fee, name
    return [(*b, float(v)) for b, v in zip(basis, value) if v > 1e-9]


class Plan:
    """Where the item of a given rank in each class goes. Class index: heads 1..H-1 by their
    multiple of GRID, then tails."""

    def __init__(self, heads: np.ndarray, tails: np.ndarray, capacity: int = LENGTH, grid: int = GRID):
        """heads[k]: documents whose head is k * grid; tails[s]: whose tail is s."""
        h, t = len(heads) - 1, len(tails) - 1
        self.sizes = np.array([*range(grid, (h + 1) * grid, grid), *range(1, t + 1)])
        demand = np.concatenate((heads[1:], tails[1:])).astype(np.int64)
        cuts = [(k - 1, i - 1, k - i - 1) for k in range(2, h + 1) for i in range(1, k // 2 + 1) if demand[k - 1]]
        self.cuts: list[list[tuple[int, int, int, int, int]]] = [[] for _ in self.sizes]
        total = np.zeros(len(self.sizes), np.int64)
        patterns: dict[tuple, int] = {}
        solved = simplex(self.sizes, demand.astype(float), cuts, capacity) if demand.sum() else []
        chosen = [(c, int(v)) for kind, c, v in solved if kind == "cut"]
        for (k, _, _), v in chosen:
            total[k] += min(v, demand[k] - total[k])
        kept = demand - total
        count, used = kept.copy(), np.zeros(len(self.sizes), np.int64)
        for (k, a, b), v in chosen:
            v = min(v, int(demand[k] - used[k]))
            if v > 0:
                first = int(count[a])
                count[a] += v
                second = int(count[b])
                count[b] += v
                if a == b:
                    second = first + v
                # ranks used[k].. of class k become classes a and b from these ranks on
                self.cuts[k].append((int(used[k]), v, a, first, b, second))
                used[k] += v
        self.cut_total = used
        left = count.copy()
        for kind, column, v in sorted((x for x in solved if x[0] == "pattern"), key=lambda x: -x[2]):
            a = np.array(column)
            n = min([int(v + 1e-6), *(left[a > 0] // a[a > 0])])
            if n > 0:
                patterns[column] = patterns.get(column, 0) + n
                left -= n * a
        rest = np.argsort(-self.sizes, kind="stable")
        while left.any():
            a, room = np.zeros(len(self.sizes), np.int64), capacity
            for j in rest:
                a[j] = min(left[j], room // self.sizes[j])
                room -= a[j] * self.sizes[j]
            n = int((left[a > 0] // a[a > 0]).min())
            patterns[tuple(a.tolist())] = patterns.get(tuple(a.tolist()), 0) + n
            left -= n * a
        self.sequences = 0
        slots: list[list[tuple]] = [[] for _ in self.sizes]
        filled = np.zeros(len(self.sizes), np.int64)
        for column, n in patterns.items():
            at = 0
            for j, a in enumerate(column):
                if a:
                    slots[j].append((filled[j], a, self.sequences, at))
                    filled[j] += n * a
                    at += a * int(self.sizes[j])
            self.sequences += n
        self.slots = [np.array(s, np.int64).reshape(-1, 4) for s in slots]

    def place(self, kind: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the items with these ranks in a class."""
        s = self.slots[kind]
        row = s[np.searchsorted(s[:, 0], rank, "right") - 1]
        local = rank - row[:, 0]
        return row[:, 2] + local // row[:, 1], row[:, 3] + local % row[:, 1] * self.sizes[kind]


def tokens(docs: DataFrame, path: str, pattern: str, special: tuple, buckets: int) -> DataFrame:
    """Lengths and checksums of each document's possible pieces."""

    def run(batches):
        enc = encoder(path, pattern, special)
        end = np.array([CLOSING], "<u4")
        for batch in batches:
            rows = []
            for text in batch.column(2).fill_null("").to_pylist():
                ids = np.concatenate((enc.encode_to_numpy(text, allowed_special="all").astype("<u4"), end))
                n, full = len(ids), len(ids) // LENGTH
                raw = memoryview(ids.tobytes())
                marks = [zlib.crc32(raw[i * 4 * LENGTH : (i + 1) * 4 * LENGTH]) for i in range(full)]
                raw = raw[full * 4 * LENGTH :]
                rest = n - full * LENGTH
                k = rest // GRID
                body, step, fronts, crc = raw[: k * GRID * 4], GRID * 4, [], 0
                for i in range(k):
                    crc = zlib.crc32(body[i * step : (i + 1) * step], crc)
                    fronts.append(crc)
                backs = [zlib.crc32(body[i * step :]) for i in range(1, k)]
                rows.append((n, k, rest - k * GRID, *(np.array(x, np.uint32).tobytes() for x in (marks, fronts, backs)), zlib.crc32(raw[k * GRID * 4 :])))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["bucket", "doc_id", "doc_tokens", "head", "tail", "blocks", "fronts", "backs", "tail_crc"])

    T.small_batches(docs.sparkSession)
    id_col = F.col("doc_id").cast("long")
    bucket = F.pmod(F.xxhash64(id_col, F.length("text")), F.lit(buckets)).cast("int")
    return docs.select(bucket.alias("bucket"), id_col.alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _TOKENS)


def pack(docs: DataFrame, path: str, pattern: str, special: tuple = ("<|endoftext|>", 50256)) -> DataFrame:
    """One row for each piece, as SCHEMA. Full sequences are numbered after the packed ones."""
    B.checkpoints(docs.sparkSession)
    done = tokens(docs, path, pattern, special, B.count_for(docs)).checkpoint()
    full = F.floor(F.col("doc_tokens") / LENGTH)
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("head").alias("size"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(1).alias("kind"), F.col("tail").alias("size"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(2).alias("kind"), F.lit(0).alias("size"), full.alias("n")))
    counts = done.select("bucket", F.explode(kinds).alias("x")).select("bucket", "x.*").groupBy("bucket", "kind", "size").agg(F.sum("n").alias("n"))
    heads, tails = np.zeros(LENGTH // GRID, np.int64), np.zeros(GRID, np.int64)
    for row in counts.where("kind < 2").groupBy("kind", "size").agg(F.sum("n").alias("n")).collect():  # under 100 rows
        (heads, tails)[row["kind"]][row["size"]] = row["n"]
    plan = Plan(heads, tails)
    # Ranks: what earlier buckets hold of the class. One row for each bucket and class.
    from pyspark.sql import Window

    before = counts.withColumn("first", F.sum("n").over(Window.partitionBy("kind", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("bucket", "kind", "size", F.coalesce("first", F.lit(0)).cast("long").alias("first"))
    h = LENGTH // GRID - 1

    def assign(rows: pa.Table, firsts: pa.Table) -> pa.Table:
        n = rows.num_rows
        if not n:
            return pa.table({name: pa.array([], pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")})
        ids = rows["doc_id"]
        total, head, tail = (rows[x].to_numpy() for x in ("doc_tokens", "head", "tail"))
        order = np.lexsort((np.arange(n), rows["tail_crc"].to_numpy(), total, ids.fill_null(B.MOST).to_numpy()))
        first = {(k, s): f for k, s, f in zip(*(firsts[x].to_pylist() for x in ("kind", "size", "first")))}
        out: list[tuple] = []

        def put(doc, start, length, crc, sequence, offset):
            out.append(tuple(np.asarray(x, np.int64) for x in np.broadcast_arrays(doc, start, length, crc, sequence, offset)))

        def crcs(name):
            return [np.frombuffer(x, np.uint32) for x in rows[name].to_pylist()]

        base = total // LENGTH * LENGTH
        fronts, backs = crcs("fronts"), crcs("backs")
        for k in np.unique(head[head > 0]):
            docs_k = order[head[order] == k]
            rank = first[0, int(k)] + np.arange(len(docs_k))
            j = int(k) - 1
            whole = rank >= plan.cut_total[j]
            w = docs_k[whole]
            if len(w):
                s, o = plan.place(j, rank[whole] - plan.cut_total[j])
                put(w, base[w], k * GRID, [fronts[i][-1] for i in w], s, o)
            for at, many, a, fa, b, fb in plan.cuts[j]:
                pick = (rank >= at) & (rank < at + many)
                d, r = docs_k[pick], rank[pick] - at
                if len(d):
                    s, o = plan.place(a, fa + r)
                    put(d, base[d], (a + 1) * GRID, [fronts[i][a] for i in d], s, o)
                    s, o = plan.place(b, fb + r)
                    put(d, base[d] + (a + 1) * GRID, (b + 1) * GRID, [backs[i][a] for i in d], s, o)
        marks = rows["tail_crc"].to_numpy()
        for t in np.unique(tail[tail > 0]):
            d = order[tail[order] == t]
            s, o = plan.place(h + int(t) - 1, first[1, int(t)] + np.arange(len(d)))
            put(d, total[d] - t, t, marks[d], s, o)
        many = total // LENGTH
        if many.any():
            d = np.repeat(order, many[order])
            inner = np.arange(len(d)) - np.repeat(np.cumsum(many[order]) - many[order], many[order])
            own = crcs("blocks")
            put(d, inner * LENGTH, LENGTH, [own[i][q] for i, q in zip(d.tolist(), inner.tolist())], plan.sequences + first[2, 0] + np.arange(len(d)), 0)
        doc, start, length, crc, sequence, offset = (np.concatenate(x) for x in zip(*out))
        return pa.table({"doc_id": ids.combine_chunks().take(pa.array(doc)), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total[doc], "sequence_id": sequence, "offset": offset})

    return done.groupBy("bucket").cogroup(before.groupBy("bucket")).applyInArrow(assign, SCHEMA)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack(T.table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
