"""Substring deduplication by recompression.

Recompression names maximal runs of equal tokens, then pairs whose left token has a 0 bit
and whose right token a 1 bit, round after round. Whether two neighbours merge depends on
the neighbours alone, so equal substrings get the same symbols except near their borders.
A name is a 64-bit fingerprint of what it stands for, which makes it the same name in every
task without a naming shuffle. Each symbol also carries the span of tokens that decides it.

After HIGH rounds most symbols of long passages stand for more than a window. Such a long symbol
is the same in all documents that hold its words, away from the passage's ends; seen in a smaller
document, it settles all windows inside it at once. Around and between long symbols windows are
compared one by one. Every window of `window` words holds symbols of the first rounds that are
decided inside it; of its strings of GRAM such symbols the one with the smallest name is its anchor
(a window without one, as inside a long run, is its own anchor). Steps over blocks of documents:

1. each block sends its distinct long symbols and anchors with their smallest and largest
   document; those seen in two documents go back to the blocks that hold them. A long symbol also
   carries 32 bits of another fingerprint of its words, which verify it;
2. windows with such an anchor that no long symbol of a smaller document settles are sent under a
   96-bit fingerprint of all their words, which verifies the match; windows seen in two documents
   go back, under all 96 bits, with their smallest document;
3. words covered by a window that also starts in a smaller document, settled in either way, are
   removed.

Exact copies are found first by a digest of the text, and named by id and digest, as an id may
stand on rows with other texts: all windows of a copy also start in the smallest document of its
group, so only that one sends fingerprints. Step 1 pre-aggregates in
each block, so a passage that a third of all documents share costs one entry a block.

Nulls: a null text has no words; a row with a null doc_id comes after all others and is never
a source. Equal ids never remove each other's words, so a repeated row changes nothing; rows of
one id with other texts are each judged by their own text, and all are sources.
An empty table gives an empty result. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import textops as T

U64 = np.uint64
WINDOW = 13
#: Symbols in an anchor. One symbol alone may be a common word; three stand for four or five.
GRAM = 3
#: Rounds for long symbols: each leaves about three quarters of the symbols.
HIGH = 10
#: Shares that the rows of one digest are dealt into where they meet the smallest of their group.
SALTS = 16
_COPY = np.dtype([("id", "<i8"), ("digest", "S16")])


def rounds_for(window: int) -> int:
    """Rounds after which each window without long runs still holds a whole symbol: a round
    may lose two symbols at each border, and the rest may pair up."""
    rounds, left = 0, window
    while (left - 4) // 2 >= 1:
        rounds, left = rounds + 1, (left - 4) // 2
    return max(1, rounds)


def levels(names: np.ndarray, doc: np.ndarray, rounds: int):
    """(names, documents, lo, hi, at) of the symbols after each round; lo..hi are the words that decide
    a symbol, one beyond the document where its edge had a say, `at` is its first word. All rise
    from left to right."""
    lo = np.arange(len(names))
    hi, at = lo.copy(), lo.copy()

    def borders(doc, lo, hi):
        """What a symbol's left and right neighbour need; outside a document: one word more."""
        same = doc[1:] == doc[:-1]
        left, right = lo - 1, hi + 1
        left[1:][same] = lo[:-1][same]
        right[:-1][same] = hi[1:][same]
        return same, left, right

    for r in range(rounds):
        if len(names):
            same, left, right = borders(doc, lo, hi)
            head = np.concatenate(([True], ~(same & (names[1:] == names[:-1]))))
            heads = np.flatnonzero(head)
            length = np.diff(np.append(heads, len(names)))
            last = heads + length - 1
            run = np.where(length > 1, T.mix(names[heads] * U64(0xA24BAED4963EE407) + length.astype(U64)), names[heads])
            names, doc, lo, hi, at = run, doc[heads], left[heads], right[last], at[heads]
            same, left, right = borders(doc, lo, hi)
            bit = (T.mix(names ^ U64(r + 1)) & U64(1)).astype(bool)
            pair = np.zeros(len(names), bool)
            pair[:-1] = same & ~bit[:-1] & bit[1:]
            second = np.concatenate(([False], pair[:-1]))
            alone = ~pair & ~second
            new = names.copy()
            i = np.flatnonzero(pair)
            new[i] = T.mix(names[i] * U64(0x9FB21C651E98DF25) + T.mix(names[i + 1] + U64(r)))
            nlo, nhi = lo.copy(), hi.copy()
            nhi[i] = hi[i + 1]
            nhi[alone & ~bit] = right[alone & ~bit]
            nlo[alone & bit] = left[alone & bit]
            keep = ~second
            names, doc, lo, hi, at = new[keep], doc[keep], nlo[keep], nhi[keep], at[keep]
        yield names, doc, lo, hi, at


def recompress(names: np.ndarray, doc: np.ndarray, rounds: int):
    """(names, lo, hi) of the symbols after some rounds."""
    for names, _, lo, hi, _ in levels(names, doc, rounds):
        pass
    return names, lo, hi


def long_symbols(h: np.ndarray, h2: np.ndarray, first: np.ndarray, window: int):
    """(name, check bits, first word, last word + 1, document) of the symbols after HIGH rounds that hold
    a window at least."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for names, owner, _, _, at in levels(h, doc, HIGH):
        pass
    end = np.append(at[1:], len(h))
    pick = np.flatnonzero(end - at >= window)
    names, owner, at, end = names[pick], owner[pick], at[pick], end[pick]
    # Sums of word fingerprints times powers of an odd base; the inverse base takes the place out.
    power, back = (np.cumprod(np.concatenate((np.ones(1, U64), np.full(len(h), b, U64))), dtype=U64) for b in (_BASE, _INVERSE))
    total = np.concatenate((np.zeros(1, U64), np.cumsum(T.mix(h2) * power[:-1], dtype=U64)))
    check = T.mix((total[end] - total[at]) * back[at] + (end - at).astype(U64))
    return names, (check >> U64(32)).astype(np.uint32), at, end, owner


_BASE = U64(0xD1342543DE82EF95)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


def settled(symbols, ids: np.ndarray, long: tuple, window: int, total: int) -> np.ndarray:
    """Which of `total` words begin a window inside a long symbol of a smaller document. symbols: as
    `long_symbols`; ids: of its documents; long: (keys, check bits, smallest documents) learned."""
    names, check, at, end, doc = symbols
    hit, where = _checked(long[0], long[1], names, check)
    hit = np.flatnonzero(hit)
    hit = hit[long[2][where[hit]] < ids[doc[hit]]]
    edge = np.bincount(at[hit], minlength=total + 1) - np.bincount(end[hit] - window + 1, minlength=total + 1)[: total + 1]
    return np.cumsum(edge[:total]) > 0


def anchors(h: np.ndarray, first: np.ndarray, window: int):
    """For each window: (first word, document, anchor)."""
    starts, doc = T.window_rows(first, window)
    if not len(starts):
        return starts, doc, np.zeros(0, U64)
    names, lo, hi = recompress(h, np.repeat(np.arange(len(first) - 1), np.diff(first)), rounds_for(window))
    names, lo, hi = T.window_hash(names, GRAM), lo[: max(0, len(lo) - GRAM + 1)], hi[GRAM - 1 :]
    a = np.searchsorted(lo, starts)
    b = np.searchsorted(hi, starts + window - 1, "right")
    count = b - a
    out = np.empty(len(starts), U64)
    level, width, todo = names, 1, count > 0
    bare = ~todo
    out[bare] = T.mix(T.window_hash(h, window)[starts[bare]] ^ U64(0x5BD1E995))
    while todo.any():
        now = todo & (count < 2 * width)
        out[now] = np.minimum(level[a[now]], level[b[now] - width])
        todo &= ~now
        if todo.any():
            level, width = np.minimum(level[:-width], level[width:]), 2 * width
    return starts, doc, out


def _send(keys, low, high, block, buckets, check=None, skip=0):
    """Entries of a block as one row for each range of keys; ranges are numbered from `skip`."""
    shift = U64(64 - (buckets.bit_length() - 1))
    part = (keys >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)
    cuts = np.searchsorted(part, np.arange(buckets + 1))
    rows = [(p, *cuts[p : p + 2]) for p in np.unique(part)]
    cols = [[int(p) + skip for p, _, _ in rows], [block] * len(rows), [B.squeeze(keys[i:j], True) for _, i, j in rows], *([B.squeeze(x[i:j]) for _, i, j in rows] for x in (low, high - low))]
    cols.append([B.squeeze(check[i:j]) if check is not None else b"" for _, i, j in rows])
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["bucket", "source", "keys", "low", "high", "check_bits"])


_SENT = "bucket int, source int, keys binary, low binary, high binary, check_bits binary"
_BACK = "block int, kind int, keys binary, low binary, check_bits binary, copies binary"
_BACK_NAMES, _BACK_KINDS = ["block", "kind", "keys", "low", "check_bits", "copies"], [pa.int32(), pa.int32(), *[pa.binary()] * 4]
#: Kinds of answers: copies, anchors, long symbols, windows, ids of documents that hold long symbols.
COPIES, ANCHORS, LONG, WINDOWS, HOLDERS = range(5)


def _least(keys, low, check):
    """Distinct (keys, smallest, largest document, check bits), in order."""
    order = np.lexsort((check, keys))
    keys, low, check = keys[order], low[order], check[order]
    heads = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (check[1:] != check[:-1])))) if len(keys) else np.zeros(0, np.int64)
    least, most = (np.minimum.reduceat(low, heads), np.maximum.reduceat(low, heads)) if len(heads) else (low, low)
    return keys[heads], least, most, check[heads]


def _answer(rows: pa.Table, kind: int) -> pa.Table:
    """Keys of a range that lie in two documents, to each block that holds them, as answers of a kind
    (of long symbols if it is ANCHORS and they have check bits). What a block says to itself, in a
    range below 0, goes back as it is."""
    if rows["bucket"][0].as_py() < 0:
        kinds = [LONG if c else HOLDERS for c in rows["check_bits"].to_pylist()]
        return B.batch(_BACK_NAMES, [rows["source"].to_pylist(), kinds, *(rows[c].to_pylist() for c in ("keys", "low", "check_bits")), [b""] * len(kinds)], _BACK_KINDS)
    parts = [(b, B.expand(k, U64, True), low := B.expand(lo, np.int64), low + B.expand(more, np.int64), B.expand(c, np.uint32) if c else None) for b, k, lo, more, c in zip(*(rows[x].to_pylist() for x in ("source", "keys", "low", "high", "check_bits")))]
    keys = np.concatenate([p[1] for p in parts])
    low, high = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
    owner = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
    if parts[0][4] is not None:
        check = np.concatenate([p[4] for p in parts])
        order = np.lexsort((check, keys))
        new = np.concatenate(([True], (keys[order][1:] != keys[order][:-1]) | (check[order][1:] != check[order][:-1])))
    else:
        order = np.argsort(keys, kind="stable")
        new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    heads = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(low[order], heads)[group]
    most = np.maximum.reduceat(high[order], heads)[group]
    shared = least < most
    order = order[shared]
    by = np.argsort(owner[order], kind="stable")
    order, least = order[by], least[shared][by]
    cuts = np.searchsorted(owner[order], np.arange(len(parts) + 1))
    out = []
    for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
        if a < z:
            out.append((parts[i][0], kind if parts[0][4] is None or kind != ANCHORS else LONG, B.squeeze(keys[order[a:z]], True), B.squeeze(least[a:z]), b"" if parts[0][4] is None else B.squeeze(check[order[a:z]]), b""))
    return B.batch(_BACK_NAMES, [list(x) for x in zip(*out)] if out else [[]] * 6, _BACK_KINDS)


def _learned(rows: pa.Table, kind: int):
    """Answers of a kind to a block: keys in order with their check bits and smallest document."""
    rows = rows.filter(pa.compute.equal(rows["kind"], kind))
    keys = [B.expand(x, U64, True) for x in rows["keys"].to_pylist()]
    low = [B.expand(x, np.int64) for x in rows["low"].to_pylist()]
    check = [B.expand(x, np.uint32) for x in rows["check_bits"].to_pylist() if x]
    keys = np.concatenate(keys) if keys else np.zeros(0, U64)
    low = np.concatenate(low) if low else np.zeros(0, np.int64)
    check = np.concatenate(check) if check else np.zeros(len(keys), np.uint32)
    order = np.lexsort((check, keys))
    return keys[order], check[order], low[order]


def _copies(rows: pa.Table) -> np.ndarray:
    copies = [np.frombuffer(x, _COPY) for x in rows["copies"].to_pylist() if x]
    return np.concatenate(copies) if copies else np.zeros(0, _COPY)


def _of_documents(h: list[np.ndarray], first: np.ndarray, pick: np.ndarray):
    """(fingerprints, first words, places in the piece) of some documents of a piece."""
    size = np.diff(first)[pick]
    heads = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(heads[-1]) - np.repeat(heads[:-1], size) + np.repeat(first[:-1][pick], size)
    return [x[place] for x in h], heads, place


def _found(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x, at


def _checked(keys: np.ndarray, check: np.ndarray, x: np.ndarray, x_check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As `_found`, of keys and check bits together: several may share a key."""
    hit, at = _found(keys, x)
    open_ = np.flatnonzero(hit)
    hit[open_] = check[at[open_]] == x_check[open_]
    open_ = open_[~hit[open_]]
    while len(open_):
        at[open_] += 1
        open_ = open_[at[open_] < len(keys)]
        open_ = open_[keys[at[open_]] == x[open_]]
        hit[open_] = check[at[open_]] == x_check[open_]
        open_ = open_[~hit[open_]]
    return hit, at


def _check_bits(h: np.ndarray, window: int, starts: np.ndarray) -> np.ndarray:
    return (T.window_hash(h, window, 1)[starts] >> U64(32)).astype(np.uint32)


def _is_copy(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Which rows are copies of a smaller document: both their id and their text are listed."""
    out = np.zeros(len(ids), bool)
    listed = set(zip(copies["id"].tolist(), (bytes(x).ljust(16, b"\0") for x in copies["digest"].tolist())))
    for i in np.flatnonzero(np.isin(ids, copies["id"])) if len(copies) else ():
        out[i] = (int(ids[i]), hashlib.md5(data[offsets[i] : offsets[i + 1]].tobytes()).digest()) in listed
    return out


def _pieces(ids, data, offsets, seeds=1):
    for lo, hi in T.slices(offsets):
        own, base = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        starts, ends, first, h = T.words(base, own, T.SPACED, seeds=seeds)
        yield lo, hi, base, own, starts, ends, first, h


def removed_words(docs: DataFrame, window: int, finish, schema, extra: tuple[str, ...] = ()) -> DataFrame:
    """Applies `finish(rows, ids, known, pieces)` to each block of rows, where a piece is (row range, bytes,
    offsets, word starts, word ends, first word of each row, removed mask)."""
    count = B.count_for(docs)
    buckets = count
    packed = B.pack(docs, count, extra)
    digest = docs.where(F.length("text") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    firsts = digest.groupBy("digest").agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("last_id")).where("source_id < last_id")
    firsts = firsts.select("digest", "source_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = digest.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(firsts, ["digest", "salt"]).where("doc_id > source_id")
    copies = copies.select(F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int").alias("block"), "doc_id", "digest").distinct()

    def list_copies(rows: pa.Table) -> pa.Table:
        own = np.zeros(rows.num_rows, _COPY)
        own["id"], own["digest"] = rows["doc_id"].to_numpy(), rows["digest"].to_pylist()
        return B.batch(_BACK_NAMES, [[rows["block"][0].as_py()], [COPIES], [b""], [b""], [b""], [own.tobytes()]], _BACK_KINDS)

    copied = copies.groupBy("block").applyInArrow(list_copies, _BACK)

    def step1(rows: pa.Table) -> pa.Table:
        ids, _, data, offsets = B.unpack(rows)
        keys, low, high, long = [], [], [], [(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.uint32))]
        for lo, hi, _, _, _, _, first, h in _pieces(ids, data, offsets, seeds=2):
            _, doc, anchor = anchors(h[0], first, window)
            if len(doc):
                new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
                k, a, z = B.least_by_key(anchor[new], ids[lo:hi][doc[new]])
                keys.append(k), low.append(a), high.append(z)
                names, check, _, _, owner = long_symbols(h[0], h[1], first, window)
                long.append((names, ids[lo:hi][owner], check))
        block = rows["block"][0].as_py()
        names, least, most, check = _least(*(np.concatenate(x) for x in zip(*long)))
        return pa.concat_tables([_send(*_merge(keys, low, high), block, buckets), _send(names, least, most, block, buckets, check, skip=buckets)])

    sent = packed.groupBy("block").applyInArrow(step1, _SENT)
    shared = sent.groupBy("bucket").applyInArrow(lambda rows: _answer(rows, ANCHORS), _BACK)

    def step2(rows: pa.Table, learned: pa.Table) -> pa.Table:
        if not rows.num_rows or not learned.num_rows:
            return _send(*_merge([], [], []), 0, buckets, np.zeros(0, np.uint32))
        ids, _, data, offsets = B.unpack(rows)
        known_keys, long, again = _learned(learned, ANCHORS)[0], _learned(learned, LONG), _is_copy(ids, data, offsets, _copies(learned))
        sends, holders = [(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.uint32))], []
        for lo, hi, _, _, _, _, first, h in _pieces(ids, data, offsets, seeds=2):
            starts, doc, anchor = anchors(h[0], first, window)
            pick = _found(known_keys, anchor)[0] & ~again[lo:hi][doc]
            if len(long[0]) and pick.any():
                some = np.unique(doc[pick])
                own, heads, place = _of_documents(h, first, some)
                done = np.zeros(len(h[0]), bool)
                done[place] = settled(long_symbols(*own, heads, window), ids[lo:hi][some], long, window, len(place))
                holders.append(ids[lo:hi][np.unique(doc[done[starts]])])
                pick &= ~done[starts]
            starts, doc = starts[pick], doc[pick]
            sends.append((T.window_hash(h[0], window)[starts], ids[lo:hi][doc], _check_bits(h[1], window, starts)))
        block = rows["block"][0].as_py()
        keys, least, most, check = _least(*(np.concatenate(x) for x in zip(*sends)))
        out = [_send(keys, least, most, block, buckets, check)]
        holders = np.unique(np.concatenate(holders)) if holders else np.zeros(0, np.int64)
        if len(holders):  # step 3 needs both again
            zeros = B.squeeze(np.zeros(0, np.int64))
            said = [[-1 - block] * 2, [block] * 2, [B.squeeze(long[0], True), B.squeeze(holders.view(U64), True)], [B.squeeze(long[2]), B.squeeze(holders)], [zeros] * 2, [B.squeeze(long[1]), b""]]
            out.append(pa.table([pa.array(said[0], pa.int32()), pa.array(said[1], pa.int32()), *(pa.array(c, pa.binary()) for c in said[2:])], names=out[0].column_names))
        return pa.concat_tables(out)

    sent = packed.groupBy("block").cogroup(shared.unionByName(copied).groupBy("block")).applyInArrow(step2, _SENT)
    verdicts = sent.groupBy("bucket").applyInArrow(lambda rows: _answer(rows, WINDOWS), _BACK)

    def step3(rows: pa.Table, learned: pa.Table) -> pa.Table:
        if not learned.num_rows:
            learned = pa.table({n: pa.array([], k) for n, k in zip(_BACK_NAMES, _BACK_KINDS)})
        ids, known, data, offsets = B.unpack(rows)
        known_keys, check, least = _learned(learned, WINDOWS)
        long, holders = _learned(learned, LONG), _learned(learned, HOLDERS)[2]
        copy = _is_copy(ids, data, offsets, _copies(learned))

        def pieces():
            for lo, hi, base, own, starts, ends, first, h in _pieces(ids, data, offsets, seeds=2):
                at, doc = T.window_rows(first, window)
                hit, where = _checked(known_keys, check, T.window_hash(h[0], window)[at], _check_bits(h[1], window, at))
                again = np.zeros(len(at), bool)
                again[hit] = least[where[hit]] < ids[lo:hi][doc[hit]]
                some = np.flatnonzero(np.isin(ids[lo:hi], holders))
                if len(some):
                    part, heads, place = _of_documents(h, first, some)
                    done = np.zeros(len(h[0]), bool)
                    done[place] = settled(long_symbols(*part, heads, window), ids[lo:hi][some], long, window, len(place))
                    again |= done[at]
                again |= copy[lo:hi][doc]
                yield lo, hi, base, own, starts, ends, first, T.covered(at[again], window, len(starts))

        return finish(rows, ids, known, pieces())

    answers = verdicts.unionByName(copied).groupBy("block")
    return packed.groupBy("block").cogroup(answers).applyInArrow(step3, schema)


def _merge(keys, low, high):
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, low, high = np.concatenate(keys), np.concatenate(low), np.concatenate(high)
    order = np.argsort(keys, kind="stable")
    keys, low, high = keys[order], low[order], high[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    if not len(heads):
        return keys, low, high
    return keys[heads], np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)


def _joined(base, starts, ends, keep) -> bytes:
    """Kept words joined by one space, by copying bytes once."""
    s, e = starts[keep], ends[keep]
    if not len(s):
        return b""
    length = e - s + 1
    total = int(length.sum()) - 1
    at = np.concatenate(([0], np.cumsum(length)[:-1]))
    source = np.arange(total + 1) - np.repeat(at - s, length)
    source = np.minimum(source, len(base) - 1)
    out = base[source]
    out[(at + length - 1)[:-1]] = 32
    return out[:total].tobytes()


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256."""

    def finish(_, ids, known, pieces):
        n_words, n_removed, sha = [], [], []
        for lo, hi, base, _, starts, ends, first, gone in pieces:
            for i in range(hi - lo):
                a, b = first[i], first[i + 1]
                keep = ~gone[a:b]
                n_words.append(b - a), n_removed.append(int(b - a - keep.sum()))
                sha.append(hashlib.sha256(_joined(base, starts[a:b], ends[a:b], keep)).hexdigest())
        return B.batch(["doc_id", "n_words", "n_removed", "kept_sha256"], [pa.array(ids, mask=~known), n_words, n_removed, sha], [pa.int64(), pa.int64(), pa.int64(), pa.string()])

    return removed_words(docs, window, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without their repeated words. A text that loses nothing stays as it is, null
    ones too; from others the removed words go with the white space before them, n_chars follows if
    there is such a column, and a row that loses all its words goes."""
    missing, names = "missing", docs.columns
    while missing in {c.lower() for c in names}:
        missing += "_"
    docs = docs.withColumn(missing, F.col("text").isNull())
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    schema = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *others).schema

    def finish(rows, ids, known, pieces):
        texts, empty, sizes, lost = [], [], [], []
        for lo, hi, base, own, starts, ends, first, gone in pieces:
            for i in range(hi - lo):
                a, b = first[i], first[i + 1]
                g = np.flatnonzero(gone[a:b])
                raw = base[own[i] : own[i + 1]]
                if len(g):
                    s, e = starts[a:b] - own[i], ends[a:b] - own[i]
                    before = np.concatenate(([0], e[:-1]))
                    mark = np.bincount(before[g], minlength=len(raw) + 1) - np.bincount(e[g], minlength=len(raw) + 1)
                    raw = raw[np.cumsum(mark)[: len(raw)] == 0]
                text = raw.tobytes().decode("utf-8", "replace")
                texts.append(text), sizes.append(len(text)), lost.append(len(g) > 0), empty.append(len(g) > 0 and len(g) == b - a)
        lost, keep = np.array(lost, bool), ~np.array(empty, bool)
        columns = {"doc_id": pa.array(ids, pa.int64(), mask=~known), "text": pa.array(texts, pa.string())}
        more = B.extras(rows) if others else None
        for i, c in enumerate(others):
            column = more[f"c{i}"].combine_chunks()
            if c == "n_chars":
                column = pa.compute.if_else(pa.array(lost), pa.array(sizes, pa.int64()).cast(column.type), column)
            columns[c] = column
        columns["text"] = pa.compute.if_else(columns[missing], pa.scalar(None, pa.string()), columns["text"])
        return pa.table(columns).filter(pa.array(keep))

    return removed_words(docs, window, finish, schema, others).select(*(F.col(f"`{c}`") for c in names))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return digests(T.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS g
  FROM w, unnest(range(1, greatest(len(ws) - 11, 1))) AS u(i)
), low AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g HAVING count(DISTINCT doc_id) > 1
), hit AS (SELECT win.doc_id, list(i) AS hits FROM win JOIN low USING (g) WHERE low.m < win.doc_id GROUP BY win.doc_id
), gone AS (
  SELECT DISTINCT doc_id, j FROM hit, unnest(hits) AS h(i), unnest(range(i, i + 13)) AS r(j)
), mask AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id
), fin AS (
  SELECT w.doc_id, len(ws) AS n, coalesce(len(js), 0) AS k,
         [ws[i] FOR i IN range(1, len(ws) + 1) IF js IS NULL OR NOT list_contains(js, i)] AS kept
  FROM w LEFT JOIN mask USING (doc_id)
)
SELECT doc_id, n::BIGINT AS n_words, k::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM fin
"""
