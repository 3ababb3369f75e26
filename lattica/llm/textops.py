"""Vectorised text primitives shared by the operators: words and their fingerprints.

All functions work on a run of UTF-8 documents laid end to end (an Arrow string column's
own buffers), so that a batch costs a fixed number of numpy passes and no Python string.
Fingerprints are 64 bits; callers for which a collision would change a result take two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text that one numpy pass holds at a time; its temporaries take about 60 times that.
SLICE_BYTES = 1_500_000
#: Rows in an Arrow batch sent to Python: a batch of the longest documents must fit a worker.
BATCH_ROWS = 512

_rng = np.random.default_rng(20_240_601)
_BYTE = _rng.integers(0, 2**64, (2, 256), dtype=U64) | U64(1)
_BASE = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))


def byte_class(pattern_bytes: list[tuple[int, int]], negate: bool = False) -> np.ndarray:
    """A table of 256 booleans, true for bytes within (or outside) the closed ranges."""
    table = np.zeros(256, bool)
    for lo, hi in pattern_bytes:
        table[lo : hi + 1] = True
    return ~table if negate else table


#: Words `[^\x20\x09-\x0D]+`; every byte of a multi-byte character belongs to a word.
SPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)], negate=True)
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], negate=True)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    raw, n = column.buffers(), len(column)
    offsets = np.frombuffer(raw[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges of at most `most` bytes, or one row if it alone is longer."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = end


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = False, seeds: int = 1):
    """Words of each document.

    Returns (starts, ends, first, hashes): byte positions of every word, the index of each
    document's first word (n+1 entries), and one array of 64-bit fingerprints per seed.
    """
    if lower:
        data = _LOWER[data]
    is_word = kind[data]
    before, after = np.empty_like(is_word), np.empty_like(is_word)
    if len(data):
        before[0], before[1:] = False, is_word[:-1]
        after[-1], after[:-1] = False, is_word[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return starts, ends, first, [np.zeros(0, U64)] * seeds
    lengths = ends - starts
    heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    own = data[is_word]
    place = np.arange(len(own)) - np.repeat(heads, lengths)
    hashes = []
    for s in range(seeds):
        powers = np.cumprod(np.full(int(lengths.max()), _BASE[s], U64))
        hashes.append(mix(np.add.reduceat(_BYTE[s][own] * powers[place], heads) ^ (lengths.astype(U64) << U64(48))))
    return starts, ends, first, hashes


def window_hash(h: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Fingerprints of all runs of `size` consecutive entries of h (document edges ignored)."""
    n = max(0, len(h) - size + 1)
    out, factor = np.zeros(n, U64), _BASE[seed]
    for j in range(size):
        out = out * factor + h[j : j + n]
    return mix(out ^ U64(size))


def window_rows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of `size` words that stay inside a document, and their document."""
    counts = np.maximum(0, np.diff(first) - size + 1)
    doc = np.repeat(np.arange(len(counts)), counts)
    skip = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - skip[doc] + first[:-1][doc], doc


def covered(starts: np.ndarray, size, total: int) -> np.ndarray:
    """Which of `total` words lie in one of the windows."""
    edge = np.bincount(starts, minlength=total + 1) - np.bincount(starts + size, minlength=total + 1)[: total + 1]
    return np.cumsum(edge[:total]) > 0


def small_batches(spark) -> None:
    """Bounds what one Arrow batch of long documents holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
