"""Whole documents moved between stages as compressed blocks.

Operators that compare documents exchange fingerprints for answers more than once and need
the texts each time. A block is the set of documents whose hashed id falls in it, shuffled
once as zstd frames; every later step names its block, so answers travel to the texts and
not the other way. A block holds about BLOCK_BYTES of input whatever the input's size, and
Spark reuses the one exchange for all steps that read it.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..folders import shared
from . import textops as T

#: Input (file) bytes for one block, at least and at most: blocks grow with the square root of the
#: input, so that what a block sends to a range of keys stays worth a row. Then: text gathered in
#: a task before it is compressed.
BLOCK_BYTES, LARGEST_BLOCK = 4_000_000, 64_000_000
PACK_BYTES = 24_000_000
SCHEMA = "block int, ids binary, known binary, sizes binary, body binary, extra binary"
MOST = np.iinfo(np.int64).max


def count_for(df: DataFrame, least: int = 16, most: int = 1 << 22) -> int:
    """A power of two that follows the input's size (the plan's own estimate, no job)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    unit = min(LARGEST_BLOCK, max(BLOCK_BYTES, math.sqrt(16_000 * size)))
    return 1 << max(0, math.ceil(math.log2(min(most, max(least, size / unit)))))


def checkpoints(spark) -> None:
    """Sees to it that there is a shared folder for checkpoints."""
    shared(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}.parquet"
    df.write.parquet(path)
    return spark.read.parquet(path)


def pack(docs: DataFrame, count: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows of doc_id and text as blocks, with further columns for `extras`. A null id becomes the
    largest number, known = 0."""

    def run(batches):
        held: list = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column(2).nbytes
            if size >= PACK_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    def flush(held):
        table = pa.Table.from_batches(held)
        table = table.take(np.argsort(table["block"].to_numpy(), kind="stable"))
        block, ids = table["block"].to_numpy(), table["doc_id"]
        known = np.asarray(ids.is_valid().combine_chunks().to_numpy(zero_copy_only=False), np.uint8)
        ids = ids.fill_null(MOST).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            data, off = T.text_buffers(table["text"].slice(lo, hi - lo))
            body = zstandard.ZstdCompressor(level=3).compress(data.tobytes())
            more = b""
            if extra:
                with pa.BufferOutputStream() as sink:
                    part = pa.table([table[3 + i].slice(lo, hi - lo).combine_chunks() for i in range(len(extra))], names=[f"c{i}" for i in range(len(extra))])
                    with pa.ipc.new_stream(sink, part.schema) as writer:
                        writer.write_table(part)
                    more = zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())
            row = [int(block[lo])], [ids[lo:hi].tobytes()], [known[lo:hi].tobytes()], [np.diff(off).tobytes()], [body], [more]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *(pa.array(x, pa.binary()) for x in row[1:])], names=["block", "ids", "known", "sizes", "body", "extra"])

    T.small_batches(docs.sparkSession)
    id_col = F.col("doc_id").cast("long")
    named = docs.select(F.pmod(F.xxhash64(id_col), F.lit(count)).cast("int").alias("block"), id_col.alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"extra_{i}") for i, c in enumerate(extra)))
    return named.mapInArrow(run, SCHEMA)


def unpack(rows: pa.Table):
    """(ids, known, data, offsets) of a block."""
    ids = np.frombuffer(b"".join(rows["ids"].to_pylist()), np.int64)
    known = np.frombuffer(b"".join(rows["known"].to_pylist()), np.uint8).astype(bool)
    sizes = np.frombuffer(b"".join(rows["sizes"].to_pylist()), np.int64)
    plain = zstandard.ZstdDecompressor()
    data = np.frombuffer(b"".join(plain.decompress(x) for x in rows["body"].to_pylist()), np.uint8)
    return ids, known, data, np.concatenate(([0], np.cumsum(sizes)))


def extras(rows: pa.Table) -> pa.Table:
    """The further columns of a block, row by row as `unpack` has them."""
    plain = zstandard.ZstdDecompressor()
    return pa.concat_tables([pa.ipc.open_stream(plain.decompress(x)).read_all() for x in rows["extra"].to_pylist()])


def squeeze(x: np.ndarray, rising: bool = False) -> bytes:
    """An array for the shuffle, its bytes by their place; sorted integers as differences."""
    step = np.diff(x, prepend=x[:1] * 0) if rising and len(x) else np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(step.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def expand(raw: bytes, kind, rising: bool = False) -> np.ndarray:
    kind = np.dtype(kind)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    step = np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).view(kind).ravel()
    return np.cumsum(step, dtype=kind) if rising else step


def least_by_key(keys: np.ndarray, docs: np.ndarray):
    """For each distinct key: (key, smallest doc, largest doc), keys rising."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    if not len(heads):
        return keys, docs, docs
    return keys[heads], np.minimum.reduceat(docs, heads), np.maximum.reduceat(docs, heads)


def batch(names: list[str], columns: list, kinds: list) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
