"""Question rounds between blocks of documents and buckets of keys.

Corpus-wide questions ("does this key occur elsewhere", "which start is the
first") are asked by blocks of documents and answered by buckets of keys:

1. `pack` turns the rows into blocks of bounded size, one compressed Arrow
   stream each, laid out by block and checkpointed, so that a lost executor
   re-reads the shared copy and never reshuffles the texts.
2. A block names each distinct key once a round, however often it occurs in
   it. A hot key thus costs one entry a block, not one a row.
3. A bucket holds a range of the key space. Keys are scrambled, so buckets are
   even; their number follows the input, so a bucket's memory is bounded.
4. Answers go back to the block that asked, in the order of its entries.

The texts are shuffled once, when packed: later rounds group by block on the
partitioning that the checkpoint kept.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
BLOCK_BYTES = 4 << 20
LARGE_BYTES = 3 << 20
BUCKET_BYTES = 16 << 20
#: Compressed bytes of texts in a partition, beyond the session's number of shuffle partitions.
PARTITION_BYTES = 64 << 20
REPLY = "block long, round int, bucket int, blob binary"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's spark.checkpoint.dir; sets one only where none is set, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def laid_out(df: DataFrame, partitions: int, key: str) -> DataFrame:
    """`df` by the hash of `key`, checkpointed so that the plan still knows that layout.

    A plan that adaptive execution may change has no fixed layout to keep, so it is off while this one is made.
    """
    spark = df.sparkSession
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpoint(df.repartition(partitions, key))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


class Blocks:
    """Packed documents: `df` has block, n_bytes and payload; `count` blocks, `bytes` of text, laid out in `partitions`."""

    def __init__(self, df: DataFrame, count: int, size: int, spark: SparkSession, partitions: int):
        self.df, self.count, self.bytes, self.spark, self.partitions = df, count, size, spark, partitions

    def buckets(self, entry_bytes_per_text_byte: float) -> int:
        """Enough for buckets of bounded size, and for every core."""
        return max(64, int(self.bytes * entry_bytes_per_text_byte / BUCKET_BYTES) + 1)


def pack(df: DataFrame, text: str, keep: list[str], block_bytes: int = BLOCK_BYTES) -> Blocks:
    """The columns `keep` and `text` of all rows in blocks of about `block_bytes` of text.

    A longer text is a block of its own. Other columns, whatever their names, are dropped before they are read.
    """
    spark = df.sparkSession
    columns = list(dict.fromkeys([*keep, text]))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal serial, held, size
            row = pa.RecordBatch.from_pydict({
                "block": pa.array([(part << 32) | serial], pa.int64()),
                "n_bytes": pa.array([size], pa.int64()),
                "payload": pa.array([pack_table(pa.Table.from_batches(held).combine_chunks())], pa.binary()),
            })
            serial, held, size = serial + 1, [], 0
            return row

        for batch in batches:
            at, lengths = 0, np.asarray(pa.compute.binary_length(batch.column(text)).fill_null(0))
            ends = np.cumsum(lengths + 16)
            while at < len(lengths):
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + block_bytes - size, "right")))
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1] - base)
                at = to
                if size >= block_bytes or at < len(lengths):
                    yield flush()
        if held:
            yield flush()

    packed = df.select(*columns).mapInArrow(write, "block long, n_bytes long, payload binary")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_estimate(df.select(*columns)) // PARTITION_BYTES))
    packed = laid_out(packed, partitions, "block")
    n, size = packed.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    return Blocks(packed, n, size, spark, partitions)


def _estimate(df: DataFrame) -> int:
    """The planner's size of `df`: its files' bytes, where it is read from files. Joins without statistics say nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 58 else 0


def pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all().combine_chunks()


def release(table: pa.Table) -> None:
    """After a large block, as one with a very long text, gives freed memory back; for each block that would cost a fifth more time."""
    if table.nbytes <= LARGE_BYTES:
        return
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


Replies = dict[int, dict[int, bytes]]


def _held(replies: pd.DataFrame | None) -> Replies:
    out: Replies = {}
    if replies is not None:
        for rnd, bucket, blob in zip(replies["round"], replies["bucket"], replies["blob"], strict=True):
            out.setdefault(int(rnd), {})[int(bucket)] = blob
    return out


def each_block(blocks: Blocks, replies: DataFrame | None, run: Callable[[pa.Table, Replies, int], Iterator[pd.DataFrame] | pd.DataFrame], schema: str) -> DataFrame:
    """`run(table, replies, block)` for each block with all answers that it has had."""
    if replies is None:
        def alone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for block, payload in zip(frame["block"], frame["payload"], strict=True):
                    table = unpack(payload)
                    yield run(table, {}, int(block))
                    release(table)

        return blocks.df.select("block", "payload").mapInPandas(alone, schema)

    def grouped(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return empty
        table = unpack(left["payload"].iloc[0])
        out = run(table, _held(right), int(left["block"].iloc[0]))
        release(table)
        return out

    empty = blocks.spark.createDataFrame([], schema).toPandas()
    return blocks.df.select("block", "payload").groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(grouped, schema)


def ask(blocks: Blocks, replies: DataFrame | None, emit: Callable[[pa.Table, Replies, int], list[tuple[int, bytes]]]) -> DataFrame:
    """The entries of all blocks: block, bucket, blob."""

    def run(table: pa.Table, have: Replies, block: int) -> pd.DataFrame:
        rows = emit(table, have, block)
        return pd.DataFrame({"block": np.full(len(rows), block, np.int64), "bucket": np.array([r[0] for r in rows], np.int32), "blob": pd.Series([r[1] for r in rows], dtype=object)})

    return each_block(blocks, replies, run, "block long, bucket int, blob binary")


def answer(entries: DataFrame, rnd: int, judge: Callable[[list[bytes], list[int]], list[bytes]]) -> DataFrame:
    """`judge(blobs, blocks)` gives a bucket's answer to each blob; checkpointed."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = judge(frame["blob"].tolist(), frame["block"].tolist())
        return pd.DataFrame({"block": frame["block"], "round": np.int32(rnd), "bucket": frame["bucket"], "blob": pd.Series(out, dtype=object, index=frame.index)})

    return checkpoint(entries.groupBy("bucket").applyInPandas(run, REPLY))


# --- Entries -----------------------------------------------------------------------------------

def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Grows with the key, so that sorted keys are sorted by bucket."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def split(sorted_keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the buckets that have keys."""
    if not len(sorted_keys):
        return []
    at = bucket_of(sorted_keys, buckets)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return [(int(at[a]), int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(at)], strict=True)]


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags_of(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, compressed."""
    n = len(arrays[0])
    raw = b"".join([n.to_bytes(8, "little"), *(a.tobytes() for a in arrays)])
    packed = pa.compress(raw, codec="zstd", asbytes=True)
    return len(raw).to_bytes(8, "little") + packed


def expand(blob: bytes, *dtypes: str) -> list[np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(memoryview(blob)[8:], size, codec="zstd", asbytes=True)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in map(np.dtype, dtypes):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


def squeeze_numbers(*arrays: np.ndarray) -> bytes:
    """64-bit integers by the places of their bytes, so that small ones compress."""
    return squeeze(*(a.astype(np.int64, copy=False).view(np.uint8).reshape(len(a), 8).T.reshape(-1) for a in arrays))


def expand_numbers(blob: bytes, n: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(a.reshape(8, -1).T).reshape(-1).view(np.int64) for a in expand(blob, *["u1"] * n)]


def repeated(keys: list[np.ndarray], many: list[np.ndarray]) -> list[np.ndarray]:
    """For lists of distinct keys, each with a flag "more than once here": which keys occur more than once in all."""
    sizes = [len(k) for k in keys]
    if not sum(sizes):
        return [np.zeros(n, bool) for n in sizes]
    flat, weight = np.concatenate(keys), np.concatenate(many).astype(np.int64) + 1
    order = np.argsort(flat, kind="stable")
    starts = runs_of(flat[order])
    total = np.add.reduceat(weight[order], starts)
    out = np.empty(len(flat), bool)
    out[order] = np.repeat(total > 1, np.diff([*starts, len(flat)]))
    return np.split(out, np.cumsum(sizes)[:-1])


def runs_of(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
