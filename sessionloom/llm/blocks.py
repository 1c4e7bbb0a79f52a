"""Documents packed into blocks, and array helpers on a block's bytes.

A block is some consecutive rows of one scan task, about `block_bytes` of text, kept as one
compressed value. Blocks are written once as a table bucketed by block number, so a later join on
that number moves only the small side. A row of a block table never changes, so a task that is run
again after a lost executor sees the same block.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.session import scratch_path

BLOCK_BYTES = 8 << 20
#: Stands for a null doc_id inside blocks: larger than every other, so it never makes others repeats.
NO_ID = np.iinfo(np.int64).max


def pack(value: object, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(value, protocol=5))


def unpack(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def partitions(spark) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_chunks(
    batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK_BYTES
) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """(ids, texts, is the text null) of about `block_bytes` of text each, rows in scan order."""
    ids, texts, null, size = [], [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            ids.append(NO_ID if i is None else i)
            texts.append(t or b"")
            null.append(t is None)
            size += len(t or b"") + 16
            if size >= block_bytes:
                yield np.array(ids, np.int64), texts, np.array(null, bool)
                ids, texts, null, size = [], [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts, np.array(null, bool)


def row_blocks(
    batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES
) -> Iterator[tuple[np.ndarray, list[bytes], pa.Table]]:
    """(ids, texts, all columns) of about `block_bytes` of text each, ids ascending in each."""

    def block(parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        ids = rows.column(id_col).cast(pa.int64()).fill_null(NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        rows = rows.take(pa.array(order))
        return ids[order], [t or b"" for t in rows.column(text_col).cast(pa.binary()).to_pylist()], rows

    parts, size = [], 0
    for batch in batches:
        lengths = [len(t or b"") + 16 for t in batch.column(batch.schema.names.index(text_col)).cast(pa.binary()).to_pylist()]
        at = 0
        for i, n in enumerate(lengths):
            size += n
            if size >= block_bytes:
                yield block([*parts, batch.slice(at, i + 1 - at)])
                parts, at, size = [], i + 1, 0
        if at < len(lengths):
            parts.append(batch.slice(at))
    if parts:
        yield block(parts)


def _block_writer(block_bytes: int, cuts: list[int], listed: Callable[[list[bytes]], bytes] | None):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 24
        n = 0
        for ids, texts, _ in text_chunks(batches, block_bytes):
            part = np.searchsorted(np.array(cuts, np.int64), ids, side="right")
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                at = at[np.argsort(ids[at], kind="stable")]
                own = [texts[i] for i in at]
                cells = [pa.array([base + n], pa.int64()), pa.array([int(p)], pa.int32()), pa.array([pack((ids[at], own))], pa.binary())]
                if listed:
                    cells.append(pa.array([listed(own)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cells, names=["block", "batch", "data", "listed"][: len(cells)])
                n += 1

    return write


def write_blocks(
    docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, cuts: list[int] | None = None,
    listed: Callable[[list[bytes]], bytes] | None = None,
) -> DataFrame:
    """The documents as a table (block, batch, data), bucketed by block.

    `data` holds the ids in ascending order and their texts. `cuts` are ascending ids at which a new
    batch begins; without them all is batch 0. With them each batch has a folder of its own, so that one is read without
    the others. `listed` makes one more column of that name from a block's texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "block long, batch int, data binary" + ", listed binary" * bool(listed)
    made = rows.mapInArrow(_block_writer(block_bytes, cuts or [], listed), schema)
    name = f"blocks_{uuid.uuid4().hex}"
    writer = (
        made.write.format("parquet")
        .option("path", scratch_path(spark, name))
        .option("compression", "none")
        .bucketBy(partitions(spark), "block")
    )
    (writer.partitionBy("batch") if cuts else writer).saveAsTable(name)
    return spark.table(name)


def concat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with a newline after each, as bytes, and where each begins (and the last ends)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), at


#: Bytes that end a word: blank, tab to carriage return.
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True


def word_bounds(data: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; `data` must end with a separator or be empty."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.concatenate(([False], ~separator[data]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[0::2], edge[1::2]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as one value, zeros past the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.lib.stride_tricks.as_strided(
        np.frombuffer(padded.tobytes(), "<u8", count=1), shape=(len(data) + 1,), strides=(1,)
    )


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value per span of bytes; spans of up to eight bytes and equal length never collide."""
    eight = lanes(data)
    length = (ends - starts).astype(np.uint64)
    out = mix(length + np.uint64(0x9E3779B97F4A7C15))
    live, k = np.arange(len(starts)), 0
    while len(live):
        left = length[live] - np.uint64(8 * k)
        lane = eight[starts[live] + 8 * k]
        short = left < 8
        lane[short] &= (np.uint64(1) << (left[short] * np.uint64(8))) - np.uint64(1)
        out[live] = mix(out[live] * np.uint64(0xD6E8FEB86659FD93) + lane)
        live, k = live[left > 8], k + 1
    return out


