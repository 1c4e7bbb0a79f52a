"""Byte-level dedup with a logarithmic family of suffix-array indexes.

A string of `LENGTH` bytes that also starts in a document with a smaller id is a repeat; every byte that a
repeat covers is removed. Documents come in batches of ascending ids and of a fixed size. Each batch gets a suffix array;
it is merge-scanned against the levels that are there, and then becomes a level of its own. Before
the next batch, levels of equal size are merged, so after n batches there are about log2(n) levels
and every suffix was rewritten at most that often.

The suffix arrays are sparse. Of the places in a window of `LENGTH` bytes where `GRAM` bytes still fit, the one
whose bytes have the smallest hash is the window's anchor. Equal windows have equal anchors, so only
suffixes at anchors are indexed, one in 14 places. They are sorted by a fingerprint of their first `GRAM` bytes;
any order of prefixes serves, as long as equal ones are neighbours, and this one cuts the index
into ranges of equal weight. An entry is a fingerprint and the block that holds it. Levels are tables
bucketed by range, so scans and merges read neighbouring files and move nothing.

Two levels are scanned against each other as they are merged, and those left after the last batch at the end, so every
two batches meet once and an entry is read once for each level it is in. A scan marks the entries with a
neighbour elsewhere; marks stay with their range. A small level has few files, which double as it does. Blocks then
send the bytes around marked anchors, where all windows are compared in full (as 64-bit hashes of their 50 bytes,
among those with equal anchors). A run of windows that a block holds several times is sent once; a
passage that a third of all documents share reaches its group once per block. A block's anchors are found once, when it
is written.

Defined cases: a null text is empty. A null id comes after all others. Rows with the same id are no
repeats of each other. Texts shorter than `LENGTH` stay whole; an empty table gives no rows. What is kept may
cut a character in two, so it is binary. Columns other than the two named are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import blocks as B
from sessionloom.llm.substring_dedup import covered, ragged
from sessionloom.session import scratch_path

LENGTH = 50
GRAM = 24
WINDOWS = LENGTH - GRAM + 1
#: Bits of a fingerprint in the index.
BITS = 48
#: Text of one batch, about.
BATCH_BYTES = 128 << 20
#: Text for which there is a range of the index, and a group of the comparison; at least one for each shuffle partition.
RANGE_BYTES, GROUP_BYTES = 16 << 20, 4 << 20
#: Files of a level of one batch, as far as there are shuffle partitions.
FILES = 8
#: How many times the files of another level can be read together; Spark's own bound.
RATIO = 4
_COALESCE = "spark.sql.bucketing.coalesceBucketsInJoin.enabled"
U = np.uint64
PRIMES = [U(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending values as differences, their bytes plane by plane."""
    planes = np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


class Anchors:
    """Runs of neighbouring windows of a block with one anchor; `listed` is what `packed` made of the same texts."""

    def __init__(self, texts: list[bytes], listed: bytes | None = None):
        self.data, self.at = B.concat(texts)
        none = np.zeros(0, np.int64)
        self.first, self.count, self.left, self.key = none, none, none, none.view(U)
        if listed is not None:
            gap, count, left = B.unpack(listed)
            self.count, self.left = count.astype(np.int64), left.astype(np.int64)
            self.first = np.cumsum(gap + self.count) - self.count
        elif len(self.data) - GRAM + 1 >= WINDOWS:
            self._find()
        eight, at = B.lanes(self.data), self.first + self.left
        if len(at):
            key = B.mix(eight[at] * PRIMES[1] + U(1))
            for lane in (8, 16):
                key = B.mix(key * PRIMES[0] + eight[at + lane])
            self.key = key >> U(64 - BITS)

    def packed(self) -> bytes:
        gap = self.first - np.concatenate(([0], (self.first + self.count)[:-1]))[: len(self.first)]
        return B.pack((gap.astype(np.int64), self.count.astype(np.uint8), self.left.astype(np.uint8)))

    def _find(self) -> None:
        n = len(self.data) - GRAM + 1
        eight = B.lanes(self.data)
        value = eight[:n] * PRIMES[0]
        value += eight[8 : n + 8] * PRIMES[1]
        value += eight[16 : n + 16] * PRIMES[2]
        value ^= value >> U(32)
        value *= PRIMES[3]
        places = U((1 << int(n).bit_length()) - 1)
        value &= ~places
        value |= np.arange(n, dtype=U)
        width = 1
        while 2 * width <= WINDOWS:
            value = np.minimum(value[:-width], value[width:])
            width *= 2
        if width < WINDOWS:
            value = np.minimum(value[: len(value) - (WINDOWS - width)], value[WINDOWS - width :])
        anchor = (value & places).astype(np.int64)
        del value
        ends = self.at[1:] - 1
        valid = np.zeros(len(anchor) + 1, np.int8)
        some = ends - self.at[:-1] >= LENGTH
        valid[self.at[:-1][some]] += 1
        valid[(ends - LENGTH + 1)[some]] -= 1
        valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
        new = valid.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        last = valid.copy()
        last[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
        # A text's first window begins a run even if the text before ended just there.
        starts = self.at[:-1][some]
        new[starts] = True
        last[starts[starts > 0] - 1] &= valid[starts[starts > 0] - 1]
        self.first = np.flatnonzero(new)
        self.count = np.flatnonzero(last) - self.first + 1
        self.left = anchor[self.first] - self.first


def _listed(texts: list[bytes]) -> bytes:
    return Anchors(texts).packed()


def _cuts(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of each run of equal values."""
    begin = np.flatnonzero(np.diff(values, prepend=-1))
    return list(zip(values[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(values)]))


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> U(BITS - 32)) * U(ranges) >> U(32)).astype(np.int64)


def _list_suffixes(ranges: int):
    """A block's fingerprints by range; one that occurs several times is listed twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, listed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                keys = np.sort(Anchors(B.unpack(data.as_py())[1], listed).key)
                more = np.zeros(len(keys), bool)
                more[2:] = keys[2:] == keys[:-2]
                keys = keys[~more]
                cut = _cuts(range_of(keys, ranges))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r for r, _, _ in cut], pa.int32()), pa.array([block] * len(cut), pa.int64()),
                        pa.array([pack_sorted(keys[i:j]) for _, i, j in cut], pa.binary()),
                    ],
                    names=["range", "block", "keys"],
                )

    return run


def _marks(keys: np.ndarray, owners: np.ndarray) -> list[bytes]:
    """The fingerprints by owner, in one packed piece; no piece if there are none."""
    if not len(keys):
        return []
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    return [B.pack([(o, pack_sorted(keys[i:j])) for o, i, j in _cuts(owners)], 1)]


LEVEL = "range int, keys binary, owners binary, marks array<binary>"


def _level(r: int, keys: np.ndarray, owners: np.ndarray, marks: list[bytes]) -> list[pa.Array]:
    return [
        pa.array([r], pa.int32()), pa.array([pack_sorted(keys)], pa.binary()), pa.array([B.pack(owners)], pa.binary()),
        pa.array([marks], pa.list_(pa.binary())),
    ]


LEVEL_NAMES = ["range", "keys", "owners", "marks"]


def _sort_suffixes(table: pa.Table) -> pa.Table:
    """The batch's suffix array in one range, and marks of the entries that occur several times in it."""
    parts = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
    keys = np.concatenate(parts)
    owners = np.repeat(np.array(table.column("block").to_pylist(), np.int64), [len(p) for p in parts])
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[1:] == keys[:-1]
    shared = same[1:] | same[:-1]
    once = ~same[:-1]
    once[1:] |= owners[1:] != owners[:-1]
    marks = _marks(keys[shared & once], owners[shared & once])
    return pa.table(_level(table.column("range")[0].as_py(), keys[once], owners[once], marks), names=LEVEL_NAMES)


def _scan_and_merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both sides' entries of a range in order, with marks of those whose fingerprint the other side has.

    An entry whose own side has its fingerprint several times is marked already.
    """
    for batch in batches:
        for r, ka, oa, kb, ob, old in zip(*(batch.column(c).to_pylist() for c in range(6))):
            one, two = unpack_sorted(ka), unpack_sorted(kb)
            keys, owners = np.concatenate((one, two)), np.concatenate((B.unpack(oa), B.unpack(ob)))
            order = np.argsort(keys, kind="stable")
            keys, owners, side = keys[order], owners[order], order >= len(one)
            run = np.cumsum(np.diff(keys, prepend=keys[:1]) != 0)
            right = np.bincount(run, weights=side).astype(np.int64)
            left = np.bincount(run) - right
            fresh = ((left > 0) & (right > 0))[run] & (np.where(side, right[run], left[run]) == 1)
            marks = [*(old or []), *_marks(keys[fresh], owners[fresh])]
            yield pa.RecordBatch.from_arrays(_level(r, keys, owners, marks), names=LEVEL_NAMES)


class SuffixIndex:
    """Levels, smallest last: tables (range, keys, owners, marks) bucketed by range."""

    def __init__(self, spark: SparkSession, ranges: int = 0):
        self.spark = spark
        self.ranges = max(B.partitions(spark), ranges)
        self.levels: list[tuple[int, str, str]] = []  # batches in it, table, path

    def _files(self, batches: int) -> int:
        """As many as `FILES` for each batch, doubled in whole, so that one level's files hold some of another's in whole."""
        most = max(1, min(batches, B.partitions(self.spark) // FILES))
        return min(FILES << (most.bit_length() - 1), B.partitions(self.spark))

    def _save(self, rows: DataFrame, batches: int) -> tuple[str, str]:
        name = f"suffixes_{uuid.uuid4().hex}"
        path = scratch_path(self.spark, name)
        (
            rows.write.format("parquet").option("path", path).option("compression", "none")
            .bucketBy(self._files(batches), "range").saveAsTable(name)
        )
        return name, path

    def _drop(self, name: str, path: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def _beside(self, left: str, right: str, files: int = 0) -> DataFrame:
        """Both levels' arrays of each range, empty where a level has none, and the marks of both.

        `files` is the left one's number of files if the right one has far fewer: only that one is dealt to them.
        """
        a = self.spark.table(left)
        b = self.spark.table(right).toDF("range", "keys2", "owners2", "marks2")
        b = b.repartition(files, "range") if files else b
        nothing, nobody = F.lit(pack_sorted(np.zeros(0, U))), F.lit(B.pack(np.zeros(0, np.int64)))
        none = F.array().cast("array<binary>")
        return a.join(b.hint("merge"), "range", "full").select(
            "range", F.coalesce("keys", nothing), F.coalesce("owners", nobody),
            F.coalesce("keys2", nothing), F.coalesce("owners2", nobody),
            F.concat(F.coalesce("marks", none), F.coalesce("marks2", none)),
        )

    def _merge_last(self) -> None:
        """Scan the last two levels against each other and put one in their place.

        Files of a level with more of them are read together. One with far fewer is dealt to the other's.
        """
        (n, *old), (m, *older) = self.levels.pop(), self.levels.pop()
        files = self._files(m) if self._files(m) > RATIO * self._files(n) else 0
        before = self.spark.conf.get(_COALESCE)
        self.spark.conf.set(_COALESCE, "true")
        try:
            saved = self._save(self._beside(older[0], old[0], files).mapInArrow(_scan_and_merge, LEVEL), n + m)
        finally:
            self.spark.conf.set(_COALESCE, before)
        self._drop(*old)
        self._drop(*older)
        self.levels.append((n + m, *saved))

    def merge_equal(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] >= self.levels[-2][0]:
            self._merge_last()

    def add(self, blocks: DataFrame) -> None:
        """Index a batch (block, data, and `listed` if it was written), marking what it shares with itself."""
        self.merge_equal()
        listed = F.col("listed") if "listed" in blocks.columns else F.lit(None).cast("binary")
        found = blocks.select("block", "data", listed.alias("listed")).mapInArrow(
            _list_suffixes(self.ranges), "range int, block long, keys binary"
        )
        dealt = found.repartition(self._files(1), "range")
        self.levels.append((1, *self._save(dealt.groupBy("range").applyInArrow(_sort_suffixes, LEVEL), 1)))

    def marks(self) -> DataFrame:
        """(block, marks): the fingerprints of each block that occur elsewhere or several times in it, in some packed
        pieces, as a table bucketed by block. The levels that are left become one, which goes when its marks are written.
        """
        while len(self.levels) > 1:
            self._merge_last()
        _, *last = self.levels.pop()
        found = self.spark.table(last[0]).select("marks").mapInArrow(_deal_marks, "block long, marks binary")
        name = f"marks_{uuid.uuid4().hex}"
        (
            found.groupBy("block").agg(F.collect_list("marks").alias("marks"))
            .write.format("parquet").option("path", scratch_path(self.spark, name))
            .bucketBy(B.partitions(self.spark), "block").saveAsTable(name)
        )
        self._drop(*last)
        return self.spark.table(name)


def _deal_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in (piece for pieces in batch.column(0).to_pylist() for piece in pieces):
            own = B.unpack(data)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in own], pa.int64()), pa.array([k for _, k in own], pa.binary())],
                names=["block", "marks"],
            )


class Plan:
    """The runs of a block at shared anchors; `head` are the ones sent, by group."""

    def __init__(
        self, ids: np.ndarray, texts: list[bytes], listed: bytes | None, marks: list[bytes] | None, groups: int
    ):
        self.anchors = a = Anchors(texts, listed)
        marked = np.sort(np.concatenate([np.zeros(0, U), *map(unpack_sorted, marks or [])]))
        place = np.searchsorted(marked, a.key)
        at = np.flatnonzero(np.append(marked, U(1) << U(BITS))[place] == a.key)
        self.first, self.count, self.left = a.first[at], a.count[at], a.left[at]
        self.id = ids[np.searchsorted(a.at, self.first, side="right") - 1]
        size = self.count + LENGTH - 1
        value = B.mix(B.span_hashes(a.data, self.first, self.first + size) ^ (self.left * 64 + self.count).astype(U))
        _, self.head, self.same = np.unique(value, return_index=True, return_inverse=True)
        group = (B.mix(a.key[at[self.head]] + U(3)) % U(groups)).astype(np.int64)
        order = np.lexsort((self.head, group))
        self.sent, self.group = self.head[order], group[order]

    def payloads(self) -> Iterator[tuple[int, bytes]]:
        for group, i, j in _cuts(self.group):
            sent = self.sent[i:j]
            size = self.count[sent] + LENGTH - 1
            text = self.anchors.data[ragged(self.first[sent], size)].tobytes()
            yield group, B.pack((self.count[sent].astype(np.uint8), np.diff(self.id[sent], prepend=0), text))


def _send(groups: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3)))
            for block, data, listed, marks in cells:
                sent = list(Plan(*B.unpack(data.as_py())[:2], listed, marks, groups).payloads())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([g for g, _ in sent], pa.int32()), pa.array([block] * len(sent), pa.int64()),
                        pa.array([p for _, p in sent], pa.binary()),
                    ],
                    names=["group", "block", "data"],
                )

    return send


def repeated_windows(count: np.ndarray, ids: np.ndarray, text: bytes) -> np.ndarray:
    """Per run a bit for each of its windows whose bytes a run of a smaller id holds as well."""
    data = np.frombuffer(text, np.uint8)
    eight = B.lanes(data)
    size = count + LENGTH - 1
    start = ragged(np.cumsum(size) - size, count)
    value = np.full(len(start), PRIMES[3], U)
    for lane in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        value = B.mix(value * PRIMES[0] + eight[start + lane])
    run = np.repeat(np.arange(len(count)), count)
    order = np.argsort(value)
    new = np.ones(len(order), bool)
    new[1:] = value[order[1:]] != value[order[:-1]]
    owner, begin = ids[run[order]], np.flatnonzero(new)
    least = np.minimum.reduceat(owner, begin) if len(begin) else owner
    again = order[owner > np.repeat(least, np.diff(begin, append=len(order)))]
    hit = np.zeros(len(start), bool)
    hit[again] = True
    place = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
    bits = np.where(hit, U(1) << place.astype(U), U(0))
    return np.bitwise_or.reduceat(bits, np.cumsum(count) - count) if len(count) else bits


def _compare(table: pa.Table) -> pa.Table:
    blocks = table.column("block").to_pylist()
    parts = [B.unpack(p) for p in table.column("data").to_pylist()]
    sizes = [len(p[0]) for p in parts]
    hit = repeated_windows(
        np.concatenate([p[0] for p in parts]).astype(np.int64), np.concatenate([np.cumsum(p[1]) for p in parts]),
        b"".join(p[2] for p in parts),
    ).astype(np.uint32)
    out = [(b, h) for b, h in zip(blocks, np.split(hit, np.cumsum(sizes)[:-1])) if h.any()]
    return pa.table(
        {
            "block": pa.array([b for b, _ in out], pa.int64()),
            "group": pa.array([table.column("group")[0].as_py()] * len(out), pa.int32()),
            "hits": pa.array([B.pack(h) for _, h in out], pa.binary()),
        }
    )


def _remove(groups: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = zip(batch.column(0), *(batch.column(i).to_pylist() for i in (1, 2, 3)))
            for data, listed, marks, replies in cells:
                ids, texts, *_ = B.unpack(data.as_py())
                plan = Plan(ids, texts, listed, marks, groups)
                mask = np.zeros(len(plan.first), U)
                for r in replies or []:
                    mask[plan.sent[plan.group == r["group"]]] = B.unpack(r["hits"])
                if len(mask):
                    head = plan.head[plan.same]
                    mask = np.where(plan.id > plan.id[head], (U(1) << plan.count.astype(U)) - U(1), mask[head])
                starts = np.concatenate(
                    [np.zeros(0, np.int64), *(plan.first[(mask >> U(t)) & U(1) > 0] + t for t in range(WINDOWS))]
                )
                a = plan.anchors
                gone = covered(len(a.data), starts, starts + LENGTH)
                kept, at = a.data[~gone].tobytes(), np.concatenate(([0], np.cumsum(~gone)))[a.at]
                n = np.diff(a.at) - 1
                run_at = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)
                spans = np.diff(np.searchsorted(run_at, a.at))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, mask=ids == B.NO_ID), pa.array(n), pa.array(n - np.diff(at) + 1),
                        pa.array(spans.astype(np.int64)),
                        pa.array([kept[i : j - 1] for i, j in zip(at[:-1], at[1:])], pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return remove


def dedup_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES,
    block_bytes: int = B.BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every document without its repeated bytes.

    Batches of about as many documents each, by ascending id, are added to the index one after the other. There is
    one for every `batch_bytes` of text, so their number follows the data; a batch should fill the cluster.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    batches = max(1, -(-total // batch_bytes))
    shares = [k / batches for k in range(1, batches)] or [0.5]
    accuracy = max(1000, 10 * batches)
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), shares, accuracy).alias("c")).first().c
    last = sorted({c + 1 for c in cuts or []}) if batches > 1 else []
    rows = docs.select(id_col, text_col)
    if last and _spread(rows, id_col, last) > 2:
        # Ids in no order: a block would be cut into as many as there are batches.
        ids = F.col(id_col).cast("long").asc_nulls_last()
        rows = rows.repartitionByRange(max(batches, B.partitions(spark)), ids, F.xxhash64(text_col))
    table = B.write_blocks(rows, id_col, text_col, block_bytes, last, _listed)
    index = SuffixIndex(spark, -(-total // RANGE_BYTES))
    for k in range(batches):
        index.add(table.filter(F.col("batch") == k))
    groups = max(B.partitions(spark), -(-total // GROUP_BYTES))
    own = table.select("block", "data", "listed").join(index.marks().hint("merge"), "block", "left")
    sent = own.select("block", "data", "listed", "marks").mapInArrow(_send(groups), "group int, block long, data binary")
    hits = sent.groupBy("group").applyInArrow(_compare, "block long, group int, hits binary")
    replies = hits.groupBy("block").agg(F.collect_list(F.struct("group", "hits")).alias("replies"))
    return (
        own.join(replies.hint("merge"), "block", "left").select("data", "listed", "marks", "replies")
        .mapInArrow(_remove(groups), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    )


def _spread(docs: DataFrame, id_col: str, cuts: list[int]) -> float:
    """In how many more batches than one a part of the table has ids, on average over parts with rows, beyond the
    batches' own number over the parts'."""
    ends = docs.groupBy(F.spark_partition_id()).agg(
        F.min(F.col(id_col).cast("long")).alias("low"), F.max(F.col(id_col).cast("long")).alias("high")
    )
    inside = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: (c > F.col("low")) & (c <= F.col("high"))))
    found = ends.agg(F.sum(inside).alias("cut"), F.count("*").alias("parts")).first()
    return ((found.cut or 0) - len(cuts)) / max(found.parts, 1)
