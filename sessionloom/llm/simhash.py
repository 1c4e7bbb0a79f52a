"""SimHash near-dedup with pigeonring filtering.

A document's fingerprint has 64 bits: bit b is 1 if more than half of its word shingles' XXH64 values
have it set. Fingerprints within `DISTANCE` differing bits are linked.

The fingerprint is cut into five segments in a ring. If two fingerprints differ in at most four bits
in all, there is a segment from which on every chain of k consecutive segments differs in at most
4k/5 bits: none in the first segment, one in the first two, two in three, three in four. So two
linked fingerprints agree on a whole segment and on the next one but for one bit, and they meet under
one of 64 keys: that segment and the next one with one bit masked. Within a key the longer
chains are checked, then all bits. Only distinct fingerprints take part. A task turns the links it
finds into a forest, so copies and dense groups give no more rows than they have fingerprints; a key
with more than `CHUNK` fingerprints is cut into chunks, whose pairs are compared in tasks of their own.

Defined cases: a null or blank text has fingerprint 0 and is linked like any other. Rows with a null
id take part; a component's id is the smallest id that is not null. Repeated rows are repeated in the
result. An empty table gives no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.blocks import mix, partitions
from sessionloom.llm.components import components
from sessionloom.session import scratch_path, stable

DISTANCE = 4
SHINGLE = 4
SEED = 42
CHUNK = 1 << 16
#: Bits of each of the five segments.
WIDTHS = (13, 13, 13, 13, 12)
SHIFTS = tuple(sum(WIDTHS[:i]) for i in range(5))
MASKS = tuple(np.uint64(((1 << w) - 1) << s) for w, s in zip(WIDTHS, SHIFTS))
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
UPPER_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(UPPER_TO_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    start = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=start[1:])
    ends = start[min(shingle, len(words)) :] - 1
    hash64 = xxhash.xxh64_intdigest
    values = np.fromiter(
        (hash64(joined[i:j], SEED) for i, j in zip(start[:n].tolist(), ends.tolist())), np.uint64, n
    )
    octets = values.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ BITS_OF_BYTE for k in range(8)])
    return int(((counts * 2 > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(t.as_py() or b"", shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], names=["id", "fingerprint"]
            )

    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint as a signed long) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "id long, fingerprint long")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under its 64 keys; the key's low three bits are the segment's number."""
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(whole), 20_000):
            part = whole[at : at + 20_000]
            keys = []
            for i in range(5):
                j = (i + 1) % 5
                both = part & (MASKS[i] | MASKS[j])
                for bit in range(WIDTHS[j]):
                    masked = both & ~np.uint64(1 << (SHIFTS[j] + bit))
                    keys.append((mix(masked ^ mix(np.array([64 * i + bit + 1], np.uint64))) & ~np.uint64(7)) | np.uint64(i))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(part, 64).view(np.int64))],
                names=["key", "fingerprint"],
            )


def linked(a: np.ndarray, b: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Which pairs of fingerprints that share a key pass the longer chains and the full check."""
    apart = a ^ b
    ok = np.ones(np.broadcast(apart, segment).shape, bool)
    for length in (3, 4):
        chain = np.array([np.bitwise_or.reduce([MASKS[(i + k) % 5] for k in range(length)]) for i in range(5)])
        ok &= np.bitwise_count(apart & chain[segment]) <= DISTANCE * length // 5
    ok[ok] = np.bitwise_count(np.broadcast_to(apart, ok.shape)[ok]) <= DISTANCE
    return ok


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one link per node: (node, smallest node of its component)."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not (root == root[root]).all():
            root = root[root]
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def reach(left: np.ndarray, right: np.ndarray, segment: int) -> tuple[list, list]:
    """Links that join all of `left` and `right` that hang together, found breadth first.

    A value is compared only with those not reached yet, which keeps dense groups cheap. `right` may be
    `left` itself.
    """
    us, vs = [], []
    same = left is right
    sides = [left] if same else [left, right]
    waiting = [np.ones(len(s), bool) for s in sides]
    while waiting[0].any():
        first = int(np.argmax(waiting[0]))
        waiting[0][first] = False
        front, side = np.array([first]), 0
        while len(front):
            other = 0 if same else 1 - side
            open_ = np.flatnonzero(waiting[other])
            found = []
            for at in range(0, len(front), 256):
                some = sides[side][front[at : at + 256]]
                if not len(open_):
                    break
                ok = linked(some[:, None], sides[other][open_][None, :], np.array(segment))
                hit = ok.any(0)
                us.append(some[ok[:, hit].argmax(0)])
                vs.append(sides[other][open_[hit]])
                found.append(open_[hit])
                waiting[other][open_[hit]] = False
                open_ = open_[~hit]
            front = np.concatenate(found) if found else np.zeros(0, np.int64)
            side = other
    return us, vs


def _link_rows(u: list, v: list) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (u, v))
    a, b = forest(a.astype(np.uint64), b.astype(np.uint64))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64()),
            pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary()),
        ],
        names=["u", "v", "key", "no", "chunk"],
    )


def _within_keys(chunk: int):
    """Links within each key; of a key with more than `chunk` rows, its chunks instead."""

    def settle(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        size = np.diff(np.append(begin, len(keys)))
        us, vs = [], []
        small = np.repeat((size > 1) & (size <= 32), size)
        k, p = keys[small], prints[small]
        for lag in range(1, 32):
            pair = np.flatnonzero(k[lag:] == k[:-lag])
            if not len(pair):
                break
            ok = pair[linked(p[pair], p[pair + lag], (k[pair] & np.uint64(7)).astype(np.int64))]
            us.append(p[ok])
            vs.append(p[ok + lag])
        for at, n in zip(begin[size > 32], size[size > 32]):
            group = prints[at : at + n]
            u, v = reach(group, group, int(keys[at] & np.uint64(7)))
            us += u
            vs += v
        return _link_rows(us, vs)

    def chunk_row(key: np.uint64, no: int, prints: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key.view(np.int64)], pa.int64()),
                pa.array([no], pa.int32()), pa.array([prints.tobytes()], pa.binary()),
            ],
            names=["u", "v", "key", "no", "chunk"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        cut, no = None, 0  # the key whose first chunks were set aside, and how many
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            prints = np.concatenate((prints, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            while len(keys) > chunk:
                n = int(np.argmax(keys != keys[0])) or len(keys)  # rows of the first key
                if n < len(keys) and keys[0] != cut and n <= chunk:
                    n = int(np.flatnonzero(keys != keys[-1])[-1]) + 1  # whole keys, but for the last
                    yield settle(keys[:n], prints[:n])
                else:
                    n = min(n, chunk)
                    no = no + 1 if keys[0] == cut else 0
                    cut = keys[0]
                    yield chunk_row(cut, no, prints[:n])
                keys, prints = keys[n:], prints[n:]
        n = int((keys == cut).sum()) if cut is not None else 0
        if n:
            yield chunk_row(cut, no + 1, prints[:n])
        if len(keys) > n:
            yield settle(keys[n:], prints[n:])

    return run


def _between_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
            left = np.frombuffer(a, np.uint64)
            right = left if b is None else np.frombuffer(b, np.uint64)
            yield _link_rows(*reach(left, right, key & 7)).select(["u", "v"])


def fingerprint_links(prints: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints (column `fingerprint`) that hang together."""
    spark = prints.sparkSession
    keys = prints.select("fingerprint").mapInArrow(_keys, "key long, fingerprint long")
    dealt = keys.repartition(partitions(spark), "key").sortWithinPartitions("key")
    found = stable(
        dealt.mapInArrow(_within_keys(chunk), "u long, v long, key long, no int, chunk binary")
    )
    aside = found.filter("chunk is not null").select("key", "no", "chunk")
    later = aside.select("key", F.col("no").alias("no2"), F.col("chunk").alias("chunk2"))
    pairs = aside.join(later.hint("merge"), "key").filter("no <= no2").select(
        "key", "chunk", F.when(F.col("no") < F.col("no2"), F.col("chunk2")).alias("chunk2")
    )
    spread = pairs.repartition(partitions(spark))
    return found.filter("u is not null").select("u", "v").union(
        spread.mapInArrow(_between_chunks, "u long, v long")
    )


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, chunk: int = CHUNK
) -> DataFrame:
    """(id, fingerprint, component_id) of every row; the component's id is its smallest document's."""
    marked = stable(fingerprints(docs, id_col, text_col, shingle))
    classes = marked.groupBy("fingerprint").agg(F.min("id").alias("least"))
    links = fingerprint_links(classes, chunk)
    grouped = classes.join(components(links).toDF("fingerprint", "root"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = grouped.join(named, "root").select("fingerprint", "component_id")
    return marked.join(labels, "fingerprint").select("id", "fingerprint", "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, chunk: int = CHUNK
) -> DataFrame:
    """All columns of one row of each group: the smallest id, null ids last, then the first in the scan.

    Rows are written once with a number of their own, so repeated and null ids are told apart; only
    numbers and fingerprints are grouped.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "simhash-rows")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), whole.alias("whole"))
    numbered.write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    own = rows.select("row", F.col("whole")[id_col].cast("long").alias("id"))
    groups = simhash_groups(rows.select("row", F.col("whole")[text_col].alias("text")), "row", "text", shingle, chunk)
    best = groups.select(F.col("id").alias("row"), "component_id").join(own.hint("merge"), "row").groupBy("component_id").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))["row"].alias("row")
    )
    return rows.join(best.select("row").hint("merge"), "row", "left_semi").select("whole.*")
