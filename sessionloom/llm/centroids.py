"""Centroid clustering on integers, with distances from lookup tables.

Vectors become integers once and are written in blocks. A block keeps, for each dimension, the integer
values that occur in it and one small code per vector. In each round a block tabulates the squared
difference of every occurring value to every centroid, dimension by dimension; a vector's distances
are then gathers from these tables, summed over the dimensions. Tables are bounded by the block's rows,
so the method does not depend on how many values occur in all. Every vector goes to the nearest centroid, ties
to the smaller number, and every centroid that has vectors becomes their componentwise floor(sum / count).

All arithmetic is exact: tables are 32-bit, 64-bit or Python integers, whichever the block's and the
centroids' range needs, and sums travel in limbs of 40 bits. A task adds up its blocks before anything
moves: a round shuffles clusters x dimensions x limbs numbers a task, and as many reach the driver in all.
The first centroids are the vectors with the smallest SHA-256 of a seed and their id.

Defined cases: only vectors with exactly `dims` components, none null or infinite or NaN, take part; others have
no row in the result. Rows with a null id take part, after all others where first centroids are drawn.
Equal hashes (repeated ids) are drawn in the order of their components. Repeated rows are repeated. With
fewer vectors than centroids there are as many centroids as vectors. A distance or sum of distances beyond 64 bits
is null. An empty table gives no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.blocks import pack, unpack
from sessionloom.session import scratch_path, stable

CENTROIDS = 40
ROUNDS = 5
DIMS = 64
SCALE = 256
SEED = 2
BLOCK_ROWS = 8192
LIMB = 40
BLOCK = "data binary"
PARTIAL = "cluster int, dim int, limb int, value long"
ASSIGNED = "vec_id long, cluster int, distance long"


def usable(vector, dims: int):
    """Whether a vector has all its components, and finite ones."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return (F.size(vector) == dims) & sound


def integers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit where all fit well, else Python's."""
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * scale)
    if not len(scaled) or np.abs(scaled).max() < 1 << 52:
        return scaled.astype(np.int64)
    return np.array([math.floor(scale * x) if math.isfinite(s) else scale * int(x) for x, s in zip(flat.tolist(), scaled)], object)


def _block_writer(dims: int, scale: int, block_rows: int):
    def block(ids: list, vectors: list[np.ndarray]) -> pa.RecordBatch:
        whole = integers(np.concatenate(vectors), scale).reshape(-1, dims)
        values, codes = [], []
        for d in range(dims):
            occurring, code = np.unique(whole[:, d], return_inverse=True)
            values.append(occurring)
            codes.append(code.astype(np.uint8 if len(occurring) <= 256 else np.uint16))
        return pa.RecordBatch.from_arrays([pa.array([pack((ids, values, codes))], pa.binary())], names=["data"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, n = [], [], 0
        for batch in batches:
            own, flat = batch.column(0).to_pylist(), batch.column(1).flatten().to_numpy(zero_copy_only=False)
            at = 0
            while at < len(own):
                stop = min(len(own), at + block_rows - n)
                ids += own[at:stop]
                vectors.append(flat[at * dims : stop * dims])
                n, at = n + stop - at, stop
                if n == block_rows:
                    yield block(ids, vectors)
                    ids, vectors, n = [], [], 0
        if n:
            yield block(ids, vectors)

    return write


def vector_blocks(
    vectors: DataFrame, id_col: str, vector_col: str, dims: int = DIMS, scale: int = SCALE, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per block of usable vectors; `block_rows` is 65,536 at most."""
    if block_rows > 1 << 16:
        raise ValueError("codes are 16-bit: at most 65,536 rows a block")
    spark = vectors.sparkSession
    path = scratch_path(spark, "vector-blocks")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    blocks = rows.filter(usable(F.col("v"), dims)).mapInArrow(_block_writer(dims, scale, block_rows), BLOCK)
    blocks.write.option("compression", "none").parquet(path)
    return spark.read.parquet(path)


def first_centroids(
    vectors: DataFrame, id_col: str, vector_col: str, k: int = CENTROIDS, dims: int = DIMS,
    scale: int = SCALE, seed: int = SEED,
) -> list[list[int]]:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    drawn = rows.filter(usable(F.col("v"), dims)).select(
        F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v"
    )
    top = drawn.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return [[int(x) for x in integers(np.array(r.v, float), scale)] for r in top]


def distances(values: list[np.ndarray], codes: list[np.ndarray], centroids: list[list[int]]) -> np.ndarray:
    """Squared distance of each vector to each centroid: gathers from one table per dimension."""
    reach = max(
        max(abs(int(own[0]) - c), abs(int(own[-1]) - c)) for d, own in enumerate(values) for c in (p[d] for p in centroids)
    )
    most = reach * reach * len(values)
    kind = np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object
    total = np.zeros((len(codes[0]), len(centroids)), kind)
    for d, (own, code) in enumerate(zip(values, codes)):
        apart = own.astype(kind)[:, None] - np.array([p[d] for p in centroids], kind)[None, :]
        total += (apart * apart)[code]
    return total


def _partial_sums(centroids: list[list[int]], dims: int):
    """Per task: the count (as dimension `dims`) and the sums of each cluster, in limbs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * (dims + 1) for _ in centroids]
        for batch in batches:
            for data in batch.column(0):
                _, values, codes = unpack(data.as_py())
                cluster = distances(values, codes, centroids).argmin(1)
                order = np.argsort(cluster, kind="stable")
                met, begin = np.unique(cluster[order], return_index=True)
                for c, n in zip(met.tolist(), np.diff(np.append(begin, len(cluster))).tolist()):
                    sums[c][dims] += n
                for d in range(dims):
                    for c, s in zip(met.tolist(), np.add.reduceat(values[d][codes[d][order]], begin).tolist()):
                        sums[c][d] += s
        rows = []
        for c, own in enumerate(sums):
            for d, s in enumerate(own if own[dims] else []):
                limb = 0
                while s not in (0, -1) or limb == 0:
                    rows.append((c, d, limb, s & ((1 << LIMB) - 1)))
                    s, limb = s >> LIMB, limb + 1
                if s:  # what is left of a negative number
                    rows.append((c, d, limb, -1))
        columns = list(zip(*rows)) or [()] * 4
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(columns, kinds)], names=["cluster", "dim", "limb", "value"]
        )

    return run


def moved(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round."""
    dims = len(centroids[0])
    parts = blocks.mapInArrow(_partial_sums(centroids, dims), PARTIAL)
    sums = [[0] * (dims + 1) for _ in centroids]
    for r in parts.groupBy("cluster", "dim", "limb").agg(F.sum("value").alias("value")).collect():
        sums[r.cluster][r.dim] += r.value << (LIMB * r.limb)
    return [[s // own[dims] for s in own[:dims]] if own[dims] else old for own, old in zip(sums, centroids)]


def _assign(centroids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                ids, values, codes = unpack(data.as_py())
                total = distances(values, codes, centroids)
                cluster = total.argmin(1)
                least = total[np.arange(len(cluster)), cluster]
                if least.dtype == object:
                    least = [int(x) if x < 1 << 63 else None for x in least]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(least, pa.int64())],
                    names=["vec_id", "cluster", "distance"],
                )

    return run


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS,
    rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): one row per usable vector.

    `centroid` is the final centroid's components, joined by commas.
    """
    spark = vectors.sparkSession
    blocks = vector_blocks(vectors, id_col, vector_col, dims, scale, block_rows)
    centroids = first_centroids(vectors, id_col, vector_col, k, dims, scale, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(blocks, centroids)
    assigned = stable(blocks.mapInArrow(_assign(centroids), ASSIGNED))

    def whole(name: str):
        # A null distance or a sum beyond 64 bits makes the total null.
        exact = F.sum(F.col(name).cast("decimal(38,0)")).try_cast("long")
        return F.when(F.count("*") == F.count(name), exact)

    # One row a cluster, at most k of them.
    own = assigned.groupBy("cluster").agg(whole("distance").alias("cluster_inertia"))
    total = {r.cluster: r.cluster_inertia for r in own.collect()}
    inertia = None if None in total.values() or sum(total.values()) >= 1 << 63 else sum(total.values())
    rows = [(c, total[c], inertia, ",".join(map(str, centroids[c]))) for c in sorted(total)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid string")
    return assigned.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )
