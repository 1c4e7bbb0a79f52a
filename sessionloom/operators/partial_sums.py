"""Sums of NumPy vectors over all rows, one vector per task, added up on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of a vector that travel in one row.
PIECE = 8192
#: Bytes of all tasks' vectors that are added on the driver instead, which saves a shuffle for each sum.
DIRECT_BYTES = 32 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """Arrow lists of equal length as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _emit(partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.asarray(partial(batches), np.float64).ravel()
        task = TaskContext.get().partitionId()
        for piece, at in enumerate(range(0, len(total), PIECE)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task], pa.int32()), pa.array([piece], pa.int32()),
                    pa.array([total[at : at + PIECE].tobytes()], pa.binary()),
                ],
                names=["task", "piece", "data"],
            )

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, total = None, None
    for batch in batches:
        for piece, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            own = np.frombuffer(data)
            if piece != now:
                if now is not None:
                    yield _piece(now, total)
                now, total = piece, own.copy()
            else:
                total += own
    if now is not None:
        yield _piece(now, total)


def _piece(piece: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([piece], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["piece", "data"]
    )


def summed(
    rows: DataFrame, size: int, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], own_tasks: int | None = None
) -> np.ndarray:
    """The sum over tasks of what `partial` makes of a task's rows: a vector of `size` numbers.

    Vectors are added piece by piece in tasks, in the order of the tasks they come from, so that equal input
    gives equal sums. Only the total reaches the driver; or the tasks' vectors, if the caller knows that the rows are
    in `own_tasks` tasks and these vectors are small together.
    """
    n = -(-size // PIECE)
    parts = rows.mapInArrow(_emit(partial), "task int, piece int, data binary")
    if own_tasks and own_tasks * size * 8 <= DIRECT_BYTES:
        total = np.zeros(n * PIECE)
        for r in sorted(parts.collect(), key=lambda r: (r.piece, r.task)):
            own = np.frombuffer(r.data)
            total[r.piece * PIECE : r.piece * PIECE + len(own)] += own
        return total[:size]
    tasks = min(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = parts.repartition(tasks, "piece").sortWithinPartitions("piece", "task")
    found = {r.piece: np.frombuffer(r.data) for r in dealt.mapInArrow(_add, "piece int, data binary").collect()}
    return np.concatenate([found[k] for k in range(n)]) if found else np.zeros(size)


def second_moments(rows: DataFrame, vector: str | Column) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, sum of a vector column, and the sum of its outer products."""
    width_of = rows.select(F.size(vector_to_array(vector)).alias("n")).first()
    if width_of is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    width = width_of.n

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        n, total, outer = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                n, total, outer = n + len(x), total + x.sum(0), outer + x.T @ x
        return np.concatenate(([n], total, outer.ravel()))

    out = summed(rows.select(vector_to_array(vector).alias("x")), 1 + width + width * width, partial)
    return int(out[0]), out[1 : 1 + width], out[1 + width :].reshape(width, width)
