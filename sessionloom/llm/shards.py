"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

The rows lie in input partitions of known sizes and go to cells of exact sizes; some neighbouring
cells make a shard. How many rows each partition sends to each cell is drawn first, from the
hypergeometric law that a uniform permutation of all rows would give: exactly, at any size, and in tasks
that make some partitions' counts each. The driver knows only how many rows each partition and each cell has.
Each partition then permutes its rows and deals them out by these counts, and each cell permutes what it
gets. A row's slot is its place in the cell plus the slots of the shard's earlier cells. Cells are as many
as there are shuffle partitions, so no task holds a whole shard.

Rows are placed independently of what they hold: repeated rows, nulls and a source with a third of
all rows need no special care. Shard sizes differ by one row at most. Fewer rows than shards leave
some shards empty; an empty table gives no rows. Columns named `shard` and `slot` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.blocks import partitions
from sessionloom.session import scratch_path

#: So many items are drawn one by one.
FEW = 16


def even_sizes(total: int, parts: int) -> np.ndarray:
    return np.full(parts, total // parts, np.int64) + (np.arange(parts) < total % parts)


def draw_without_return(draw: np.random.Generator, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of `n` items, drawn without return from `good` and `bad` ones, are good; numbers of any size.

    Each item is taken with the chance n / (good + bad). Of those taken too many, a uniform choice is given
    back; of those that lack, one is taken from the rest. Both are draws of the same kind with some root of n
    items, down to a few that are drawn one by one. The outcome is a uniform choice of n items exactly.
    """
    good, bad, n = (np.array(x, np.int64) for x in (good, bad, n))
    out, sign = np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
    while (live := np.flatnonzero(n > FEW)).size:
        g, b, want = good[live], bad[live], n[live]
        chance = np.minimum(1.0, want / (g + b))
        taken, rest = draw.binomial(g, chance), draw.binomial(b, chance)
        out[live] += sign[live] * taken
        lack = want - taken - rest
        good[live], bad[live] = np.where(lack >= 0, g - taken, taken), np.where(lack >= 0, b - rest, rest)
        sign[live] = np.where(lack >= 0, sign[live], -sign[live])
        n[live] = np.abs(lack)
    for k in range(int(n.max(initial=0))):
        live = np.flatnonzero(n > k)
        hit = draw.integers(0, good[live] + bad[live]) < good[live]
        out[live] += sign[live] * hit
        good[live] -= hit
        bad[live] -= ~hit
    return out


def deal(draw: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How many of `n` items drawn without return come from each group; groups are halved, all halves at once."""
    levels = [sizes.astype(np.int64)]
    while len(levels[-1]) > 1:
        last = np.append(levels[-1], 0) if len(levels[-1]) % 2 else levels[-1]
        levels.append(last[0::2] + last[1::2])
    got = np.array([n], np.int64)
    for level in levels[-2::-1]:
        pairs = np.append(level, 0) if len(level) % 2 else level
        left = draw_without_return(draw, pairs[0::2], pairs[1::2], got)
        got = np.stack((left, got - left), axis=1).reshape(-1)[: len(level)]
    return got


def communication_matrix(
    sources: np.ndarray, targets: np.ndarray, seed: int, first: int = 0, last: int | None = None
) -> np.ndarray:
    """Rows `first` to `last` of random counts with the given row and column sums, as a uniform permutation has them.

    The sources are halved again and again; what a half sends is drawn from a generator of its own. So
    any rows can be made anywhere, by the draws on the way to them, and fit all others.
    """
    last = len(sources) if last is None else last
    before = np.concatenate(([0], np.cumsum(sources, dtype=np.int64)))
    out = np.zeros((max(0, last - first), len(targets)), np.int64)
    todo = [(0, len(sources), targets.astype(np.int64))] if last > first else []
    while todo:
        low, high, sent = todo.pop()
        if high - low == 1:
            out[low - first] = sent
            continue
        half = (low + high) // 2
        left = deal(np.random.default_rng((seed, low, high)), sent, int(before[half] - before[low]))
        todo += [
            (i, j, part) for i, j, part in ((low, half, left), (half, high, sent - left)) if i < last and j > first
        ]
    return out


def _rows_of_matrix(parts: np.ndarray, sizes: np.ndarray, cells: np.ndarray, begins: np.ndarray, per_shard: int, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                sent = communication_matrix(sizes, cells, seed, i, i + 1)[0]
                to = np.cumsum(sent)
                c = np.flatnonzero(sent)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(c), parts[i], np.int32)), pa.array(to[c] - sent[c]), pa.array(to[c]),
                        pa.array(c.astype(np.int32)), pa.array((c // per_shard).astype(np.int32)), pa.array(begins[c]),
                    ],
                    names=["_part", "_from", "_to", "_cell", "shard", "_begin"],
                )

    return rows


def uniform_shards(rows: DataFrame, n_shards: int, seed: int = 17) -> DataFrame:
    """Add `shard` (0 to n_shards - 1) and `slot` (gapless from 0 in each shard) to all rows.

    Every cell of a shard has the same size up to one row, and every shard of the table too. The rows
    are written once, so that their place in a partition stays when a task is run again.
    """
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c not in ("shard", "slot")]
    path = scratch_path(spark, "shard-input")
    # Columns of the input travel as one, so that none of their names can clash with those used here.
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(None).cast("int")
    rows.select(
        whole.alias("whole"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_pos")
    ).write.parquet(path)
    placed = spark.read.parquet(path)
    counts = placed.groupBy("_part").count().orderBy("_part").collect()
    total = sum(r["count"] for r in counts)
    per_shard = -(-partitions(spark) // n_shards)
    shard_sizes = even_sizes(total, n_shards)
    cells = np.concatenate([even_sizes(int(s), per_shard) for s in shard_sizes])
    begins = np.concatenate([np.cumsum(c) - c for c in cells.reshape(n_shards, per_shard)])
    parts, sizes = (np.array([r[k] for r in counts], np.int64) for k in ("_part", "count"))
    matrix = spark.range(0, len(parts), 1, min(len(parts), partitions(spark)) or 1).mapInArrow(
        _rows_of_matrix(parts, sizes, cells, begins, per_shard, seed),
        "_part int, _from long, _to long, _cell int, shard int, _begin long",
    )
    tickets = matrix.select(
        "_part", F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias("_rank"), "_cell", "shard", "_begin"
    )
    local = Window.partitionBy("_part").orderBy(F.xxhash64(F.lit(seed), "_pos"), "_pos")
    dealt = placed.withColumn("_rank", F.row_number().over(local).cast("long")).join(
        tickets.hint("merge"), ["_part", "_rank"]
    )
    inside = Window.partitionBy("_cell").orderBy(F.xxhash64(F.lit(seed + 1), "_pos"), "_pos")
    return dealt.withColumn("slot", F.col("_begin") + F.row_number().over(inside) - 1).select(
        *[F.col(f"whole.`{c}`").alias(c) for c in columns], "shard", "slot"
    )
