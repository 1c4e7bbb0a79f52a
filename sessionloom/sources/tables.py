"""CSV and Parquet in and out, and reads of named relations."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom import schemas as S
from sessionloom.session import scratch_path
from sessionloom.sources.conn_log import null_tokens_except_source, to_raw

CSV_TEXT = T.StructType([T.StructField(n, T.StringType()) for n in S.LOG_FIELDS])


def load_dir(spark: SparkSession, path: str) -> DataFrame:
    """Every `*.csv` directly in a folder as one raw relation, tagged with its file name."""
    rows = (
        spark.read.schema(CSV_TEXT)
        .option("header", True)
        .option("enforceSchema", True)
        .option("pathGlobFilter", "*.csv")
        .option("escape", '"')
        .csv(path)
        .select(
            *[F.col(f"`{n}`") for n in S.LOG_FIELDS],
            F.col("_metadata.file_name").alias("source_file"),
        )
    )
    return to_raw(null_tokens_except_source(rows))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header and doubled quotes inside quoted cells, one file per partition."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def write_parquet(
    df: DataFrame, path: str, partition_by: Iterable[str] = (), mode: str = "overwrite"
) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def read_relation(
    spark: SparkSession, name: str, jdbc: dict[str, str] | None = None
) -> DataFrame:
    """A whole table or view: from the catalog, a Parquet path, or a database.

    `jdbc` holds the reader's options (`url`, and `partitionColumn`, `lowerBound`,
    `upperBound`, `numPartitions` so that the read is split over tasks).
    """
    if jdbc is not None:
        if "partitionColumn" not in jdbc:
            raise ValueError("a database read needs partitionColumn, or one task reads it all")
        return spark.read.format("jdbc").options(dbtable=name, **jdbc).load()
    if "/" in name:
        return spark.read.parquet(name)
    return spark.table(name)


def read_captures(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Several Parquet captures stacked by column name; an absent column is null."""
    frames = [spark.read.parquet(p) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by key over three tasks a core.

    For what is costly per row: without it, tasks are as many and as uneven as the input's files can be split, and a
    file of few row groups leaves most cores idle.
    """
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def preview(df: DataFrame, order: Iterable[str], n: int = 10) -> DataFrame:
    """The first `n` rows in a stated order (a per-partition top-n, not a sort)."""
    return df.orderBy(*order).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def append_metrics(df: DataFrame, path: str) -> None:
    """Add metric rows to those of earlier runs."""
    write_csv(df, path, mode="append")


def with_row_id(df: DataFrame, order: Iterable[str | Column], name: str = "id") -> DataFrame:
    """Number the rows 1, 2, ... in the given order without a window over all rows.

    The rows are range-partitioned and sorted, and written once with their partition and place; an id is the place
    plus the sizes of the partitions before, which are counted from the written partition numbers alone. `order`
    should identify rows, so that no run of equal keys makes a partition large.
    """
    path = scratch_path(df.sparkSession, "row-ids")
    in_partition = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    placed = _sorted_by_range(df, list(order)).select(
        whole.alias("whole"), F.spark_partition_id().alias("_part"), in_partition.alias("_row")
    )
    placed.write.option("compression", "zstd").parquet(path)
    numbered = df.sparkSession.read.parquet(path)
    sizes = partition_offsets(numbered, [], {"_n": F.count(F.lit(1))})
    columns = [F.col(f"whole.`{c}`").alias(c) for c in df.columns if c != name]
    return numbered.join(F.broadcast(sizes), "_part").select(*columns, (F.col("_row") + F.col("_n") + 1).alias(name))


def _sorted_by_range(df: DataFrame, order: list) -> DataFrame:
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def partition_offsets(df: DataFrame, group: list[str], measures: dict[str, Column]) -> DataFrame:
    """Per (partition, group), the measures summed over the group's earlier partitions.

    At most one row per partition and group boundary, which bounds what is broadcast.
    """
    from pyspark.sql import Window

    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    if group:
        before = (
            Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        )
    totals = df.groupBy("_part", *group).agg(*[m.alias(n) for n, m in measures.items()])
    return totals.select(
        "_part",
        *group,
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in measures],
    )
