"""Profiling, cleaning and integrity checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.operators.joins import local_copy


def _name(c: str) -> Column:
    return F.col(f"`{c}`")


def _null_counts(df: DataFrame) -> DataFrame:
    """One row: the number of rows as `_rows`, and the nulls of each column as `_0`, `_1`, ..."""
    nulls = [F.count_if(_name(c).isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)]
    return df.agg(F.count(F.lit(1)).alias("_rows"), *nulls)


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values and how many, from one pass over the rows."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("n_missing"))
        for i, c in enumerate(df.columns)
    ])
    return _null_counts(df).select(F.inline(pairs)).filter("n_missing > 0")


def sparse_columns(df: DataFrame, max_null: float = 0.3) -> list[str]:
    """Columns whose share of nulls is above `max_null`."""
    row = _null_counts(df).first()
    total = row["_rows"]
    return [c for i, c in enumerate(df.columns) if total and row[f"_{i}"] / total > max_null]


def drop_sparse_columns(df: DataFrame, max_null: float = 0.3) -> DataFrame:
    return df.drop(*sparse_columns(df, max_null))


def fill_zero(df: DataFrame) -> DataFrame:
    """Nulls (and NaN) of the numeric columns as 0."""
    return df.na.fill(0)


def numeric_only(df: DataFrame) -> DataFrame:
    """The numeric columns; booleans are not numbers here."""
    return df.select([_name(f.name) for f in df.schema if isinstance(f.dataType, T.NumericType)])


def class_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def drop_if_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop columns by exact name, ignoring absent ones (a dotted name is a plain name)."""
    unwanted = set(cols)
    return df.select([_name(c) for c in df.columns if c not in unwanted])


def render_rows(df: DataFrame, name: str = "line") -> DataFrame:
    """Each row as one `column=value, column=value` line."""
    cells = [
        F.concat(F.lit(f"{c}="), F.coalesce(_name(c).cast("string"), F.lit("nan")))
        for c in df.columns
    ]
    return df.select(F.concat_ws(", ", *cells).alias(name))


def pk_violations(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Key values that are null or occur more than once, with their number of rows."""
    keys = list(keys)
    any_null = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | any_null)


def fk_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child key values with no parent row, and how many child rows hold each.

    The child is counted per key before the join, so a frequent key travels once. Parent keys go to every task only
    if they prove few: a size that is guessed from the file would have a whole key column sent around. Many are dealt
    to all shuffle partitions, which are not merged again by their compressed size, so a task sorts few of them.
    """
    keys = (
        child.filter(F.col(child_key).isNotNull())
        .groupBy(child_key)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    parents = parent.select(F.col(parent_key).alias("_parent"))
    small = local_copy(parents)
    if small is None:
        parts = int(parent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parents = parents.repartition(parts, "_parent").hint("merge")
    else:
        parents = F.broadcast(small)
    return keys.join(parents, F.col(child_key) == F.col("_parent"), "left_anti")


def require_unique(df: DataFrame, keys: Iterable[str]) -> None:
    bad = pk_violations(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"duplicate or null keys, such as {[tuple(r) for r in bad]}")


def keep_first(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """One row per key: the smallest by `order`. Aggregates map-side, so a hot key is no task."""
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[_name(c) for c in order], F.struct(*[_name(c) for c in rest]).alias("_row"))
    first = df.groupBy(*keys).agg(F.min(row).alias("_first"))
    return first.select(*keys, *[F.col(f"_first._row.`{c}`").alias(c) for c in rest]).select(
        [_name(c) for c in df.columns]
    )
