"""Join of a large relation to a lookup whose size is measured first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

LOOKUP_ROWS = 10_000


def small_rows(df: DataFrame, max_rows: int = LOOKUP_ROWS) -> list[Row] | None:
    """The rows if there are at most `max_rows`, else None; never fetches more than one beyond."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def local_copy(df: DataFrame, max_rows: int = LOOKUP_ROWS) -> DataFrame | None:
    """A small relation held as literal rows, so that what follows does not run the plan behind
    them again; None if it is not small."""
    rows = small_rows(df, max_rows)
    return None if rows is None else df.sparkSession.createDataFrame(rows, df.schema)


def lookup_join(left: DataFrame, lookup: DataFrame, on, how: str = "inner") -> DataFrame:
    """Broadcast the lookup if it proves small; otherwise an ordinary shuffle join, whose
    skewed partitions the adaptive planner splits."""
    small = local_copy(lookup)
    return left.join(lookup if small is None else F.broadcast(small), on, how)
