"""Whole-table builds: rebuild the normalised tables, refresh a derived view."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from sessionloom.operators.normalize import build_tables, unique_sessions
from sessionloom.plans import versions as V

#: The tables that describe no session and so belong to no capture.
SHARED_TABLES = {"service", "label", "history_legend"}
RAW = "raw"
CAPTURE = "source_file"


def rebuild(
    raw: DataFrame,
    out_dir: str,
    legend: str = "literal",
    label_on: str = "detailed_label",
    on_duplicate: str = "fail",
) -> dict[str, DataFrame]:
    """Write every normalised table anew; the outcome does not depend on what was there.

    The raw relation is read once and kept as `raw`, typed and columnar; each table then reads the
    few columns it needs. `raw` and the tables with a row per session are partitioned by capture, so a view
    of one capture reads that capture's folders alone. All tables come into force together when the last is
    written; a rebuild that fails leaves those of the one before. Returns the written tables, without `raw`.
    """
    spark, before = raw.sparkSession, V.current(raw.sparkSession, out_dir)
    version = before.new_version()
    new = {RAW: V.write_version(raw, out_dir, version, RAW, [CAPTURE])}
    typed = V.read_stored(spark, out_dir, new[RAW], RAW)
    tables = build_tables(unique_sessions(typed, on_duplicate), legend, label_on, [CAPTURE])
    for name, table in tables.items():
        by = [] if name in SHARED_TABLES else [CAPTURE]
        new[name] = V.write_version(table, out_dir, version, name, by)
    V.replace_tables(spark, out_dir, {n: (t, before.tables.get(n)) for n, t in new.items()}, before)
    return {name: V.read_stored(spark, out_dir, new[name], name) for name in tables}


def open_tables(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The normalised tables that the last finished rebuild left in a folder."""
    found = V.current(spark, out_dir).tables
    if not found:
        raise FileNotFoundError(f"no finished rebuild in {out_dir}")
    return {name: V.read_stored(spark, out_dir, t, name) for name, t in found.items() if name != RAW}


def materialize(df: DataFrame, path: str, partition_by: str = CAPTURE) -> DataFrame:
    """Replace a derived view's stored rows, partitioned by capture where it has that column.

    The view may be derived from the rows it replaces.
    """
    return V.replace_table(df, path, [partition_by] if partition_by in df.columns else [])


def refresh_captures(df: DataFrame, path: str, captures: Iterable[str]) -> DataFrame:
    """Replace the rows of some captures in a stored view; the others are left as they are."""
    return V.refresh_partitions(df, path, captures)


def open_view(spark: SparkSession, path: str) -> DataFrame:
    """A stored view's rows in force."""
    return V.open_table(spark, path)
