"""Stored tables that are replaced without ever being absent or half written.

A refresh writes its rows into folders of a new version and touches no earlier one. When all of them are written, one
small file that lists the folders in force is put in the place of the old one, in one rename. A job that fails before
that leaves the old rows in force; readers that opened the table before go on with the folders they know, which stay
until the refresh after next. Several tables under one root change together.

    root/current.json                                    what is in force: schemas and folders of all tables
    root/[table/]rows/[capture/]table_version=V/*.parquet

Two refreshes of one root at a time are not kept apart: the last to finish wins.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.session import open_files

VERSION = "table_version"
POINTER = "current.json"
#: How a folder's name says that the partition's value is null.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class Stored:
    """A table as one version has it: its schema, and each partition's folder below `rows` with the version it is of.

    A table without partitions has one folder, by the name of ''.
    """

    schema: T.StructType
    partition_by: list[str]
    folders: dict[str, str] = field(default_factory=dict)

    def paths(self, base: str) -> list[str]:
        return ["/".join(x for x in (base, f, f"{VERSION}={v}") if x) for f, v in sorted(self.folders.items())]


@dataclass
class Current:
    """What is in force under a root."""

    number: int = 0
    tables: dict[str, Stored] = field(default_factory=dict)

    def new_version(self) -> str:
        return f"{self.number + 1:08d}-{uuid.uuid4().hex[:8]}"


def _rows(root: str, table: str) -> str:
    return "/".join(x for x in (root.rstrip("/"), table, "rows") if x)


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(place), fs


def current(spark: SparkSession, root: str) -> Current:
    """What is in force; nothing where no refresh has finished yet."""
    place, fs = _hadoop(spark, f"{root}/{POINTER}")
    if not fs.exists(place):
        return Current()
    stated = json.loads(spark.read.text(f"{root}/{POINTER}", wholetext=True).first()[0])
    tables = {
        name: Stored(T.StructType.fromJson(t["schema"]), t["partition_by"], t["folders"])
        for name, t in stated["tables"].items()
    }
    return Current(stated["number"], tables)


def write_version(
    df: DataFrame, root: str, version: str, table: str = "", partition_by: Iterable[str] = ()
) -> Stored:
    """Write the rows as folders of a version that is not in force yet."""
    spark, by = df.sparkSession, list(partition_by)
    base = _rows(root, table)
    with open_files(spark):
        df.withColumn(VERSION, F.lit(version)).write.mode("append").partitionBy(*by, VERSION).parquet(base)
    place, fs = _hadoop(spark, "/".join([base, *["*"] * len(by), f"{VERSION}={version}"]))
    top = _hadoop(spark, base)[0].toUri().getPath()
    folders = {}
    for status in fs.globStatus(place) or []:
        folder = status.getPath().getParent().toUri().getPath()
        folders[folder.removeprefix(top).strip("/")] = version
    return Stored(df.schema, by, folders)


def switch(spark: SparkSession, root: str, now: Current) -> None:
    """Put `now` in force: one rename over the old pointer."""
    stated = {
        "number": now.number,
        "tables": {
            name: {"schema": t.schema.jsonValue(), "partition_by": t.partition_by, "folders": t.folders}
            for name, t in now.tables.items()
        },
    }
    place, fs = _hadoop(spark, f"{root}/{POINTER}")
    fresh, _ = _hadoop(spark, f"{root}/.{uuid.uuid4().hex}")
    out = fs.create(fresh)
    out.write(bytearray(json.dumps(stated).encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    over = getattr(hadoop, "Options$Rename")
    choice = spark.sparkContext._gateway.new_array(over, 1)
    choice[0] = over.OVERWRITE
    context = hadoop.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fresh, place, choice)


def read_stored(spark: SparkSession, root: str, stored: Stored, table: str = "") -> DataFrame:
    base, names = _rows(root, table), stored.schema.names
    if not stored.folders:
        return spark.createDataFrame([], stored.schema)
    typed = T.StructType([*stored.schema, T.StructField(VERSION, T.StringType())])
    rows = spark.read.schema(typed).option("basePath", base).parquet(*stored.paths(base))
    return rows.select(*[F.col(f"`{c}`") for c in names])


def open_table(spark: SparkSession, root: str, table: str = "") -> DataFrame:
    """The rows in force of one table under a root."""
    found = current(spark, root).tables
    if table not in found:
        raise FileNotFoundError(f"no table {table!r} in force under {root}")
    return read_stored(spark, root, found[table], table)


def _drop_older(spark: SparkSession, root: str, table: str, before: Stored | None, now: Stored, number: int) -> None:
    """Delete folders of versions older than the last one in force that neither it nor the new one uses."""
    base = _rows(root, table)
    place, fs = _hadoop(spark, "/".join([base, *["*"] * len(now.partition_by), f"{VERSION}=*"]))
    used = {_hadoop(spark, p)[0].toUri().getPath() for t in (before, now) if t is not None for p in t.paths(base)}
    for status in fs.globStatus(place) or []:
        folder = status.getPath()
        written = int(folder.getName().removeprefix(f"{VERSION}=").split("-")[0])
        if written < number and folder.toUri().getPath() not in used:
            fs.delete(folder, True)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of a job's own that nothing reads any more."""
    place, fs = _hadoop(spark, path)
    fs.delete(place, True)


def replace_tables(
    spark: SparkSession, root: str, tables: dict[str, tuple[Stored, Stored | None]], before: Current
) -> None:
    """Put new versions (with those they follow) in force together, then drop what is too old."""
    after = Current(before.number + 1, before.tables | {name: new for name, (new, _) in tables.items()})
    switch(spark, root, after)
    for name, (new, old) in tables.items():
        _drop_older(spark, root, name, old, new, before.number)


def replace_table(df: DataFrame, root: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Replace a table's rows; `df` may read the rows it replaces. Returns the table as stored."""
    spark, before = df.sparkSession, current(df.sparkSession, root)
    new = write_version(df, root, before.new_version(), "", partition_by)
    replace_tables(spark, root, {"": (new, before.tables.get(""))}, before)
    return read_stored(spark, root, new)


def refresh_partitions(df: DataFrame, root: str, values: Iterable[str | None]) -> DataFrame:
    """Replace the rows of some values of the table's one partition column by those that `df` has for them.

    Other values' folders are neither read nor written. A value without rows in `df` loses its rows.
    """
    spark, before = df.sparkSession, current(df.sparkSession, root)
    old = before.tables.get("")
    if old is None or len(old.partition_by) != 1:
        raise ValueError(f"no table under {root} that is partitioned by one column")
    if df.schema.names != old.schema.names:
        raise ValueError("the table has other columns")
    column, values = old.partition_by[0], list(values)
    chosen = F.col(column).isin([v for v in values if v is not None])
    if None in values:
        chosen = F.coalesce(chosen, F.lit(False)) | F.col(column).isNull()
    fresh = write_version(df.filter(chosen), root, before.new_version(), "", [column])
    kept = {f: v for f, v in old.folders.items() if _value(f) not in values}
    new = Stored(old.schema, old.partition_by, kept | fresh.folders)
    replace_tables(spark, root, {"": (new, old)}, before)
    return read_stored(spark, root, new)


def _value(folder: str) -> str | None:
    """The partition value that a folder's name states."""
    text = unquote(folder.split("=", 1)[1])
    return None if text == NULL_FOLDER else text
