"""Raw connection logs: text lines to typed rows.

`parse_conn_log` and `to_raw` are projections over whatever reads the lines, so the batch
reader and the file stream share them and neither shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom import schemas as S
from sessionloom.functions.tokens import flag_token, null_token, repair_labels

ALL_NULL_TOKENS = S.NULL_TOKENS + S.DEFAULT_NULL_TOKENS


def capture_name(capture: str = "file") -> Column:
    """The capture that a line read from a file belongs to: the file's name, or its folder's."""
    if capture == "file":
        return F.col("_metadata.file_name")
    if capture == "folder":
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        return F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    raise ValueError("capture must be 'file' or 'folder'")


def read_lines(spark: SparkSession, path: str, capture: str = "file") -> DataFrame:
    """Log lines with the name of the file, or folder, that each came from."""
    return spark.read.text(path).select("value", capture_name(capture).alias("source_file"))


def data_lines(lines: DataFrame) -> DataFrame:
    """Lines that are not comments. A `#` inside a line belongs to the data."""
    return lines.filter(~F.col("value").startswith("#") & (F.length("value") > 0))


def parse_conn_log(
    lines: DataFrame, repair: bool = True, nulls: Iterable[str] | None = None, count_as: str | None = None
) -> DataFrame:
    """23 text columns per data line, under the log's own names.

    Missing trailing fields are null, surplus ones are left out; other columns of `lines`
    (such as `source_file`) are kept. With `nulls`, those tokens become null on the way, while
    the fields are still one array: much less code per row than a test on every column. `count_as`
    names a column for the number of fields.
    """
    kept = [c for c in lines.columns if c != "value"]
    rows = data_lines(lines).withColumn("_fields", F.split("value", "\t", -1))
    if repair:
        rows = rows.withColumn("_fields", repair_labels(F.col("_fields")))
    if nulls is not None:
        tokens = list(nulls)
        rows = rows.withColumn("_fields", F.transform("_fields", lambda c: null_token(c, tokens)))
    counted = [F.size("_fields").alias(count_as)] if count_as else []
    return rows.select(*[F.get("_fields", i).alias(n) for i, n in enumerate(S.LOG_FIELDS)], *kept, *counted)


def raw_from_lines(lines: DataFrame) -> DataFrame:
    """Log lines to the typed raw relation: projections only."""
    return to_raw(parse_conn_log(lines, nulls=ALL_NULL_TOKENS))


def null_tokens(df: DataFrame, tokens: Iterable[str] | None = None) -> DataFrame:
    """Missing-value tokens of every text column as null."""
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    cells = [
        null_token(F.col(f"`{c}`"), tokens).alias(c) if c in text else F.col(f"`{c}`")
        for c in df.columns
    ]
    return df.select(cells)


def _typed(name: str, kind: T.DataType, source: str) -> Column:
    cell = F.col(f"`{source}`")
    if isinstance(kind, T.BooleanType):
        return flag_token(cell).alias(name)
    if isinstance(kind, T.IntegerType):
        # A column with gaps leaves a data-frame export as "443.0".
        return cell.try_cast("double").try_cast("int").alias(name)
    return cell.try_cast(kind).alias(name)


def typed_cells() -> dict[str, Column]:
    """Each raw column as an expression over the log's text column in its place."""
    return {n: _typed(n, t, src) for (n, t), src in zip(S.RAW_TYPES.items(), S.LOG_FIELDS)}


def to_raw(df: DataFrame) -> DataFrame:
    """The typed raw relation, dotted and hyphenated names renamed by position."""
    kept = [c for c in df.columns if c not in S.LOG_FIELDS]
    return df.select(*typed_cells().values(), *kept)


def with_source(df: DataFrame, name: str | Column) -> DataFrame:
    """Tag every record with the capture it belongs to."""
    return df.withColumn("source_file", F.lit(name) if isinstance(name, str) else name)


def read_conn_logs(spark: SparkSession, path: str, capture: str = "file") -> DataFrame:
    """Log files to the typed raw relation in one lazy plan. Captures are files, or folders of files."""
    return raw_from_lines(read_lines(spark, path, capture))


def null_tokens_except_source(df: DataFrame) -> DataFrame:
    """Null tokens in the log's columns only; the file name is ours."""
    cells = [
        null_token(F.col(f"`{c}`")).alias(c) if c in S.LOG_FIELDS else F.col(f"`{c}`")
        for c in df.columns
    ]
    return df.select(cells)
