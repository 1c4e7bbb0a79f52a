"""Loads that account for every line: sound ones and malformed ones from one scan of the text.

A line is malformed if, after the label repair, it has fewer or more fields than the log's, or if a cell that is
no missing-value token does not fit its column's type. Malformed lines are loaded all the same - missing fields and
misfit cells are null, surplus fields are left out - and are also kept as they were, with what is wrong with them.
Both go to one table in one pass, `clean=true` and `clean=false` apart, so the malformed ones are a folder of their
own. Totals and the report per file read the written column of problems alone.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom import schemas as S
from sessionloom.session import open_files
from sessionloom.sources.conn_log import ALL_NULL_TOKENS, parse_conn_log, read_lines, typed_cells

#: What is wrong with a line, null for a sound one: fields it has, columns whose cell does not fit, the line itself.
PROBLEM = T.StructType([
    T.StructField("n_fields", T.IntegerType()), T.StructField("misfits", T.ArrayType(T.StringType())),
    T.StructField("line", T.StringType()),
])
#: The columns a cell can fail to fit.
TYPED = [c for c, kind in S.RAW_TYPES.items() if not isinstance(kind, T.StringType)]
SHORT, LONG, MISFIT, ALL = "short", "long", "misfit", "all"


def checked_lines(lines: DataFrame) -> DataFrame:
    """The typed raw relation with one more column, `problem`."""
    kept = [c for c in lines.columns if c != "value"]
    cells = parse_conn_log(
        lines.withColumn("_line", F.col("value")), nulls=ALL_NULL_TOKENS, count_as="_n_fields"
    )
    typed = typed_cells()
    found = cells.select(
        *[typed[c].alias(c) for c in S.RAW_COLUMNS], *kept, "_line", "_n_fields",
        *[F.col(f"`{src}`").isNotNull().alias(f"_has_{c}") for c, src in zip(S.RAW_COLUMNS, S.LOG_FIELDS) if c in TYPED],
    )
    misfits = F.array_compact(F.array(*[
        F.when(F.col(f"_has_{c}") & F.col(c).isNull(), F.lit(c)) for c in TYPED
    ]))
    whole = (F.col("_n_fields") == len(S.LOG_FIELDS)) & (F.size(misfits) == 0)
    problem = F.struct(F.col("_n_fields").alias("n_fields"), misfits.alias("misfits"), F.col("_line").alias("line"))
    return found.select(*S.RAW_COLUMNS, *kept, F.when(~whole, problem).alias("problem"))


def _is_short() -> Column:
    return F.col("problem.n_fields") < len(S.LOG_FIELDS)


def _is_long() -> Column:
    return F.col("problem.n_fields") > len(S.LOG_FIELDS)


def line_totals() -> list[Column]:
    """Aggregates over all lines of a load."""
    misfit = lambda c: F.array_contains("problem.misfits", c)
    return [
        F.count(F.lit(1)).alias(ALL), F.count_if(_is_short()).alias(SHORT), F.count_if(_is_long()).alias(LONG),
        *[F.count_if(misfit(c)).alias(f"{MISFIT}_{c}") for c in TYPED],
    ]


def _split_by_soundness(rows: DataFrame) -> DataFrame:
    return rows.withColumn("clean", F.col("problem").isNull())


def load_checked(lines: DataFrame, path: str, by: Iterable[str] = ("source_file",)) -> dict[str, int]:
    """Write the lines' rows and problems below `path`, and return the totals.

    The totals come from the written column of problems, not from the text again. They are not observed on the
    way as the stream's are: a session that has made an observation cannot run the library's model closures any
    more, as it does not let itself be serialised with them.
    """
    with open_files(lines.sparkSession):
        _split_by_soundness(checked_lines(lines)).write.mode("errorifexists").partitionBy("clean", *by).parquet(path)
    stated = T.StructType([T.StructField("problem", PROBLEM)])
    return lines.sparkSession.read.schema(stated).parquet(path).agg(*line_totals()).first().asDict()


def stream_checked(
    lines: DataFrame, out: str, checkpoint: str, by: Iterable[str] = ("source_file",)
) -> None:
    """The same for a stream of lines: append what is new since the last run, then stop.

    The totals of each batch are among the observed metrics of the query's progress, as `log lines`.
    """
    rows = checked_lines(lines).observe("log lines", *line_totals())
    query = (
        _split_by_soundness(rows).writeStream.format("parquet")
        .option("path", out).option("checkpointLocation", checkpoint)
        .partitionBy("clean", *by).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def loaded_rows(spark: SparkSession, path: str) -> DataFrame:
    """The typed raw relation of a checked load."""
    return spark.read.parquet(path).drop("problem", "clean")


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """The malformed lines as they were, with their file, number of fields and misfit columns.

    Reads the folder of malformed lines alone.
    """
    bad = spark.read.parquet(path).filter(~F.col("clean"))
    kept = [c for c in bad.columns if c not in (*S.RAW_COLUMNS, "problem", "clean")]
    return bad.select(*kept, "problem.*")


def parse_report(spark: SparkSession, path: str, by: str = "source_file") -> DataFrame:
    """(source_file, problem, column_name, n): lines of each file, and how many are malformed in which way.

    `problem` is `all`, `short`, `long` or `misfit`; the last comes once per column. What no line of a file has
    is not listed. A line that is malformed in several ways counts for each.
    """
    kind = "array<struct<problem string, column_name string>>"
    none = F.lit(None).cast("string")
    one = lambda name: F.struct(F.lit(name).alias("problem"), none.alias("column_name"))
    misfits = F.transform(
        F.coalesce("problem.misfits", F.array().cast("array<string>")),
        lambda c: F.struct(F.lit(MISFIT).alias("problem"), c.alias("column_name")),
    )
    seen = F.concat(
        F.array(one(ALL)).cast(kind),
        F.array_compact(F.array(F.when(_is_short(), one(SHORT)), F.when(_is_long(), one(LONG)))).cast(kind),
        misfits.cast(kind),
    )
    # The schema is given because a load without lines has no file to infer it from.
    stated = T.StructType([T.StructField("problem", PROBLEM), T.StructField(by, T.StringType())])
    return (
        spark.read.schema(stated).parquet(path).select(F.col(by), F.inline(seen))
        .groupBy(by, "problem", "column_name").agg(F.count(F.lit(1)).alias("n"))
    )


def read_checked(spark: SparkSession, log_path: str, out: str) -> tuple[DataFrame, dict[str, int]]:
    """Load log files through `load_checked`: the raw relation and the totals."""
    totals = load_checked(read_lines(spark, log_path), out)
    return loaded_rows(spark, out), totals
