"""Incremental ingest: the batch log transforms over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionloom.sources.conn_log import capture_name, raw_from_lines


def stream_lines(
    spark: SparkSession, path: str, max_files: int | None = None, capture: str = "file"
) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select("value", capture_name(capture).alias("source_file"))


def stream_ingest(
    spark: SparkSession, path: str, out: str, checkpoint: str, max_files: int | None = None
) -> None:
    """Append the files that are new since the last run to the raw table, then stop.

    The checkpoint records which files are done, so a restart neither repeats nor skips one.
    """
    rows = raw_from_lines(stream_lines(spark, path, max_files))
    query = (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .partitionBy("source_file")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
