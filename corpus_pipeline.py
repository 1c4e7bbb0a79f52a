"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet to the shared folder
and read again as the next stage's documents, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm.decontaminate import contaminated, find_contamination, n_hit
from sessionloom.llm.line_dedup import dedup_lines
from sessionloom.llm.packing import pack_documents
from sessionloom.llm.quality import graded, score_quality, selected
from sessionloom.llm.queries import table, tokenizer_path
from sessionloom.llm.simhash import keep_one
from sessionloom.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose best grade is less likely than all others together."""
    scored = score_quality(docs, graded(table(spark, sf_dir, "labels")))
    return scored.filter(selected(F.col("tail"))).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove line chunks that occur earlier; documents without any line left stay, empty."""
    found = dedup_lines(docs)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of texts whose SimHash of 4-word shingles is linked by 4 bits at most."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that a benchmark item contaminates."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(~contaminated(F.col("n_words"), n_hit(F.col("spans")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and places in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]
# The classifier's fit, hashes and the tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
