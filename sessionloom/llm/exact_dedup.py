"""Exact dedup by a tree merge of sorted digest runs.

Texts are equal if they are identical once ASCII white space is deleted. A row's digest is a 64-bit hash
of what is left; each run of up to `RUN_ROWS` rows of a scan task is sorted by digest and holds each text
once, with the best row for it and a count. Runs are merged in binomial rounds: in each round the runs
whose numbers differ in their lowest `FAN_BITS` bits alone are merged into the one with these bits zero, so
2 ** FAN_BITS sorted runs at a time, until one number is left. Entries are one text if not only their digests
but also their SHA-256 and byte lengths agree; the best row and the count of each are kept at every level.
A round deals out a run's entries by digest, so no task ever holds a whole run of a later level, and a text
that a third of all rows share is one entry per run when it first moves.

Verdicts go the way back: the last level's to the first runs' entries, and from these, by run and digest,
to the rows. So the rows of a large group stay spread over the runs they came from. Texts never move.
All of it is DataFrame expressions.

Which row stays: the one with the most code points in the original text, then the smallest id, ids that are
null last, then the first in the scan, so of repeated rows one stays. Defined cases: a null text is empty;
empty and blank texts are equal to each other. Very long texts are hashed like any others. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.session import stable

#: Rows of one scan task that make one run at most.
RUN_ROWS = 1 << 16
#: Runs merged at a time: two to this power.
FAN_BITS = 4
#: Bits of a row number that count inside a scan task; the rest is the task's number.
TASK_SHIFT = 33
# Blank, tab to carriage return.
SPACE = [chr(32), *map(chr, range(9, 14))]
TEXT = ["digest", "sha", "n_bytes"]


def normalised(text: Column) -> Column:
    """The text without ASCII white space; empty for null."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    for c in SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def merge_runs(runs: DataFrame) -> DataFrame:
    """Entries with equal run numbers and texts made one."""
    return runs.groupBy("run", *TEXT).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def first_runs(marks: DataFrame) -> DataFrame:
    """(run, digest, sha, n_bytes, best, n): each run's texts once; the least `best` is the row that stays."""
    best = F.struct((-F.col("n_points")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "row")
    return merge_runs(marks.select("run", *TEXT, best.alias("best"), F.lit(1).cast("long").alias("n")))


def tree_merge(runs: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """(digest, sha, n_bytes, best, n) of every text, merged over all runs round by round."""
    # The parts of one scan task come together first; from then on a run's number is its task's.
    merged = merge_runs(runs.withColumn("run", F.col("run").getField("task")))
    last = runs.agg(F.max(F.col("run").getField("task"))).first()[0] or 0
    for _ in range(-(-last.bit_length() // fan_bits)):
        merged = merge_runs(merged.withColumn("run", F.shiftright("run", fan_bits)))
    return merged.drop("run")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    run_rows: int = RUN_ROWS, fan_bits: int = FAN_BITS,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row."""
    row = F.monotonically_increasing_id()
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), row.alias("row"), F.length(F.coalesce(text_col, F.lit(""))).alias("n_points"),
        normalised(F.col(text_col)).alias("text"),
    )
    task = F.shiftright("row", TASK_SHIFT)
    part = F.floor((F.col("row") - F.shiftleft(task, TASK_SHIFT)) / run_rows)
    marks = stable(
        rows.select(
            "id", "row", F.struct(task.alias("task"), part.alias("part")).alias("run"), F.xxhash64("text").alias("digest"),
            F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("n_bytes"), "n_points",
        )
    )
    runs = first_runs(marks)
    settled = tree_merge(runs, fan_bits).select(*TEXT, F.col("best").alias("stays"), F.col("n").alias("group_size"))
    entries = runs.select("run", *TEXT).join(settled.hint("merge"), TEXT)
    verdicts = entries.select("run", *TEXT, F.col("stays.id").alias("keep_id"), F.col("stays.row").alias("keep_row"), "group_size")
    return marks.join(verdicts.hint("merge"), ["run", *TEXT]).select(
        "id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
