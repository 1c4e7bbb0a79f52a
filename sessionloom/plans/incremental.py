"""Normalised tables that grow batch by batch, with surrogate keys that stay.

Each batch of raw rows becomes a partition `batch=N` of every table, and all tables take it in together in one switch
(`versions`). A batch that is run again after a failure replaces its own partition, so it counts once. Sessions whose
`uid` is stored already, or came earlier in the same batch, add nothing, wherever and however often they are delivered.
Captures arrive in any order of their times, so this is settled against the stored keys and not by a watermark,
which would drop late captures.

New names of services and labels get keys after the largest there is, in name order; keys given before never change.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom import schemas as S
from sessionloom.operators import normalize as N
from sessionloom.operators.joins import local_copy, small_rows
from sessionloom.operators.quality import keep_first
from sessionloom.plans import versions as V
from sessionloom.session import open_files, scratch_path
from sessionloom.sources.tables import with_row_id

BATCH = "batch"
#: Tables of a batch that are written at a time.
WRITES = 6
#: Dimension: the raw column its names come from, its key and its name column.
DIMENSIONS = {"service": ("service", "svc_id", "svc_name"), "label": ("detailed_label", "label_id", "label_name")}


def new_sessions(raw: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The rows whose `uid` is not stored yet, one per `uid` (the earliest by capture and time)."""
    first = keep_first(raw.filter(F.col("uid").isNotNull()), ["uid"], ["source_file", "ts"])
    if stored is None:
        return first
    # Of the stored keys only those of this batch matter. While the batch is small they are found by a scan alone. A
    # large batch is not read again for its keys: it meets the stored ones where its own rows are gathered by key.
    small, known = local_copy(raw.select("uid")), stored.select("uid")
    if small is None:
        known = known.hint("merge")
    else:
        known = known.join(F.broadcast(small), "uid", "left_semi")
    return first.join(known, "uid", "left_anti").select(raw.columns)


def extended_dimension(names: DataFrame, stored: DataFrame | None, key: str, name: str) -> DataFrame:
    """Keys for the names that are not stored yet, after the largest stored key, in name order."""
    last = 0
    if stored is not None:
        names = names.join(stored.select(name), name, "left_anti")
        last = stored.agg(F.max(key)).first()[0] or 0
    few = small_rows(names)
    if few is None:
        return with_row_id(names, [name], "_id").select((F.col("_id") + last).alias(key), name)
    numbered = [(last + i, n) for i, n in enumerate(sorted(r[name] for r in few), start=1)]
    return names.sparkSession.createDataFrame(numbered, f"{key} long, {name} string")


def add_batch(raw: DataFrame, number: int, out_dir: str, legend: str = "literal", label_on: str = "detailed_label") -> None:
    """Take the new sessions of `raw` into the tables below `out_dir`, as batch `number`."""
    spark, before = raw.sparkSession, V.current(raw.sparkSession, out_dir)
    folder = f"{BATCH}={number}"

    def held(table: str) -> DataFrame | None:
        """A table's rows of all batches but this one."""
        found = before.tables.get(table)
        if found is None:
            return None
        others = {f: v for f, v in found.folders.items() if f != folder}
        rows = V.read_stored(spark, out_dir, V.Stored(found.schema, found.partition_by, others), table)
        return rows.drop(BATCH)

    # Written once by columns, of which each table reads its own.
    place = scratch_path(spark, "fresh")
    new_sessions(raw, held("session")).write.parquet(place)
    fresh = spark.read.schema(raw.schema).parquet(place)
    new, whole = {}, {}
    for table, (column, key, name) in DIMENSIONS.items():
        names = fresh.filter(F.col(column).isNotNull()).select(F.col(column).alias(name)).distinct()
        new[table] = extended_dimension(names, held(table), key, name)
        old = held(table)
        whole[table] = new[table] if old is None else old.unionByName(new[table])
    codes = N.history_legend(spark, legend)
    tables = {"session": N.build_session(fresh), **new}
    tables |= {name: N.build_satellite(fresh, column) for name, column in S.SATELLITES.items()}
    tables |= {
        "session_service": N.build_session_service(fresh, whole["service"]),
        "session_label": N.build_session_label(fresh, whole["label"], label_on),
        "tunnel_parent": N.build_tunnel_parent(fresh),
        "session_history": N.build_session_history(fresh, codes),
    }
    version, written = before.new_version(), {}

    def write(name: str) -> V.Stored:
        rows = tables[name].withColumn(BATCH, F.lit(number).cast("long"))
        return V.write_version(rows, out_dir, version, name, [BATCH])

    # Small writes, each with a start and an end in which no task runs: some are under way at a time.
    with open_files(spark), ThreadPoolExecutor(WRITES) as pool:
        stored_by_name = dict(zip(tables, pool.map(write, tables)))
    for name, stored in stored_by_name.items():
        old = before.tables.get(name)
        kept = {f: v for f, v in old.folders.items() if f != folder} if old else {}
        written[name] = (V.Stored(stored.schema, [BATCH], kept | stored.folders), old)
    shared = V.write_version(codes, out_dir, version, "history_legend")
    written["history_legend"] = (shared, before.tables.get("history_legend"))
    V.replace_tables(spark, out_dir, written, before)
    V.delete(spark, place)


def stream_tables(raw: DataFrame, out_dir: str, checkpoint: str, **options) -> None:
    """Take in the batches of a stream of raw rows that are new since the last run, then stop."""
    query = (
        raw.writeStream.foreachBatch(partial(_take, out_dir=out_dir, options=options))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _take(batch: DataFrame, number: int, out_dir: str, options: dict) -> None:
    add_batch(batch, number, out_dir, **options)


def open_grown(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The tables in force, without their batch numbers."""
    found = V.current(spark, out_dir).tables
    return {name: V.read_stored(spark, out_dir, t, name).drop(BATCH) for name, t in found.items()}
