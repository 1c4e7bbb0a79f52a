"""Queries and oracle SQL: log ingest, tables in and out, profiling, normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom import fixtures as X
from sessionloom import schemas as S
from sessionloom.checks import oracle_base as O
from sessionloom.operators import normalize as N
from sessionloom.operators import quality as Q
from sessionloom.plans import incremental as I
from sessionloom.plans import warehouse as W
from sessionloom.session import scratch_path
from sessionloom.sources import checked_load as C
from sessionloom.sources import conn_log as L
from sessionloom.sources import tables as T
from sessionloom.streaming.ingest import stream_ingest, stream_lines

PLAIN = O.plain(S.LOG_FIELDS)
CONN_SELECT = "SELECT * FROM conn"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return X.conn_lines(X.read_table(spark, d, "events"))


def _plain(df: DataFrame) -> DataFrame:
    """Dots and hyphens of the log's own names as underscores."""
    return df.select([F.col(f"`{c}`").alias(p) for c, p in zip(df.columns, O.plain(df.columns))])


def _stored(df: DataFrame, name: str, **options) -> str:
    path = scratch_path(df.sparkSession, name)
    T.write_parquet(df, path, **options)
    return path


def _parsed(spark, d):
    return L.parse_conn_log(_lines(spark, d))


def _raw_from_log(spark, d):
    return L.raw_from_lines(_lines(spark, d))


def io_parse_conn_log(spark, d):
    return _plain(_parsed(spark, d).drop("source_file"))


def io_repair_labels(spark, d):
    """Field count of every line before and after the repair, and the three label cells."""
    lines = L.data_lines(_lines(spark, d)).drop("source_file")
    fields = F.split("value", "\t", -1)
    return (
        lines.select(fields.alias("f"), L.repair_labels(fields).alias("r"))
        .select(
            F.get("r", 1).alias("uid"),
            F.size("f").alias("n_before"),
            F.size("r").alias("n_after"),
            F.get("r", 20).alias("tunnel_parents"),
            F.get("r", 21).alias("label"),
            F.get("r", 22).alias("detailed_label"),
        )
    )


def io_null_tokens(spark, d):
    return _plain(L.null_tokens(_parsed(spark, d).drop("source_file")))


def _float_as_text(df: DataFrame) -> DataFrame:
    """Single-precision durations at the log's two digits, so that both engines compare them."""
    return df.withColumn("duration", F.round(F.col("duration").cast("double"), 2))


def io_typed_raw(spark, d):
    return _float_as_text(_raw_from_log(spark, d))


def _log_files(lines: DataFrame) -> str:
    """The lines as text files that are named as their captures; a glob that matches them."""
    return X.one_file_per_capture(lines, scratch_path(lines.sparkSession, "logs"), "text")


def io_source_tag(spark, d):
    """Every row's capture is the name of the file it was read from."""
    return L.read_conn_logs(spark, _log_files(_lines(spark, d))).select("uid", "source_file")


def io_load_dir(spark, d):
    """CSV files, several to a capture, loaded as one relation with their files' names."""
    cells = L.null_tokens(_parsed(spark, d))
    files = X.one_file_per_capture(cells, scratch_path(spark, "csv"), "csv", header=True, escape='"')
    return _float_as_text(T.load_dir(spark, files))


def io_csv_roundtrip(spark, d):
    path = scratch_path(spark, "csv")
    raw = X.conn(spark, d)
    T.write_csv(raw, path)
    return T.read_csv(spark, path, raw.schema)


def io_row_id(spark, d):
    return T.with_row_id(X.conn(spark, d), ["ts", "uid"]).select("id", "uid", "ts")


def io_read_relation(spark, d):
    X.conn(spark, d).createOrReplaceTempView("connection_log")
    return T.read_relation(spark, "connection_log")


def io_parquet_roundtrip(spark, d):
    return T.read_relation(spark, _stored(X.conn(spark, d), "parquet"))


def io_union_captures(spark, d):
    """Three captures stored apart and stacked; the second lacks a column."""
    raw = X.conn(spark, d)
    paths = []
    for i in (1, 2, 3):
        part = raw.filter(F.col("source_file") == f"capture_{i}.csv")
        paths.append(_stored(part.drop("service") if i == 2 else part, f"capture{i}"))
    return T.read_captures(spark, paths)


def io_preview(spark, d):
    raw = X.conn(spark, d)
    size = T.shape(raw).first()
    return T.preview(raw, ["ts", "uid"], 10).select(
        "uid", "ts", F.lit(size["n_rows"]).cast("bigint").alias("n_rows"), F.lit(size["n_columns"]).alias("n_columns")
    )


def io_stream_ingest(spark, d):
    """The log as files named as their captures, ingested by the stream."""
    base = scratch_path(spark, "stream")
    files = _log_files(_lines(spark, d).repartition(4))
    stream_ingest(spark, files, f"{base}/out", f"{base}/checkpoint", max_files=2)
    return _float_as_text(spark.read.parquet(f"{base}/out"))


def _checked(spark, d) -> str:
    path = scratch_path(spark, "checked")
    C.load_checked(X.broken_lines(T.dealt(X.read_table(spark, d, "events"), "event_id")), path)
    return path


def io_parse_report(spark, d):
    """Per file: lines, short and long ones, and cells that do not fit their column."""
    return C.parse_report(spark, _checked(spark, d))


def io_parse_report_stream(spark, d):
    """The same report of lines that came in by the file stream, two files at a time."""
    base = scratch_path(spark, "stream")
    files = _log_files(X.broken_lines(X.read_table(spark, d, "events")).repartition(3))
    C.stream_checked(stream_lines(spark, files, 2), f"{base}/out", f"{base}/checkpoint")
    return C.parse_report(spark, f"{base}/out")


def io_rejected_lines(spark, d):
    """The malformed lines themselves, with what is wrong with them."""
    bad = C.rejected_lines(spark, _checked(spark, d))
    return bad.select(
        "source_file", "n_fields", F.array_join("misfits", ",").alias("misfits"),
        F.get(F.split("line", "\t", -1), 1).alias("uid"), F.size(F.split("line", "\t", -1)).alias("n_written"),
    )


def io_load_checked(spark, d):
    """What a checked load of broken lines leaves: every line's row, misfits and missing fields null."""
    return _float_as_text(C.loaded_rows(spark, _checked(spark, d)))


def q_missing_report(spark, d):
    return Q.missing_report(X.conn(spark, d))


def q_drop_sparse(spark, d):
    return Q.drop_sparse_columns(X.conn(spark, d), 0.3)


def q_fill_zero(spark, d):
    return Q.fill_zero(X.conn(spark, d))


def q_numeric_only(spark, d):
    return Q.numeric_only(X.conn(spark, d))


def q_class_counts(spark, d):
    return Q.class_counts(X.conn(spark, d), "label")


def q_distinct_values(spark, d):
    return Q.distinct_values(X.conn(spark, d), "detailed_label")


def q_render_rows(spark, d):
    return Q.render_rows(_plain(L.null_tokens(_parsed(spark, d).drop("source_file"))))


def q_pk_violations(spark, d):
    return Q.pk_violations(X.conn(spark, d), ["id_orig_h", "id_resp_h"])


#: Child table and column, parent table and column. All keys of the normalised tables, and two pairs
#: of given tables, the first of which has orphans.
FOREIGN_KEYS = [
    *[(t, "uid", "session", "uid") for t in S.SATELLITES],
    ("session_service", "uid", "session", "uid"), ("session_service", "svc_id", "service", "svc_id"),
    ("session_label", "uid", "session", "uid"), ("session_label", "label_id", "label", "label_id"),
    ("tunnel_parent", "child_uid", "session", "uid"), ("tunnel_parent", "parent_uid", "session", "uid"),
    ("session_history", "uid", "session", "uid"), ("session_history", "history_id", "history_legend", "id"),
    ("documents", "doc_id", "labels", "doc_id"), ("labels", "doc_id", "documents", "doc_id"),
]


def q_fk_violations(spark, d):
    """Every foreign key: the values without a parent row, and how many child rows hold each."""
    # Written once in even parts, which the tasks of every key read their columns of.
    raw = spark.read.parquet(_stored(T.dealt(X.conn(spark, d), "uid"), "sessions"))
    tables = N.build_tables(raw) | {n: X.read_table(spark, d, n) for n in ("documents", "labels")}
    found = [
        Q.fk_violations(tables[child], tables[parent], key, parent_key).select(
            F.lit(child).alias("child"), F.lit(key).alias("key"), F.col(key).cast("string").alias("value"), "n"
        )
        for child, key, parent, parent_key in FOREIGN_KEYS
    ]
    return reduce(DataFrame.unionByName, found)


def q_drop_if_present(spark, d):
    return Q.drop_if_present(X.conn(spark, d), S.ID_COLUMNS + ["label", "history"])



def n_service_dim(spark, d):
    return N.build_service(X.conn(spark, d))


def n_label_dim(spark, d):
    return N.build_label(X.conn(spark, d))


def n_history_legend(spark, d):
    """The legend with how many history entries of the log carry each code."""
    raw, legend = X.conn(spark, d), N.history_legend(spark)
    used = N.build_session_history(raw, legend).groupBy("history_id").agg(F.count("*").alias("n"))
    return legend.join(used, legend.id == used.history_id, "left").select(
        "id", "code", "description", F.coalesce("n", F.lit(0)).alias("n_sessions_codes")
    )


def n_session(spark, d):
    return N.build_session(X.conn(spark, d))


def _satellite(col):
    return lambda spark, d: N.build_satellite(X.conn(spark, d), col)


def n_session_service(spark, d):
    raw = X.conn(spark, d)
    return N.build_session_service(raw, N.build_service(raw))


def n_session_label(spark, d):
    raw = X.conn(spark, d)
    return N.build_session_label(raw, N.build_label(raw))


def n_session_label_literal(spark, d):
    """Joined on the simple label: matches only where it equals a detailed name."""
    raw = X.conn(spark, d)
    return N.build_session_label(raw, N.build_label(raw), on="label")


def n_tunnel_parent(spark, d):
    return N.build_tunnel_parent(X.conn(spark, d))


def n_session_history(spark, d):
    return N.build_session_history(X.conn(spark, d), N.history_legend(spark))


def n_rebuild_counts(spark, d):
    return N.table_counts(W.rebuild(X.conn(spark, d), scratch_path(spark, "tables")))


def n_incremental(spark, d):
    """Sessions with their service and label by name, from tables grown by a stream, a file at a time; every
    file of the first capture is delivered twice."""
    base = scratch_path(spark, "grown")
    lines = _lines(spark, d)
    X.one_file_per_capture(lines, f"{base}/first", "text")
    for delivered in ("first", "*"):
        if delivered == "*":
            X.one_file_per_capture(lines.filter("source_file = 'capture_1.csv'"), f"{base}/again", "text")
        raw = L.raw_from_lines(stream_lines(spark, f"{base}/{delivered}/files/*", 1))
        I.stream_tables(raw, f"{base}/tables", f"{base}/checkpoint")
    return _named_sessions(I.open_grown(spark, f"{base}/tables"))


def _named_sessions(t: dict[str, DataFrame]) -> DataFrame:
    services = t["session_service"].join(t["service"], "svc_id").select("uid", "svc_name")
    labels = t["session_label"].join(t["label"], "label_id").select("uid", "label_name")
    codes = t["session_history"].groupBy("uid").agg(F.count("*").alias("n_codes"))
    return (
        t["session"].select("uid", "source_file").join(services, "uid", "left").join(labels, "uid", "left")
        .join(codes, "uid", "left").withColumn("n_codes", F.coalesce("n_codes", F.lit(0)))
    )


QUERIES = {
    f.__name__: f
    for f in [
        io_parse_conn_log, io_repair_labels, io_null_tokens, io_typed_raw, io_source_tag,
        io_load_dir, io_row_id, io_csv_roundtrip, io_read_relation, io_parquet_roundtrip,
        io_union_captures, io_preview, io_stream_ingest, io_parse_report, io_parse_report_stream,
        io_rejected_lines, io_load_checked, q_missing_report, q_drop_sparse,
        q_fill_zero, q_numeric_only, q_class_counts, q_distinct_values, q_render_rows,
        q_pk_violations, q_fk_violations, q_drop_if_present, n_service_dim, n_label_dim,
        n_history_legend, n_session, n_session_service, n_session_label,
        n_session_label_literal, n_tunnel_parent, n_session_history, n_rebuild_counts,
        n_incremental,
    ]
}
QUERIES |= {f"n_sat_{c}": _satellite(c) for c in S.SATELLITES.values()}

_NUMERIC = [c for c, t in S.RAW_TYPES.items() if t.typeName() in ("double", "float", "integer")]


def _typed_conn(drop_source: bool) -> str:
    columns = [c for c in O.CONN_COLUMNS if not (drop_source and c == "source_file")]
    out = ["round(duration, 2) AS duration" if c == "duration" else c for c in columns]
    return O.with_conn(f"SELECT {', '.join(out)} FROM conn")


def _filled(c: str) -> str:
    return f"coalesce({c}, 0) AS {c}" if c in _NUMERIC else c


def _hit(divisor: int, rest: int) -> str:
    return f"event_id % {divisor} = {rest}"


# The faults of `broken_lines` by arithmetic on the event number, not by looking at any line.
_FAULTS = {
    c: _hit(divisor, rest) + (f" AND NOT {_hit(*X.CUT)}" if S.RAW_COLUMNS.index(c) >= X.CUT_FIELDS else "")
    for c, divisor, rest, _ in X.BROKEN_CELLS
}
_IN_ORDER = sorted(_FAULTS, key=S.RAW_COLUMNS.index)
_BROKEN = f"""broken AS (
  SELECT *, CAST(CASE WHEN {_hit(*X.CUT)} THEN {X.CUT_FIELDS} WHEN {_hit(*X.SURPLUS)} THEN 25 ELSE 23 END AS INTEGER) AS n_fields,
    concat_ws(',', {", ".join(f"CASE WHEN {_FAULTS[c]} THEN '{c}' END" for c in _IN_ORDER)}) AS misfits
  FROM conn_n)"""
_REPORT = O.with_conn("\nUNION ALL ".join(
    f"SELECT source_file, '{problem}' AS problem, {column} AS column_name, count(*) AS n FROM broken WHERE {where} GROUP BY 1"
    for problem, column, where in [
        ("all", "CAST(NULL AS VARCHAR)", "true"), ("short", "NULL", "n_fields < 23"), ("long", "NULL", "n_fields > 23"),
        *[("misfit", f"'{c}'", _FAULTS[c]) for c in _IN_ORDER],
    ]
), _BROKEN)


def _broken_cell(c: str) -> str:
    """A column of the raw relation, null where the line was cut or its cell does not fit."""
    lost = [f"({_FAULTS[c]})"] if c in _FAULTS else []
    if c in S.RAW_COLUMNS and S.RAW_COLUMNS.index(c) >= X.CUT_FIELDS:
        lost.append(f"({_hit(*X.CUT)})")
    value = "round(duration, 2)" if c == "duration" else c
    return f"CASE WHEN NOT ({' OR '.join(lost)}) THEN {value} END AS {c}" if lost else f"{value} AS {c}"


_HIGH_NULL = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM conn"
    for c in O.CONN_COLUMNS
)
# tunnel_parents, detailed_label and the two local flags are null in more than 0.3 of the rows.
_SPARSE = ["local_orig", "local_resp", "tunnel_parents", "detailed_label"]

# The legend's name in the SQL. The satellites are selections of the sessions there.
_SQL_NAMES = {"history_legend": "legend"}

ORACLE = {
    "io_parse_conn_log": O.with_conn(f"SELECT {O.conn_cells()} FROM conn_n"),
    "io_repair_labels": O.with_conn(
        "SELECT uid, CAST(CASE WHEN event_id % 10 = 0 THEN 23 ELSE 21 END AS INTEGER) AS n_before,"
        " CAST(23 AS INTEGER) AS n_after, coalesce(tunnel_parents, '-') AS tunnel_parents, label,"
        " coalesce(detailed_label, '-') AS detailed_label FROM conn_n"
    ),
    "io_null_tokens": O.with_conn(f"SELECT {O.conn_cells(null=None)} FROM conn_n"),
    "io_typed_raw": _typed_conn(False),
    "io_source_tag": O.with_conn("SELECT uid, source_file FROM conn"),
    "io_load_dir": _typed_conn(False),
    "io_row_id": O.with_conn(
        "SELECT row_number() OVER (ORDER BY ts, uid) AS id, uid, ts FROM conn"
    ),
    "io_csv_roundtrip": O.with_conn(CONN_SELECT),
    "io_read_relation": O.with_conn(CONN_SELECT),
    "io_parquet_roundtrip": O.with_conn(CONN_SELECT),
    "io_union_captures": O.with_conn(
        "SELECT * REPLACE (CASE WHEN source_file <> 'capture_2.csv' THEN service END AS service)"
        " FROM conn"
    ),
    "io_preview": O.with_conn(
        "SELECT uid, ts, (SELECT count(*) FROM conn) AS n_rows,"
        f" CAST({len(O.CONN_COLUMNS)} AS INTEGER) AS n_columns FROM conn ORDER BY ts, uid LIMIT 10"
    ),
    "io_stream_ingest": _typed_conn(False),
    "io_parse_report": _REPORT,
    "io_parse_report_stream": _REPORT,
    "io_rejected_lines": O.with_conn(
        "SELECT source_file, n_fields, misfits, uid, n_fields AS n_written FROM broken"
        " WHERE n_fields <> 23 OR misfits <> ''", _BROKEN,
    ),
    "io_load_checked": O.with_conn(f"SELECT {', '.join(map(_broken_cell, O.CONN_COLUMNS))} FROM broken", _BROKEN),
    "q_missing_report": O.with_conn(f"SELECT * FROM ({_HIGH_NULL}) WHERE n_missing > 0"),
    "q_drop_sparse": O.with_conn(f"SELECT * EXCLUDE ({', '.join(_SPARSE)}) FROM conn"),
    "q_fill_zero": O.with_conn(f"SELECT {', '.join(_filled(c) for c in O.CONN_COLUMNS)} FROM conn"),
    "q_numeric_only": O.with_conn(f"SELECT {', '.join(_NUMERIC)} FROM conn"),
    "q_class_counts": O.with_conn(
        "SELECT label, count(*) AS n FROM conn GROUP BY label ORDER BY n DESC, label"
    ),
    "q_distinct_values": O.with_conn("SELECT DISTINCT detailed_label FROM conn"),
    "q_render_rows": O.with_conn(
        "SELECT concat_ws(', ', "
        + ", ".join(f"'{n}=' || coalesce({O.cell(c)}, 'nan')" for n, c in zip(PLAIN, S.RAW_COLUMNS))
        + ") AS line FROM conn_n"
    ),
    "q_pk_violations": O.with_conn(
        "SELECT id_orig_h, id_resp_h, count(*) AS n FROM conn GROUP BY ALL"
        " HAVING count(*) > 1 OR id_orig_h IS NULL OR id_resp_h IS NULL"
    ),
    "q_fk_violations": O.with_tables(" UNION ALL ".join(
        f"SELECT '{child}' AS child, '{key}' AS key, CAST({key} AS VARCHAR) AS value, count(*) AS n FROM"
        f" {_SQL_NAMES.get(child, child)} WHERE {key} IS NOT NULL AND {key} NOT IN"
        f" (SELECT {parent_key} FROM {_SQL_NAMES.get(parent, parent)}) GROUP BY 3"
        for child, key, parent, parent_key in FOREIGN_KEYS if child not in S.SATELLITES
    )),
    "q_drop_if_present": O.with_conn("SELECT * EXCLUDE (uid, label, history) FROM conn"),
    "n_service_dim": O.with_tables("SELECT * FROM service"),
    "n_label_dim": O.with_tables("SELECT * FROM label"),
    "n_history_legend": O.with_tables(
        "SELECT CAST(id AS BIGINT) AS id, code, description, count(history_id) AS n_sessions_codes"
        " FROM legend LEFT JOIN session_history ON id = history_id GROUP BY ALL"
    ),
    "n_session": O.with_tables("SELECT * FROM session"),
    "n_session_service": O.with_tables("SELECT * FROM session_service"),
    "n_session_label": O.with_tables("SELECT * FROM session_label"),
    "n_session_label_literal": O.with_tables(
        "SELECT uid, label_id FROM conn JOIN label ON conn.label = label_name"
    ),
    "n_tunnel_parent": O.with_tables("SELECT * FROM tunnel_parent"),
    "n_session_history": O.with_tables("SELECT * FROM session_history"),
    "n_incremental": O.with_tables(
        "SELECT c.uid, c.source_file, c.service AS svc_name, c.detailed_label AS label_name,"
        " count(h.history_id) AS n_codes FROM conn c LEFT JOIN session_history h ON c.uid = h.uid GROUP BY ALL"
    ),
    "n_rebuild_counts": O.with_tables(
        "\nUNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS n FROM {src}"
            for t, src in [
                ("session", "session"),
                *[(t, f"conn WHERE {c} IS NOT NULL") for t, c in S.SATELLITES.items()],
                ("service", "service"), ("session_service", "session_service"),
                ("label", "label"), ("session_label", "session_label"),
                ("tunnel_parent", "tunnel_parent"), ("history_legend", "legend"),
                ("session_history", "session_history"),
            ]
        )
    ),
}
ORACLE |= {
    f"n_sat_{c}": O.with_conn(f"SELECT uid, {c} FROM conn WHERE {c} IS NOT NULL")
    for c in S.SATELLITES.values()
}
