"""Wide labelled feature views over the normalised tables, and their join-free form."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom import schemas as S
from sessionloom.functions import encoding as E
from sessionloom.operators.joins import lookup_join


def filter_capture(df: DataFrame, capture: str | None) -> DataFrame:
    """The rows of one capture; prunes to its folder if the table is partitioned by capture."""
    return df if capture is None else df.filter(F.col("source_file") == capture)


def history_array(session_history: DataFrame, legend: DataFrame) -> DataFrame:
    """Per session, its legend codes in index order. A group is one connection's history."""
    codes = lookup_join(
        session_history, legend.select(F.col("id").alias("history_id"), "code"), "history_id"
    )
    ordered = F.sort_array(F.collect_list(F.struct("index", "code")))
    return codes.groupBy("uid").agg(ordered.getField("code").alias("history_codes"))


def label_string(session_label: DataFrame, label: DataFrame) -> DataFrame:
    """Per session, its label names in name order, joined by `-`."""
    names = lookup_join(session_label, label, "label_id")
    joined = F.array_join(F.sort_array(F.collect_list("label_name")), "-")
    return names.groupBy("uid").agg(joined.alias("detailed_label"))


def impute_with_flag(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Each column with null as 0, followed by its `*_missing` indicator."""
    cols = list(cols)
    out: list[Column] = []
    for c in df.columns:
        out += E.impute_with_flag(c) if c in cols else [F.col(c)]
    return df.select(out)


def encode_label(df: DataFrame) -> DataFrame:
    return df.withColumn("simple_label_encoded", E.malicious_flag(F.col("simple_label")))


def encode_addresses(df: DataFrame) -> DataFrame:
    """The two addresses as integers in place of the dotted text."""
    return df.withColumns({
        "id_orig_h_enc": E.ipv4_to_int(F.col("id_orig_h")),
        "id_resp_h_enc": E.ipv4_to_int(F.col("id_resp_h")),
    }).drop("id_orig_h", "id_resp_h")


def with_tunnel_parent(df: DataFrame, tunnel_parent: DataFrame) -> DataFrame:
    """Attach each session's parent; a session with several parents gets a row for each."""
    edges = tunnel_parent.withColumnRenamed("child_uid", "uid")
    return df.join(edges, "uid", "left")


def _training_columns() -> list[Column]:
    """The training view over columns named as in the raw relation, plus `history_codes`,
    `svc_name` and `simple_label`."""
    return [
        E.time_of_day(F.col("ts")),
        *E.orig_port_flags(F.col("id_orig_p")),
        *E.resp_port_flags("id_resp_p", S.TRAINING_PORTS),
        *E.one_hot("proto", S.PROTOCOLS, "proto"),
        *E.one_hot("conn_state", S.CONN_STATES, "conn"),
        *[F.col(c) for c in S.VOLUME_COLUMNS],
        *[c for name in S.IMPUTED for c in E.impute_with_flag(name)],
        *E.one_hot("svc_name", S.SERVICES, "svc"),
        *E.history_flags(),
        E.malicious_flag(F.col("simple_label")).alias("simple_label_encoded"),
        *E.attack_flags(F.col("detailed_label")),
    ]


def _of_capture(table: DataFrame, capture: str | None) -> DataFrame:
    """A table's rows of the capture, if it says which those are: a partition filter on stored tables."""
    if "source_file" not in table.columns:
        return table
    return filter_capture(table, capture).drop("source_file")


def _of_sessions(table: DataFrame, session: DataFrame, capture: str | None) -> DataFrame:
    """The rows of the sessions asked for."""
    if capture is None or "source_file" in table.columns:
        return _of_capture(table, capture)
    return table.join(session.select("uid"), "uid", "left_semi")


def _with_satellites(session: DataFrame, tables: dict[str, DataFrame], capture: str | None) -> DataFrame:
    """Left joins on `uid`: one shuffle of the sessions serves all of them."""
    joined = session
    for name in ("session_duration", "session_orig_bytes", "session_resp_bytes"):
        joined = joined.join(_of_capture(tables[name], capture), "uid", "left")
    services = lookup_join(_of_capture(tables["session_service"], capture), tables["service"], "svc_id")
    return joined.join(services.select("uid", "svc_name"), "uid", "left")


def _histories(tables: dict[str, DataFrame], session: DataFrame, capture: str | None) -> DataFrame:
    """History arrays, gathered only for the sessions asked for."""
    rows = _of_sessions(tables["session_history"], session, capture)
    return history_array(rows, tables["history_legend"])


def training_view(
    tables: dict[str, DataFrame], capture: str | None = None, keep: Iterable[str] = ()
) -> DataFrame:
    """303 features and 9 labels per session of a capture, from the normalised tables."""
    session = filter_capture(tables["session"], capture)
    labels = _of_sessions(tables["session_label"], session, capture)
    wide = (
        _with_satellites(session, tables, capture)
        .join(_histories(tables, session, capture), "uid", "left")
        .join(label_string(labels, tables["label"]), "uid", "left")
    )
    return wide.select(*keep, *_training_columns())


def training_view_fused(
    raw: DataFrame,
    capture: str | None = None,
    keep: Iterable[str] = (),
    legend: str = "literal",
) -> DataFrame:
    """The training view straight from the raw relation: one projection, no shuffle.

    Equal to `training_view` whenever `uid` is a key of the raw relation, which is what the
    normalised tables require.
    """
    return _fused_inputs(filter_capture(raw, capture), legend).select(*keep, *_training_columns())


def _fused_inputs(raw: DataFrame, legend: str) -> DataFrame:
    return raw.withColumns({
        "svc_name": F.col("service"),
        "history_codes": E.history_codes(F.col("history"), legend),
        "simple_label": E.simple_label(F.col("label")),
    })


def compact_view(
    raw: DataFrame,
    capture: str | None = None,
    keep: Iterable[str] = ("uid", "source_file"),
    legend: str = "literal",
) -> DataFrame:
    """The training view with the 252 history flags as one array of the set flags' names.

    For fitting: a vocabulary stage turns the array into a sparse vector, which spares the
    wide projection.
    """
    rows = _fused_inputs(filter_capture(raw, capture), legend)
    flags = set(S.HISTORY_FEATURES)
    columns = [c for c, n in zip(_training_columns(), S.TRAINING_COLUMNS) if n not in flags]
    return rows.select(*keep, *columns, E.history_terms().alias("history_terms"))


def session_full_view(tables: dict[str, DataFrame], capture: str | None = None) -> DataFrame:
    """All session columns with their encodings, parent and history; 317 columns."""
    session = filter_capture(tables["session"], capture)
    wide = with_tunnel_parent(
        _with_satellites(session, tables, capture).join(
            _histories(tables, session, capture), "uid", "left"
        ),
        _of_capture(tables["tunnel_parent"], capture),
    )
    return wide.select(_session_columns())


def session_full_view_fused(
    raw: DataFrame, capture: str | None = None, legend: str = "literal"
) -> DataFrame:
    """The full session view straight from the raw relation, equal where `uid` is a key."""
    rows = _fused_inputs(filter_capture(raw, capture), legend)
    return rows.withColumn("parent_uid", F.col("tunnel_parents")).select(_session_columns())


def _session_columns() -> list[Column]:
    return [
        *[F.col(c) for c in S.SESSION_COLUMNS],
        E.ipv4_to_int(F.col("id_orig_h")).alias("id_orig_h_int"),
        E.ipv4_to_int(F.col("id_resp_h")).alias("id_resp_h_int"),
        E.time_of_day(F.col("ts")),
        *[c for name in S.IMPUTED for c in E.impute_with_flag(name)],
        F.col("svc_name"),
        *E.one_hot("svc_name", S.SERVICES, "svc"),
        F.col("parent_uid"),
        F.col("history_codes"),
        *E.history_flags(),
        *E.one_hot("conn_state", S.CONN_STATES, "conn"),
        *E.one_hot("proto", S.PROTOCOLS, "proto"),
        *E.orig_port_flags(F.col("id_orig_p")),
        *E.resp_port_flags("id_resp_p", S.IOT_PORTS),
        E.malicious_flag(F.col("simple_label")).alias("label"),
    ]
