"""Queries and oracle SQL: feature expressions and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom import fixtures as X
from sessionloom import schemas as S
from sessionloom.checks import oracle_base as O
from sessionloom.functions import encoding as E
from sessionloom.operators import features as V
from sessionloom.operators import normalize as N
from sessionloom.plans import warehouse as W
from sessionloom.session import scratch_path
from sessionloom.sources.tables import dealt

CAPTURE = "capture_1.csv"


def _tables(spark, d) -> dict[str, DataFrame]:
    return N.build_tables(X.conn(spark, d))


def _joined_codes(df: DataFrame) -> DataFrame:
    return df.withColumn("history_codes", F.array_join("history_codes", ","))


def f_filter_capture(spark, d):
    return V.filter_capture(X.conn(spark, d), CAPTURE)


def f_history_array(spark, d):
    raw, legend = X.conn(spark, d), N.history_legend(spark)
    return _joined_codes(V.history_array(N.build_session_history(raw, legend), legend))


def f_label_string(spark, d):
    raw = X.conn(spark, d)
    label = N.build_label(raw)
    return V.label_string(N.build_session_label(raw, label), label)


def f_time_of_day(spark, d):
    return X.conn(spark, d).select("uid", E.time_of_day(F.col("ts")))


def f_orig_port(spark, d):
    return X.conn(spark, d).select("uid", *E.orig_port_flags(F.col("id_orig_p")))


def f_resp_port_train(spark, d):
    return X.conn(spark, d).select("uid", *E.resp_port_flags("id_resp_p", S.TRAINING_PORTS))


def f_resp_port_iot(spark, d):
    return X.conn(spark, d).select("uid", *E.resp_port_flags("id_resp_p", S.IOT_PORTS))


def f_proto(spark, d):
    return X.conn(spark, d).select("uid", *E.one_hot("proto", S.PROTOCOLS, "proto"))


def f_conn_state(spark, d):
    return X.conn(spark, d).select("uid", *E.one_hot("conn_state", S.CONN_STATES, "conn"))


def f_impute_flag(spark, d):
    return V.impute_with_flag(X.conn(spark, d).select("uid", *S.IMPUTED), S.IMPUTED)


def f_service(spark, d):
    return X.conn(spark, d).select("uid", *E.one_hot("service", S.SERVICES, "svc"))


def f_history_one_hot(spark, d):
    raw, legend = X.conn(spark, d), N.history_legend(spark)
    codes = V.history_array(N.build_session_history(raw, legend), legend)
    return codes.select("uid", *E.history_flags())


def f_simple_label(spark, d):
    return V.encode_label(N.build_session(X.conn(spark, d))).select("uid", "simple_label_encoded")


def f_label_flags(spark, d):
    return X.conn(spark, d).select("uid", *E.attack_flags(F.col("detailed_label")))


def f_ipv4_to_int(spark, d):
    return X.conn(spark, d).select(
        "uid",
        E.ipv4_to_int(F.col("id_orig_h")).alias("id_orig_h_int"),
        E.ipv4_to_int(F.col("id_resp_h")).alias("id_resp_h_int"),
    )


def f_encode_addresses(spark, d):
    return V.encode_addresses(X.conn(spark, d))


def f_tunnel_parent(spark, d):
    raw = X.conn(spark, d)
    return V.with_tunnel_parent(N.build_session(raw), N.build_tunnel_parent(raw))


def f_training_view(spark, d):
    return V.training_view(_tables(spark, d), CAPTURE)


def f_session_full_view(spark, d):
    return _joined_codes(V.session_full_view(_tables(spark, d)))


def f_session_full_view_fused(spark, d):
    return _joined_codes(V.session_full_view_fused(X.conn(spark, d)))


def f_training_view_fused(spark, d):
    return V.training_view_fused(X.conn(spark, d), CAPTURE)


def f_materialize(spark, d):
    view = V.training_view_fused(dealt(X.conn(spark, d), "uid"), keep=["uid", "source_file"])
    path = scratch_path(spark, "view")
    W.materialize(view.limit(0), path)
    return W.materialize(view, path)


def f_refresh_captures(spark, d):
    """A stored view of which one capture was cut and one is missing, both refreshed; the third is left alone."""
    view = V.training_view_fused(dealt(X.conn(spark, d), "uid"), keep=["uid", "source_file"])
    path = scratch_path(spark, "view")
    stale = view.filter("source_file = 'capture_1.csv' OR source_file = 'capture_2.csv' AND proto_tcp = 1")
    W.materialize(stale, path)
    W.refresh_captures(view, path, ["capture_2.csv", "capture_3.csv"])
    return W.open_view(spark, path)


QUERIES = {
    f.__name__: f
    for f in [
        f_filter_capture, f_history_array, f_label_string, f_time_of_day, f_orig_port,
        f_resp_port_train, f_resp_port_iot, f_proto, f_conn_state, f_impute_flag, f_service,
        f_history_one_hot, f_simple_label, f_label_flags, f_ipv4_to_int, f_encode_addresses,
        f_tunnel_parent, f_training_view, f_session_full_view,
        f_session_full_view_fused, f_training_view_fused, f_materialize, f_refresh_captures,
    ]
}


def _per_uid(columns: list[str]) -> str:
    return O.with_conn("SELECT uid, " + ", ".join(columns) + " FROM conn")


_INTS = [f"{O.ipv4(c)} AS {c}_int" for c in ("id_orig_h", "id_resp_h")]

ORACLE = {
    "f_filter_capture": O.with_conn(f"SELECT * FROM conn WHERE source_file = '{CAPTURE}'"),
    "f_history_array": O.with_tables(
        "SELECT uid, array_to_string(history_codes, ',') AS history_codes FROM history_array"
    ),
    "f_label_string": O.with_tables("SELECT * FROM label_string"),
    "f_time_of_day": _per_uid([O.time_of_day()]),
    "f_orig_port": _per_uid(O.orig_port()),
    "f_resp_port_train": _per_uid(O.resp_port(S.TRAINING_PORTS)),
    "f_resp_port_iot": _per_uid(O.resp_port(S.IOT_PORTS)),
    "f_proto": _per_uid(O.one_hot("proto", S.PROTOCOLS, "proto")),
    "f_conn_state": _per_uid(O.one_hot("conn_state", S.CONN_STATES, "conn")),
    "f_impute_flag": _per_uid(O.imputed()),
    "f_service": _per_uid(O.one_hot("service", S.SERVICES, "svc")),
    "f_history_one_hot": O.with_tables(
        "SELECT uid, " + ", ".join(O.history()) + " FROM history_array"
    ),
    "f_simple_label": O.with_tables(f"SELECT uid, {O.malicious()} FROM session"),
    "f_label_flags": _per_uid(O.attacks()),
    "f_ipv4_to_int": _per_uid(_INTS),
    "f_encode_addresses": O.with_conn(
        "SELECT * EXCLUDE (id_orig_h, id_resp_h), "
        + ", ".join(i.replace("_int", "_enc") for i in _INTS) + " FROM conn"
    ),
    "f_tunnel_parent": O.with_tables(
        "SELECT s.*, parent_uid FROM session s LEFT JOIN tunnel_parent ON uid = child_uid"
    ),
    "f_training_view": O.with_tables(O.training_view(CAPTURE)),
    "f_session_full_view": O.with_tables(O.session_full_view()),
    "f_session_full_view_fused": O.with_tables(O.session_full_view()),
    "f_training_view_fused": O.with_tables(O.training_view(CAPTURE)),
    "f_materialize": O.with_tables(O.training_view(None, ["s.uid", "s.source_file"])),
    "f_refresh_captures": O.with_tables(O.training_view(None, ["s.uid", "s.source_file"])),
}
