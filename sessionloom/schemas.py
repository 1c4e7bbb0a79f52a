"""Schemas, vocabularies and the column-name lists generated from them."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. These have to agree with the log format, the code book and the
# column names existing users query by.
# ---------------------------------------------------------------------------

LOG_FIELDS = [
    "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service",
    "duration", "orig_bytes", "resp_bytes", "conn_state", "local_orig", "local_resp",
    "missed_bytes", "history", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
    "tunnel_parents", "label", "detailed-label",
]

NULL_TOKENS = ["-", "(empty)"]

# Tokens a CSV reader of the data-science stack reads as missing by default.
DEFAULT_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

HISTORY_LEGEND = [
    ("s", "SYN seen on originator side"),
    ("S", "SYN seen on responder side"),
    ("h", "connection established from originator"),
    ("H", "connection established from responder"),
    ("a", "ACK seen from originator"),
    ("A", "ACK seen from responder"),
    ("d", "data seen from originator"),
    ("D", "data seen from responder"),
    ("t", "retransmissions from originator"),
    ("T", "retransmissions from responder or truncated connection"),
    ("c", "connection completed from originator"),
    ("C", "connection completed from responder"),
    ("f", "FIN seen from originator"),
    ("F", "FIN seen from responder / connection attempt failed"),
    ("r", "RST seen from originator"),
    ("R", "RST seen from responder"),
    ("g", "content gap"),
    ("^", "connection originated here"),
    ("<", "connection reversed direction"),
]

# Codes with a feature column but no legend row; added by legend="full".
LEGEND_EXTRA = [
    ("w", "zero window from originator"),
    ("W", "zero window from responder"),
    ("G", "content gap from responder"),
    ("I", "inconsistent packet from responder"),
]

HISTORY_POSITIONS = 12

# (code, column suffix)
HISTORY_CODES = [
    ("S", "ss"), ("h", "h"), ("H", "hh"), ("a", "a"), ("A", "aa"), ("d", "d"), ("D", "dd"),
    ("t", "t"), ("T", "tt"), ("c", "c"), ("C", "cc"), ("f", "f"), ("F", "ff"), ("r", "r"),
    ("R", "rr"), ("g", "g"), ("^", "caret"), ("w", "w"), ("W", "ww"), ("G", "gg"), ("I", "ii"),
]

TRAINING_PORTS = [20, 21, 22, 23, 25, 53, 80, 110, 143, 443, 993, 3389, 8080]
IOT_PORTS = [22, 23, 80, 81, 443, 8080, 8081, 2323, 992, 37215, 52869]
WELL_KNOWN_MAX = 1023
REGISTERED_MAX = 49151

PROTOCOLS = ["icmp", "tcp", "udp"]
CONN_STATES = [
    "S0", "S1", "SF", "REJ", "S2", "S3", "RSTO", "RSTR", "RSTOS0", "RSTRH", "SH", "SHR", "OTH",
]
SERVICES = ["dhcp", "dns", "http", "irc", "ssh", "ssl"]

# (column suffix, substring of the detailed label)
ATTACK_FAMILIES = [
    ("c2c", "C&C"), ("filedownload", "FileDownload"), ("heartbeat", "HeartBeat"),
    ("ddos", "DDoS"), ("okiru", "Okiru"), ("torii", "Torii"),
    ("horizontal_scan", "PartOfAHorizontalPortScan"), ("attack", "Attack"),
]

MALICIOUS = "Malicious"
BENIGN = "Benign"
SECONDS_PER_DAY = 86400

# Columns that give the label away and are left out before training.
LEAKY_FEATURES = [
    "time_of_day_seconds", "duration", "orig_bytes", "resp_bytes", "missed_bytes",
    "orig_ip_bytes", "resp_ip_bytes", "history_1_ss", "history_1_a", "history_1_d",
]

# Identifier columns that never enter a model.
ID_COLUMNS = [
    "uid", "id.orig_h", "id.resp_h", "simple_label", "label_source", "id.orig_p", "id.resp_p",
]

# ---------------------------------------------------------------------------
# Table schemas: fixed values, too. Column names and types have to agree with the stored tables.
# ---------------------------------------------------------------------------


RAW_TYPES = {
    "ts": T.DoubleType(),
    "uid": T.StringType(),
    "id_orig_h": T.StringType(),
    "id_orig_p": T.IntegerType(),
    "id_resp_h": T.StringType(),
    "id_resp_p": T.IntegerType(),
    "proto": T.StringType(),
    "service": T.StringType(),
    "duration": T.FloatType(),
    "orig_bytes": T.DoubleType(),
    "resp_bytes": T.DoubleType(),
    "conn_state": T.StringType(),
    "local_orig": T.BooleanType(),
    "local_resp": T.BooleanType(),
    "missed_bytes": T.DoubleType(),
    "history": T.StringType(),
    "orig_pkts": T.IntegerType(),
    "orig_ip_bytes": T.DoubleType(),
    "resp_pkts": T.IntegerType(),
    "resp_ip_bytes": T.DoubleType(),
    "tunnel_parents": T.StringType(),
    "label": T.StringType(),
    "detailed_label": T.StringType(),
}
RAW_SCHEMA = T.StructType([T.StructField(n, t) for n, t in RAW_TYPES.items()])

# Raw columns, in the order of LOG_FIELDS.
RAW_COLUMNS = list(RAW_TYPES)

SESSION_PASS_THROUGH = [
    "uid", "ts", "id_orig_h", "id_orig_p", "id_resp_h", "id_resp_p", "proto", "conn_state",
    "missed_bytes", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
]
SESSION_COLUMNS = SESSION_PASS_THROUGH + ["simple_label", "source_file"]

# Satellite table -> value column: one row per session that has the value.
SATELLITES = {
    "session_duration": "duration",
    "session_orig_bytes": "orig_bytes",
    "session_resp_bytes": "resp_bytes",
    "session_local_orig": "local_orig",
    "session_local_resp": "local_resp",
}

IMPUTED = ["duration", "orig_bytes", "resp_bytes"]

# ---------------------------------------------------------------------------
# Generated feature names
# ---------------------------------------------------------------------------

ORIG_PORT_COLUMNS = ["orig_port_well_known", "orig_port_registered", "orig_port_ephemeral"]
VOLUME_COLUMNS = ["missed_bytes", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes"]


def flag_names(prefix: str, values) -> list[str]:
    """`prefix_value` for every value, lower-case."""
    return [f"{prefix}_{v}".lower() for v in values]


def resp_port_columns(ports) -> list[str]:
    return flag_names("resp_port", ports) + ["resp_port_other"]


def history_columns(positions: int = HISTORY_POSITIONS) -> list[str]:
    """Position-major names: history_1_ss, history_1_h, ... history_12_ii."""
    return [f"history_{i}_{s}" for i in range(1, positions + 1) for _, s in HISTORY_CODES]


LABEL_FLAG_COLUMNS = flag_names("label", [s for s, _ in ATTACK_FAMILIES])
LABEL_COLUMNS = ["simple_label_encoded"] + LABEL_FLAG_COLUMNS
IMPUTED_COLUMNS = [n for c in IMPUTED for n in (c, f"{c}_missing")]

TABULAR_FEATURES = (
    ["time_of_day_seconds"]
    + ORIG_PORT_COLUMNS
    + resp_port_columns(TRAINING_PORTS)
    + flag_names("proto", PROTOCOLS)
    + flag_names("conn", CONN_STATES)
    + VOLUME_COLUMNS
    + IMPUTED_COLUMNS
    + flag_names("svc", SERVICES)
)
HISTORY_FEATURES = history_columns()
ALL_FEATURES = TABULAR_FEATURES + HISTORY_FEATURES
TRAINING_COLUMNS = ALL_FEATURES + LABEL_COLUMNS
