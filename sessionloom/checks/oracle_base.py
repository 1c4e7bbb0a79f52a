"""SQL building blocks shared by the oracle statements: the fixture relations as CTEs."""

from __future__ import annotations

from sessionloom import fixtures as X
from sessionloom import schemas as S


def lit(v) -> str:
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def pick(values, index: str) -> str:
    return f"({array(values)})[CAST({index} AS INTEGER) + 1]"


_SERVICE = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in X.FIXTURE_SERVICES.items())

CONN_COLUMNS = S.RAW_COLUMNS + ["source_file"]

CONN = f"""
conn_n AS (
  SELECT event_id,
    epoch_us(ts) / 1e6 AS ts,
    'C' || event_id AS uid,
    '192.168.' || (user_id // 256) || '.' || (user_id % 256) AS id_orig_h,
    CAST((event_id * 7919) % 65536 AS INTEGER) AS id_orig_p,
    '10.' || (event_id % 7) || '.' || (user_id % 256) || '.' || (event_id % 251) AS id_resp_h,
    CAST({pick(X.PORTS, 'event_id % 20')} AS INTEGER) AS id_resp_p,
    {pick(X.FIXTURE_PROTOCOLS, 'event_id % 3')} AS proto,
    CASE event_type {_SERVICE} END AS service,
    CASE WHEN event_id % 5 <> 0 THEN value END AS duration,
    CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 1500 AS DOUBLE) END AS orig_bytes,
    CASE WHEN event_id % 11 <> 0 THEN CAST(event_id % 900 AS DOUBLE) END AS resp_bytes,
    {pick(X.FIXTURE_STATES, 'event_id % 13')} AS conn_state,
    CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS local_orig,
    CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS local_resp,
    CAST((event_id % 4) * 10 AS DOUBLE) AS missed_bytes,
    CASE WHEN event_id % 17 <> 0 THEN
      substr({lit(X.FIXTURE_HISTORY)}, 1 + event_id % 10, 1 + event_id % 14) END AS history,
    CAST(event_id % 97 AS INTEGER) AS orig_pkts,
    CAST((event_id * 31) % 5000 AS DOUBLE) AS orig_ip_bytes,
    CAST(event_id % 53 AS INTEGER) AS resp_pkts,
    CAST((event_id * 17) % 7000 AS DOUBLE) AS resp_ip_bytes,
    CASE WHEN event_id % 50 = 1 THEN 'C' || (event_id - 1) END AS tunnel_parents,
    CASE WHEN event_type IN ('error', 'signup') THEN 'Malicious'
         WHEN event_id % 2 = 0 THEN 'benign' ELSE 'Benign' END AS label,
    CASE WHEN event_type IN ('error', 'signup') THEN
      {pick(X.FIXTURE_ATTACKS, 'event_id % 7')} END AS detailed_label,
    'capture_' || (event_id % 3 + 1) || '.csv' AS source_file
  FROM events
),
conn AS (SELECT {', '.join(CONN_COLUMNS)} FROM conn_n)"""


def with_conn(body: str, *ctes: str) -> str:
    return "WITH " + ",".join([CONN, *ctes]) + "\n" + body


# Text form of the log's cells, null as the log's null token.
_WHOLE = ["orig_bytes", "resp_bytes", "missed_bytes", "orig_ip_bytes", "resp_ip_bytes"]


def cell(c: str) -> str:
    text = f"CAST({c} AS VARCHAR)"
    if c == "ts":
        text = "printf('%.6f', ts)"
    elif c == "duration":
        text = "CASE WHEN duration IS NOT NULL THEN printf('%.2f', duration) END"
    elif c in _WHOLE:
        text = f"CAST(CAST({c} AS BIGINT) AS VARCHAR)"
    elif c in ("local_orig", "local_resp"):
        text = f"CASE WHEN {c} THEN 'T' WHEN NOT {c} THEN 'F' END"
    return text


def conn_cells(null: str | None = "-", names=None) -> str:
    """SELECT list of the 23 text cells under the log's names (dots made underscores)."""
    out = []
    for n, c in zip(names or plain(S.LOG_FIELDS), S.RAW_COLUMNS):
        text = cell(c) if null is None else f"coalesce({cell(c)}, {lit(null)})"
        out.append(f"{text} AS {n}")
    return ",\n  ".join(out)


def plain(names) -> list[str]:
    return [n.replace(".", "_").replace("-", "_") for n in names]


LEGEND_VALUES = ", ".join(
    f"({i}, {lit(c)}, {lit(d)})" for i, (c, d) in enumerate(S.HISTORY_LEGEND, start=1)
)

# The normalised tables over `conn`.
TABLES = f"""
legend AS (SELECT * FROM (VALUES {LEGEND_VALUES}) AS v(id, code, description)),
session AS (
  SELECT {', '.join(S.SESSION_PASS_THROUGH)},
    CASE WHEN label ILIKE 'benign' THEN 'Benign' ELSE label END AS simple_label, source_file
  FROM conn),
service AS (
  SELECT row_number() OVER (ORDER BY svc_name) AS svc_id, svc_name
  FROM (SELECT DISTINCT service AS svc_name FROM conn WHERE service IS NOT NULL)),
label AS (
  SELECT row_number() OVER (ORDER BY label_name) AS label_id, label_name
  FROM (SELECT DISTINCT detailed_label AS label_name FROM conn WHERE detailed_label IS NOT NULL)),
session_service AS (
  SELECT uid, svc_id FROM conn JOIN service ON service = svc_name),
session_label AS (
  SELECT uid, label_id FROM conn JOIN label ON detailed_label = label_name),
tunnel_parent AS (
  SELECT uid AS child_uid, tunnel_parents AS parent_uid FROM conn
  WHERE tunnel_parents IS NOT NULL),
session_history AS (
  SELECT uid, CAST(i - 1 AS INTEGER) AS index, CAST(id AS BIGINT) AS history_id
  FROM (SELECT uid, h.code AS c, h.ordinality AS i FROM conn,
          unnest(string_split(history, '')) WITH ORDINALITY AS h(code, ordinality))
  JOIN legend ON c = code),
history_array AS (
  SELECT uid, list(code ORDER BY index) AS history_codes
  FROM session_history JOIN legend ON history_id = id GROUP BY uid),
label_string AS (
  SELECT uid, string_agg(label_name, '-' ORDER BY label_name) AS detailed_label
  FROM session_label JOIN label USING (label_id) GROUP BY uid)"""


def with_tables(body: str, *ctes: str) -> str:
    return with_conn(body, TABLES, *ctes)


# Feature expressions. `p` prefixes a column with its relation.


def time_of_day(p: str = "") -> str:
    return f"CAST(round(CAST({p}ts AS DECIMAL(20,6)) % 86400) AS INTEGER) AS time_of_day_seconds"


def orig_port(p: str = "") -> list[str]:
    tests = [f"{p}id_orig_p <= 1023", f"{p}id_orig_p > 1023 AND {p}id_orig_p <= 49151", f"{p}id_orig_p > 49151"]
    return [f"{flag(t)} AS {n}" for t, n in zip(tests, S.ORIG_PORT_COLUMNS)]


def resp_port(ports, p: str = "") -> list[str]:
    other = f"CASE WHEN {p}id_resp_p IN {in_list(ports)} THEN 0 ELSE 1 END AS resp_port_other"
    return one_hot(f"{p}id_resp_p", ports, "resp_port") + [other]


def one_hot(col: str, values, prefix: str) -> list[str]:
    return [f"{flag(f'{col} = {lit(v)}')} AS {n}" for v, n in zip(values, S.flag_names(prefix, values))]


def imputed(p: str = "", prefixes=None) -> list[str]:
    out = []
    for c in S.IMPUTED:
        q = prefixes[c] if prefixes else p
        out += [f"coalesce({q}{c}, 0) AS {c}", f"{flag(f'{q}{c} IS NULL')} AS {c}_missing"]
    return out


def history(codes: str = "history_codes") -> list[str]:
    return [
        f"{flag(f'{codes}[{i}] = {lit(c)}')} AS history_{i}_{s}"
        for i in range(1, S.HISTORY_POSITIONS + 1)
        for c, s in S.HISTORY_CODES
    ]


def attacks(col: str = "detailed_label") -> list[str]:
    return [
        f"{flag(f'contains({col}, {lit(text)})')} AS {n}"
        for n, (_, text) in zip(S.LABEL_FLAG_COLUMNS, S.ATTACK_FAMILIES)
    ]


def malicious(col: str = "simple_label", name: str = "simple_label_encoded") -> str:
    return f"{flag(f'{col} = {lit(S.MALICIOUS)}')} AS {name}"


def volumes() -> list[str]:
    return list(S.VOLUME_COLUMNS)


_VIEW_JOINS = """
  LEFT JOIN history_array ha ON s.uid = ha.uid
  LEFT JOIN (SELECT uid, duration FROM conn WHERE duration IS NOT NULL) sd ON s.uid = sd.uid
  LEFT JOIN (SELECT uid, orig_bytes FROM conn WHERE orig_bytes IS NOT NULL) so ON s.uid = so.uid
  LEFT JOIN (SELECT uid, resp_bytes FROM conn WHERE resp_bytes IS NOT NULL) sr ON s.uid = sr.uid
  LEFT JOIN session_service ss ON s.uid = ss.uid
  LEFT JOIN service sv ON ss.svc_id = sv.svc_id"""
_OWNER = {"duration": "sd.", "orig_bytes": "so.", "resp_bytes": "sr."}


def training_view(capture: str | None, keep=()) -> str:
    """Body of the training view over the normalised tables."""
    columns = [
        *keep, time_of_day("s."), *orig_port("s."), *resp_port(S.TRAINING_PORTS, "s."),
        *one_hot("s.proto", S.PROTOCOLS, "proto"),
        *one_hot("s.conn_state", S.CONN_STATES, "conn"), *volumes(),
        *imputed(prefixes=_OWNER), *one_hot("sv.svc_name", S.SERVICES, "svc"),
        *history("ha.history_codes"), malicious("s.simple_label"), *attacks("ls.detailed_label"),
    ]
    where = f"\n  WHERE s.source_file = {lit(capture)}" if capture else ""
    return (
        "SELECT " + ",\n  ".join(columns) + "\n  FROM session s" + _VIEW_JOINS
        + "\n  LEFT JOIN label_string ls ON s.uid = ls.uid" + where
    )


def training_cte(name: str = "tv", capture: str | None = None) -> str:
    return f"\n{name} AS ({training_view(capture, ['s.uid', 's.source_file'])})"


def session_full_view() -> str:
    columns = [
        *[f"s.{c}" for c in S.SESSION_COLUMNS],
        *[ipv4(f"s.{c}") + f" AS {c}_int" for c in ("id_orig_h", "id_resp_h")],
        time_of_day("s."), *imputed(prefixes=_OWNER), "sv.svc_name",
        *one_hot("sv.svc_name", S.SERVICES, "svc"), "tp.parent_uid",
        "array_to_string(ha.history_codes, ',') AS history_codes",
        *history("ha.history_codes"), *one_hot("s.conn_state", S.CONN_STATES, "conn"),
        *one_hot("s.proto", S.PROTOCOLS, "proto"), *orig_port("s."),
        *resp_port(S.IOT_PORTS, "s."), malicious("s.simple_label", "label"),
    ]
    return (
        "SELECT " + ",\n  ".join(columns) + "\n  FROM session s" + _VIEW_JOINS
        + "\n  LEFT JOIN tunnel_parent tp ON s.uid = tp.child_uid"
    )


def ipv4(col: str) -> str:
    part = lambda i, w: f"CAST(split_part({col}, '.', {i}) AS BIGINT) * {w}"
    return "(" + " + ".join(part(i, 256 ** (4 - i)) for i in range(1, 5)) + ")"
