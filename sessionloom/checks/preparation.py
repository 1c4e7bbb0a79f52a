"""Queries and oracle SQL: dataset preparation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sessionloom import fixtures as X
from sessionloom import schemas as S
from sessionloom.checks import oracle_base as O
from sessionloom.operators import features as V
from sessionloom.operators import prepare as P
from sessionloom.operators.scaling import RobustScale, StandardScale, minmax_score

SEED = 42
SCALED = ["missed_bytes", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes", "duration",
          "orig_bytes", "resp_bytes", "proto_tcp", "svc_dhcp"]
VECTOR = [f"v{i}" for i in range(64)]


def _view(spark, d, capture=None):
    return V.training_view_fused(X.conn(spark, d), capture, keep=["uid", "source_file"])


def _labelled(spark, d):
    return _view(spark, d).select("uid", "source_file", "simple_label_encoded")


def p_binary_label(spark, d):
    return P.build_binary_label(_view(spark, d)).select("uid", "binary_label")


def p_drop_leaky(spark, d):
    return P.drop_leaky(P.build_binary_label(_view(spark, d)))


def p_feature_groups(spark, d):
    """Per session, how many flags each group sets and how many columns it has."""
    view = _view(spark, d)
    tabular = P.feature_group(view, "tabular", keep=["uid", *S.HISTORY_FEATURES])
    return tabular.select(
        "uid",
        F.lit(len(P.feature_group(view, "all").columns)).alias("n_all"),
        F.lit(len(P.feature_group(view, "history").columns)).alias("n_history"),
        F.lit(len(P.feature_group(view, "tabular").columns)).alias("n_tabular"),
        F.aggregate(
            F.array(*S.HISTORY_FEATURES), F.lit(0), lambda a, x: a + x
        ).alias("history_flags_set"),
        *S.TABULAR_FEATURES,
    )


def p_align_features(spark, d):
    expected = ["svc_ssl", "absent_feature", *S.ORIG_PORT_COLUMNS, "duration", "history_3_dd"]
    return P.align_features(_view(spark, d), expected, keep=["uid"])


def p_random_split(spark, d):
    return P.random_split(_labelled(spark, d), "uid", 0.2, SEED).select("uid", "is_test")


def p_stratified_split(spark, d):
    marked = P.stratified_split(_labelled(spark, d), "uid", "simple_label_encoded", 0.2, SEED)
    return marked.select("uid", "simple_label_encoded", "is_test")


def p_capture_split(spark, d):
    train, test = P.capture_split(_labelled(spark, d), "capture_1.csv", "capture_2.csv")
    side = lambda df, name: df.select("uid", F.lit(name).alias("side"))
    return side(train, "train").unionByName(side(test, "test"))


def _scaled(fit, capture=None):
    """Fitted on all rows, or on one capture, and applied to all."""

    def query(spark, d):
        model = fit(_view(spark, d, capture).select(SCALED), SCALED)
        out = model.transform(_view(spark, d).select("uid", *SCALED))
        return out.select("uid", *[F.round(c, 6).alias(c) for c in SCALED])

    return query


p_standard_scale = _scaled(StandardScale.fit)
p_robust_scale = _scaled(RobustScale.fit)
p_standard_scale_capture = _scaled(StandardScale.fit, "capture_1.csv")
p_robust_scale_capture = _scaled(RobustScale.fit, "capture_1.csv")


def p_class_weights(spark, d):
    weights = P.class_weights(_labelled(spark, d), "simple_label_encoded")
    return weights.select("simple_label_encoded", F.round("weight", 6).alias("weight"))


def p_upsample(spark, d):
    """Rows per session after the draw."""
    drawn = P.upsample_minority(_labelled(spark, d), "uid", "simple_label_encoded", SEED)
    return drawn.groupBy("uid", "simple_label_encoded").agg(F.count("*").alias("copies"))


def p_minmax_score(spark, d):
    scored = minmax_score(X.conn(spark, d).select("uid", "resp_ip_bytes"), "resp_ip_bytes")
    return scored.select("uid", F.round("score", 6).alias("score"))


def p_history_matrix(spark, d):
    """The 12 rows of the matrix, each as a text of 21 digits."""
    wide = P.feature_group(_view(spark, d), "history", keep=["uid"])
    matrix = P.history_matrix(wide)
    digits = lambda i: F.array_join(F.get("history_matrix", i).cast("array<string>"), "")
    return matrix.select("uid", *[digits(i).alias(f"position_{i + 1}") for i in range(12)])


def p_assemble(spark, d):
    """The assembled vector of every embedding, read back as its length and its sum."""
    rows = P.assemble(X.vectors(spark, d), VECTOR)
    values = vector_to_array("features")
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return rows.select("key", F.size(values).alias("width"), F.round(total, 6).alias("total"))


QUERIES = {
    f.__name__: f
    for f in [
        p_binary_label, p_drop_leaky, p_feature_groups, p_align_features, p_random_split,
        p_stratified_split, p_capture_split, p_class_weights, p_upsample, p_minmax_score,
        p_history_matrix, p_assemble,
    ]
}
QUERIES |= {"p_standard_scale": p_standard_scale, "p_robust_scale": p_robust_scale}
QUERIES |= {
    "p_standard_scale_capture": p_standard_scale_capture, "p_robust_scale_capture": p_robust_scale_capture,
}

_TV = O.training_cte()
_ANY = " OR ".join(f"{c} <> 0" for c in S.LABEL_FLAG_COLUMNS if c != "label_attack")
_KEPT = ["uid", "source_file"] + [c for c in S.ALL_FEATURES if c not in S.LEAKY_FEATURES]
_HASH = f"md5('{SEED}:' || uid)"
_LABELLED = f"""
labelled AS (SELECT uid, source_file, {O.malicious()} FROM session)"""
_SUM_HISTORY = " + ".join(S.HISTORY_FEATURES)


_MEAN = ("avg({c})", "stddev_pop({c})")
_MEDIAN = ("quantile_cont({c}, 0.5)", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))")


def _scaled_sql(center: str, scale: str, rows: str = "true") -> str:
    fitted = ", ".join(
        f"{center.format(c=c)} AS {c}_m, {scale.format(c=c)} AS {c}_s" for c in SCALED
    )
    out = ", ".join(
        f"round(({c} - {c}_m) / (CASE WHEN {c}_s = 0 THEN 1 ELSE {c}_s END), 6) AS {c}" for c in SCALED
    )
    return O.with_tables(
        f"SELECT uid, {out} FROM tv, (SELECT {fitted} FROM tv WHERE {rows})",
        _TV,
    )


_WIDTH = len(S.HISTORY_CODES)
_DIGITS = ", ".join(
    "concat(" + ", ".join(S.HISTORY_FEATURES[i * _WIDTH : (i + 1) * _WIDTH]) + f") AS position_{i + 1}"
    for i in range(S.HISTORY_POSITIONS)
)

ORACLE = {
    "p_binary_label": O.with_tables(
        f"SELECT uid, CASE WHEN {_ANY} THEN 1 ELSE 0 END AS binary_label FROM tv", _TV
    ),
    "p_drop_leaky": O.with_tables(f"SELECT {', '.join(_KEPT)} FROM tv", _TV),
    "p_feature_groups": O.with_tables(
        f"SELECT uid, 303 AS n_all, 252 AS n_history, 51 AS n_tabular,"
        f" CAST({_SUM_HISTORY} AS INTEGER) AS history_flags_set, {', '.join(S.TABULAR_FEATURES)} FROM tv",
        _TV,
    ),
    "p_align_features": O.with_tables(
        "SELECT uid, svc_ssl, 0 AS absent_feature, orig_port_well_known, orig_port_registered,"
        " orig_port_ephemeral, duration, history_3_dd FROM tv",
        _TV,
    ),
    "p_random_split": O.with_tables(
        f"SELECT uid, CASE WHEN row_number() OVER (ORDER BY {_HASH}) <="
        " ceil(round(0.2 * count(*) OVER (), 6)) THEN 1 ELSE 0 END AS is_test FROM labelled",
        _LABELLED,
    ),
    "p_stratified_split": O.with_tables(
        f"""SELECT uid, simple_label_encoded,
  CASE WHEN row_number() OVER (PARTITION BY simple_label_encoded ORDER BY {_HASH}) <= n_test
    THEN 1 ELSE 0 END AS is_test
FROM labelled JOIN quota USING (simple_label_encoded)""",
        _LABELLED,
        """
sizes AS (
  SELECT simple_label_encoded, count(*) AS n FROM labelled GROUP BY 1),
draws AS (
  SELECT sum(n) AS total, sum(n) - CAST(ceil(round(0.2 * sum(n), 6)) AS BIGINT) AS n_train
  FROM sizes),
shares AS (
  SELECT simple_label_encoded, n, n_train, n * n_train // total AS whole,
    n * n_train % total AS rest FROM sizes, draws),
quota AS (
  SELECT simple_label_encoded, n - whole - CASE WHEN
      row_number() OVER (ORDER BY rest DESC, simple_label_encoded)
      <= n_train - sum(whole) OVER () THEN 1 ELSE 0 END AS n_test FROM shares)""",
    ),
    "p_capture_split": O.with_conn(
        "SELECT uid, CASE WHEN source_file = 'capture_1.csv' THEN 'train' ELSE 'test' END AS side"
        " FROM conn WHERE source_file IN ('capture_1.csv', 'capture_2.csv')"
    ),
    "p_standard_scale": _scaled_sql(*_MEAN),
    "p_robust_scale": _scaled_sql(*_MEDIAN),
    "p_standard_scale_capture": _scaled_sql(*_MEAN, "source_file = 'capture_1.csv'"),
    "p_robust_scale_capture": _scaled_sql(*_MEDIAN, "source_file = 'capture_1.csv'"),
    "p_class_weights": O.with_tables(
        "SELECT simple_label_encoded, round((SELECT count(*) FROM labelled) /"
        " ((SELECT count(DISTINCT simple_label_encoded) FROM labelled) * count(*)), 6) AS weight"
        " FROM labelled GROUP BY 1",
        _LABELLED,
    ),
    "p_upsample": O.with_tables(
        f"""SELECT uid, simple_label_encoded, 1 AS copies FROM labelled
WHERE simple_label_encoded <> (SELECT smaller FROM side)
UNION ALL
SELECT uid, simple_label_encoded, copies FROM
  (SELECT uid, simple_label_encoded, row_number() OVER (ORDER BY uid) - 1 AS place FROM labelled
   WHERE simple_label_encoded = (SELECT smaller FROM side))
JOIN (SELECT CAST('0x' || substr(md5('{SEED}:' || i), 1, 15) AS BIGINT)
        % (SELECT least(n_pos, n_neg) FROM side) AS place, count(*) AS copies
      FROM (SELECT unnest(range((SELECT greatest(n_pos, n_neg) FROM side))) AS i) GROUP BY 1)
  USING (place)""",
        _LABELLED,
        """
side AS (
  SELECT count(*) FILTER (WHERE simple_label_encoded = 1) AS n_pos,
    count(*) FILTER (WHERE simple_label_encoded = 0) AS n_neg,
    CASE WHEN n_pos < n_neg THEN 1 ELSE 0 END AS smaller FROM labelled)""",
    ),
    "p_minmax_score": O.with_conn(
        "SELECT uid, round((resp_ip_bytes - low) / (high - low), 6) AS score FROM conn,"
        " (SELECT min(resp_ip_bytes) AS low, max(resp_ip_bytes) AS high FROM conn)"
    ),
    "p_history_matrix": O.with_tables(f"SELECT uid, {_DIGITS} FROM tv", _TV),
    "p_assemble": (
        "SELECT CAST(vec_id AS VARCHAR) AS key, CAST(len(embedding) AS INTEGER) AS width,"
        " round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings"
    ),
}
