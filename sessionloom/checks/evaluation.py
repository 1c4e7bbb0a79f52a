"""Queries and oracle SQL: evaluation of two score columns over the connections."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom import fixtures as X
from sessionloom.operators import evaluate as E
from sessionloom.session import scratch_path
from sessionloom.sources import tables as T

CUT = 0.5
FLOORS = {"min_specificity": 0.5, "min_precision": 0.3, "min_recall": 0.05}
UNREACHABLE = {"min_precision": 1.1}


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in (cols or E.METRICS)})


def _predicted(spark, d):
    return X.scores(spark, d).withColumn("prediction", F.when(F.col("score") >= CUT, 1).otherwise(0))


def e_confusion(spark, d):
    return E.confusion(_predicted(spark, d), ["model"])


def e_accuracy(spark, d):
    return _rounded(E.accuracy(_predicted(spark, d), ["model"]), "accuracy")


def e_classification_report(spark, d):
    return _rounded(
        E.classification_report(_predicted(spark, d), ["model"]), "precision", "recall", "f1"
    )


def e_metrics_at(spark, d):
    return _rounded(E.metrics_at(X.scores(spark, d), 0.35))


def _scan(spark, d):
    return E.threshold_scan(X.scores(spark, d))


def e_threshold_scan(spark, d):
    return _rounded(_scan(spark, d))


def e_choose_f1(spark, d):
    return _rounded(E.choose_threshold(_scan(spark, d), "f1"))


def e_choose_f2(spark, d):
    return _rounded(E.choose_threshold(_scan(spark, d), "f2"))


def e_choose_youden(spark, d):
    return _rounded(E.choose_threshold(_scan(spark, d), "youden"))


def e_choose_floors(spark, d):
    return _rounded(E.choose_threshold(_scan(spark, d), "f1", **FLOORS))


def e_pr_curve(spark, d):
    return _rounded(E.pr_curve(X.scores(spark, d)), "precision", "recall")


def e_roc_auc(spark, d):
    return _rounded(E.roc_auc(X.scores(spark, d)), "roc_auc")


def e_model_summary(spark, d):
    """By search, by a fixed threshold, and with floors that no threshold meets."""
    scores = X.scores(spark, d)
    rows = E.model_summary(scores, "f2", **FLOORS)
    rows = rows.unionByName(E.model_summary(scores, threshold=CUT))
    return _rounded(rows.unionByName(E.model_summary(scores, "youden", **UNREACHABLE)))


def e_predictions(spark, d):
    scores = X.scores(spark, d)
    return _rounded(E.export_predictions(scores, E.model_summary(scores)), "y_prob")


def io_append_metrics(spark, d):
    """The metrics of two runs appended to one file set."""
    rows = _rounded(E.model_summary(X.scores(spark, d)))
    path = scratch_path(spark, "metrics")
    T.append_metrics(rows, path)
    T.append_metrics(rows, path)
    return T.read_csv(spark, path, rows.schema)


QUERIES = {
    f.__name__: f
    for f in [
        io_append_metrics, e_confusion, e_accuracy, e_classification_report, e_metrics_at,
        e_threshold_scan, e_choose_f1, e_choose_f2, e_choose_youden, e_choose_floors, e_pr_curve,
        e_roc_auc, e_model_summary, e_predictions,
    ]
}

_SCORES = """
base AS (
  SELECT 'C' || event_id AS key, event_id, value,
    CASE WHEN event_type IN ('error', 'signup') THEN 1 ELSE 0 END AS label FROM events),
scores AS (
  SELECT key, 'score_a' AS model, label, (event_id * 37 % 101) * CAST(0.01 AS DOUBLE) AS score
  FROM base
  UNION ALL
  SELECT key, 'score_b', label, least(coalesce(value, 0), 100) / 100 FROM base),
predicted AS (
  SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM scores)"""

_RAW_COUNTS = """
  count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp,
  count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp,
  count(*) FILTER (WHERE score < threshold AND label = 0) AS tn,
  count(*) FILTER (WHERE score < threshold AND label = 1) AS fn"""

_MEASURED = """
  coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
  coalesce(tn / nullif(tn + fp, 0), 0) AS specificity,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1"""


def _at(thresholds: str, name: str) -> str:
    return f""",
{name}_counts AS (
  SELECT model, threshold, {_RAW_COUNTS}
  FROM scores JOIN ({thresholds}) AS t ON true GROUP BY model, threshold),
{name}_metrics AS (SELECT *, {_MEASURED} FROM {name}_counts),
{name} AS (SELECT *, (recall + specificity) / 2 AS balanced_accuracy FROM {name}_metrics)"""


_GRID = "SELECT i * CAST(0.01 AS DOUBLE) AS threshold FROM generate_series(0, 100) AS g(i)"
_SCAN = _at(_GRID, "scan")
_WITH = "WITH" + _SCORES
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in E.METRICS)
_SHOWN = f"model, threshold, tp, fp, tn, fn, {_ROUNDED}"
_OBJECTIVE = {
    "f1": "f1",
    "f2": "coalesce(5 * precision * recall / nullif(4 * precision + recall, 0), 0)",
    "youden": "recall + specificity - 1",
}


def _floors(floors: dict) -> str:
    return " AND ".join(f"{n.removeprefix('min_')} >= {v}" for n, v in floors.items()) or "true"


def _chosen(strategy: str, floors: dict) -> str:
    return (
        f"(SELECT *, {_floors(floors)} AS used_floors FROM scan QUALIFY row_number() OVER ("
        f"PARTITION BY model ORDER BY used_floors DESC, {_OBJECTIVE[strategy]} DESC, threshold) = 1)"
    )


def _choose(strategy: str, floors: dict | None = None) -> str:
    return f"{_WITH}{_SCAN}\nSELECT {_SHOWN}, used_floors FROM {_chosen(strategy, floors or {})}"


def _summary(source: str, strategy: str, floors: dict) -> str:
    stated = ", ".join(
        f"CAST({floors.get(n, 'NULL')} AS DOUBLE) AS {n}"
        for n in ("min_specificity", "min_precision", "min_recall")
    )
    return f"SELECT {strategy} AS strategy, {stated}, {_SHOWN} FROM {source}"


def _searched(strategy: str, floors: dict) -> str:
    name = f"CASE WHEN used_floors THEN '{strategy} +floors' ELSE '{strategy}' END"
    return _summary(_chosen(strategy, floors), name, floors)


_STEPS = """,
steps AS (
  SELECT model, score, count(*) FILTER (WHERE label = 1) AS pos,
    count(*) FILTER (WHERE label = 0) AS neg FROM scores GROUP BY model, score),
curve AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER (PARTITION BY model) AS n_pos, sum(neg) OVER (PARTITION BY model) AS n_neg
  FROM steps WINDOW w AS (PARTITION BY model ORDER BY score DESC))"""

_REPORT = """,
classes AS (
  SELECT DISTINCT model, label AS class FROM predicted
  UNION SELECT DISTINCT model, prediction FROM predicted),
per_class AS (
  SELECT c.model, CAST(c.class AS VARCHAR) AS class,
    count(*) FILTER (WHERE label = class AND prediction = class) AS hits,
    count(*) FILTER (WHERE label = class) AS support,
    count(*) FILTER (WHERE prediction = class) AS predicted
  FROM classes c JOIN predicted p ON c.model = p.model GROUP BY ALL),
report AS (
  SELECT model, class, coalesce(hits / nullif(predicted, 0), 0) AS precision,
    coalesce(hits / nullif(support, 0), 0) AS recall,
    coalesce(2 * hits / nullif(predicted + support, 0), 0) AS f1, support, hits FROM per_class),
whole AS (
  SELECT model, class, precision, recall, f1, support FROM report
  UNION ALL
  SELECT model, 'accuracy', NULL, NULL, sum(hits) / sum(support), sum(support)
  FROM report GROUP BY model
  UNION ALL
  SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)
  FROM report GROUP BY model
  UNION ALL
  SELECT model, 'weighted avg', sum(precision * support) / sum(support),
    sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)
  FROM report GROUP BY model)
SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM whole"""


ORACLE = {
    "io_append_metrics": (
        f"{_WITH}{_SCAN},\nonce AS ({_searched('f1', {})})\n"
        "SELECT * FROM once UNION ALL SELECT * FROM once"
    ),
    "e_confusion": _WITH + """
SELECT model, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
  count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
  count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM predicted GROUP BY model""",
    "e_accuracy": _WITH + """
SELECT model, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM predicted GROUP BY model""",
    "e_classification_report": _WITH + _REPORT,
    "e_metrics_at": (
        _WITH + _at("SELECT CAST(0.35 AS DOUBLE) AS threshold", "one") + f"\nSELECT {_SHOWN} FROM one"
    ),
    "e_threshold_scan": f"{_WITH}{_SCAN}\nSELECT {_SHOWN} FROM scan",
    "e_choose_f1": _choose("f1"),
    "e_choose_f2": _choose("f2"),
    "e_choose_youden": _choose("youden"),
    "e_choose_floors": _choose("f1", FLOORS),
    "e_pr_curve": _WITH + _STEPS + """
SELECT model, score AS threshold, round(tp / (tp + fp), 6) AS precision,
  round(CASE WHEN n_pos = 0 THEN 1 ELSE tp / n_pos END, 6) AS recall FROM curve
UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM scores""",
    "e_roc_auc": _WITH + _STEPS + """
SELECT model, round(sum(neg * (tp - pos + pos / 2)) / nullif(max(n_pos) * max(n_neg), 0), 6)
  AS roc_auc FROM curve GROUP BY model""",
    "e_model_summary": (
        f"{_WITH}{_SCAN}{_at(f'SELECT CAST({CUT} AS DOUBLE) AS threshold', 'one')}\n"
        + "\nUNION ALL ".join([
            _searched("f2", FLOORS),
            _summary("one", f"'fixed@{CUT:.2f}'", {}),
            _searched("youden", UNREACHABLE),
        ])
    ),
    "e_predictions": (
        f"{_WITH}{_SCAN}\nSELECT s.model, key, label AS y_true, round(score, 6) AS y_prob,"
        f" CASE WHEN score >= c.threshold THEN 1 ELSE 0 END AS y_pred"
        f" FROM scores s JOIN {_chosen('f1', {})} AS c ON s.model = c.model"
    ),
}
