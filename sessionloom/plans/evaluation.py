"""Evaluate saved models on an unseen labelled capture."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sessionloom.operators import evaluate as E
from sessionloom.operators import models as M
from sessionloom.operators import prepare as P
from sessionloom.session import stable
from sessionloom.sources.tables import append_metrics, write_csv, write_parquet

LABEL = "binary_label"


@dataclass
class Evaluation:
    scores: DataFrame
    scan: DataFrame | None
    summary: DataFrame
    predictions: DataFrame
    report: DataFrame
    confusion: DataFrame
    pr_points: DataFrame
    auc: DataFrame


def evaluate_capture(
    bundles: list[M.Bundle],
    df: DataFrame,
    key: str = "uid",
    strategy: str = "f1",
    threshold: float | None = None,
    metrics_path: str | None = None,
    predictions_path: str | None = None,
    reports_path: str | None = None,
    **floors: float,
) -> Evaluation:
    """Score a wide or compact view with every model, choose thresholds, and report on the outcome.

    The narrow score set is written once; every table below is an aggregation of it. Below
    `reports_path` the report, confusion counts and curve points are written, a folder per model.
    """
    stated = {f"min_{n}": floors.get(f"min_{n}") for n in ("specificity", "precision", "recall")}
    labelled = P.build_binary_label(df)
    wanted = list(dict.fromkeys(f for b in bundles for f in b.inputs))
    rows = P.align_inputs(labelled, wanted, [key, LABEL])
    scores = stable(M.score_all(bundles, rows, key, LABEL))
    scan = None if threshold is not None else E.threshold_scan(scores)
    summary = E.model_summary(scores, strategy, threshold, scan=scan, **stated)
    predictions = E.export_predictions(scores, summary)
    predicted = predictions.select(
        "model", predictions.y_true.alias("label"), predictions.y_pred.alias("prediction")
    )
    steps = E.score_steps(scores)
    if metrics_path:
        if scan is not None:
            append_metrics(E.scan_rows(scan, strategy, stated), metrics_path)
        append_metrics(summary, metrics_path)
    if predictions_path:
        write_csv(predictions, predictions_path)
    report, confusion = E.classification_report(predicted, ["model"]), E.confusion(predicted, ["model"])
    points = E.pr_curve(scores, steps)
    if reports_path:
        for name, table in (("report", report), ("confusion", confusion), ("pr_points", points)):
            write_parquet(table, f"{reports_path}/{name}", ["model"])
    return Evaluation(
        scores, scan, summary, predictions, report, confusion,
        points, E.roc_auc(scores, steps),
    )
