"""Evaluation of score sets: relations of (key, model, label 0/1, score[, prediction]).

Every metric starts from one aggregation per model, so rows with the same score or outcome are
merged before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.joins import local_copy, lookup_join
from sessionloom.operators.ordered import running_totals

# The strategies of a threshold search and the size of its grid.
STRATEGIES = ("f1", "f2", "youden")
GRID_POINTS = 101

COUNTS = ["tp", "fp", "tn", "fn"]
METRICS = ["precision", "recall", "specificity", "f1", "balanced_accuracy"]


def _ratio(top: Column, bottom: Column) -> Column:
    """The quotient, and 0 for an empty denominator."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp over the fixed classes 0 and 1."""
    y, p = F.col("label"), F.col("prediction")
    return df.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    right = (F.col("label") == F.col("prediction")).cast("double")
    return df.groupBy(*by).agg(F.avg(right).alias("accuracy"))


def classification_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class and for the averages: precision, recall, f1 and support.

    The classes are those seen as label or prediction. The only pass over the rows counts
    (label, prediction) pairs; all else works on those few counts.
    """
    by = list(by)
    pairs = df.groupBy(*by, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).alias("predicted")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).alias("actual"), F.col("n").alias("predicted")),
    )
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    per_side = pairs.select(*by, "label", hit.alias("hit"), F.explode(sides).alias("s"))
    own = F.col("s.class") == F.col("label")
    per_class = (
        per_side.groupBy(*by, F.col("s.class").cast("string").alias("class"))
        .agg(
            # A hit shows up on both sides; count it on the actual one.
            F.sum(F.when(own & (F.col("s.actual") > 0), F.col("hit")).otherwise(0)).alias("hits"),
            F.sum("s.actual").alias("support"),
            F.sum("s.predicted").alias("predicted"),
        )
        .withColumns({
            "precision": _ratio(F.col("hits"), F.col("predicted")),
            "recall": _ratio(F.col("hits"), F.col("support")),
            "f1": _ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")),
        })
    )
    shown = ["precision", "recall", "f1"]
    averages = per_class.groupBy(*by).agg(
        F.struct(
            F.lit("accuracy").alias("class"),
            F.lit(None).cast("double").alias("precision"),
            F.lit(None).cast("double").alias("recall"),
            _ratio(F.sum("hits"), F.sum("support")).alias("f1"),
            F.sum("support").alias("support"),
        ).alias("a"),
        F.struct(
            F.lit("macro avg").alias("class"),
            *[F.avg(m).alias(m) for m in shown],
            F.sum("support").alias("support"),
        ).alias("m"),
        F.struct(
            F.lit("weighted avg").alias("class"),
            *[_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in shown],
            F.sum("support").alias("support"),
        ).alias("w"),
    )
    summary = averages.select(*by, F.explode(F.array("a", "m", "w")).alias("r")).select(*by, "r.*")
    return per_class.select(*by, "class", *shown, "support").unionByName(summary)


def _metric_columns() -> dict[str, Column]:
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return {
        "precision": _ratio(tp, tp + fp),
        "recall": recall,
        "specificity": specificity,
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "balanced_accuracy": (recall + specificity) / 2,
    }


def reaches(score: Column, threshold: Column) -> Column:
    """`score >= threshold`; a score that is null or no number reaches nothing."""
    return F.coalesce(~F.isnan(score) & (score >= threshold), F.lit(False))


def metrics_at(scores: DataFrame, threshold: float) -> DataFrame:
    """Counts and metrics per model with `score >= threshold` as the positive side."""
    positive, y = reaches(F.col("score").cast("double"), F.lit(float(threshold))), F.col("label")
    return (
        scores.groupBy("model")
        .agg(
            F.count_if(positive & (y == 1)).alias("tp"),
            F.count_if(positive & (y == 0)).alias("fp"),
            F.count_if(~positive & (y == 0)).alias("tn"),
            F.count_if(~positive & (y == 1)).alias("fn"),
        )
        .select("model", F.lit(float(threshold)).alias("threshold"), *COUNTS)
        .withColumns(_metric_columns())
    )


def _number_or_lowest() -> Column:
    score = F.col("score").cast("double")
    return F.when(score.isNull() | F.isnan(score), F.lit(float("-inf"))).otherwise(score)


def threshold_grid(n: int = GRID_POINTS) -> list[float]:
    """`n` evenly spaced thresholds from 0 to 1, as whole multiples of the step."""
    step = 1.0 / (n - 1)
    return [i * step for i in range(n - 1)] + [1.0]


def threshold_scan(scores: DataFrame, n: int = GRID_POINTS) -> DataFrame:
    """`metrics_at` for every grid threshold from a single aggregation.

    A score's bucket is the number of thresholds not above it, so the rows collapse to at most
    2(n + 1) counts per model before those are spread over the grid.
    """
    grid = threshold_grid(n)
    buckets = Bucketizer(
        splits=[-float("inf"), *grid, float("inf")], inputCol="score", outputCol="_bucket"
    )
    y = F.col("label")
    # Scores that are null or no number lie below every threshold.
    counts = (
        buckets.transform(scores.select("model", "label", _number_or_lowest().alias("score")))
        .groupBy("model", F.col("_bucket").cast("int").alias("_bucket"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    )
    at = counts.select(
        "model", "_bucket", "pos", "neg",
        F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("_i", "threshold"),
    )
    above = F.col("_bucket") > F.col("_i")
    return (
        at.groupBy("model", "threshold")
        .agg(
            F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(above, 0).otherwise(F.col("neg"))).alias("tn"),
            F.sum(F.when(above, 0).otherwise(F.col("pos"))).alias("fn"),
        )
        .withColumns(_metric_columns())
    )


def _objective(strategy: str) -> Column:
    precision, recall = F.col("precision"), F.col("recall")
    if strategy == "f1":
        return F.col("f1")
    if strategy == "f2":
        return _ratio(5 * precision * recall, 4 * precision + recall)
    if strategy == "youden":
        return recall + F.col("specificity") - 1
    raise ValueError(f"unknown strategy {strategy!r}; use one of {', '.join(STRATEGIES)}")


def choose_threshold(
    scan: DataFrame,
    strategy: str = "f1",
    min_specificity: float | None = None,
    min_precision: float | None = None,
    min_recall: float | None = None,
) -> DataFrame:
    """Per model the scan row with the best objective, the lowest threshold among equals.

    Rows below a floor count only for a model none of whose rows meets all floors; `used_floors`
    says which pool was used.
    """
    floors = {"specificity": min_specificity, "precision": min_precision, "recall": min_recall}
    meets = F.lit(True)
    for name, floor in floors.items():
        if floor is not None:
            meets = meets & (F.col(name) >= F.lit(float(floor)))
    columns = ["threshold", *COUNTS, *METRICS]
    rank = F.struct(meets.alias("meets"), _objective(strategy).alias("o"), (-F.col("threshold")).alias("t"))
    best = scan.groupBy("model").agg(F.max_by(F.struct(*columns, meets.alias("used_floors")), rank).alias("b"))
    return best.select("model", "b.*")


def pr_curve(scores: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Precision and recall with each distinct score as the threshold, then the point (1, 0).

    Equal scores are merged first; the rest is a running total from the highest score down. `steps`
    is what `score_steps` gives, if that is at hand.
    """
    curve = score_steps(scores) if steps is None else steps
    curve = curve.filter("score is not null")
    positives = _class_totals(scores).select("model", "n_pos")
    held = local_copy(positives)
    positives = positives if held is None else held
    points = lookup_join(curve, positives, "model").select(
        "model",
        F.col("score").alias("threshold"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        # Without positives every recall is 1 by convention.
        F.when(F.col("n_pos") == 0, 1.0)
        .otherwise(_ratio(F.col("tp"), F.col("n_pos")))
        .alias("recall"),
    )
    last = positives.select(
        "model",
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return points.unionByName(last)


def _class_totals(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(
        F.count_if(F.col("label") == 1).alias("n_pos"),
        F.count_if(F.col("label") == 0).alias("n_neg"),
    )


def score_steps(scores: DataFrame) -> DataFrame:
    """Distinct scores per model with their counts and the counts at or above them.

    Scores that are null or no number make the last step, with a null score.
    """
    score = F.col("score").cast("double")
    steps = scores.groupBy("model", F.when(~F.isnan(score), score).alias("score")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    return running_totals(
        steps, ["model"], [F.desc_nulls_last("score")], {"tp": F.col("pos"), "fp": F.col("neg")}
    )


def roc_auc(scores: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half; null where a class is absent."""
    # Each negative is outranked by the positives strictly above it and half of those level.
    above = F.col("tp") - F.col("pos") + F.col("pos") / 2
    won = F.sum(F.col("neg") * above)
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    steps = score_steps(scores) if steps is None else steps
    return steps.groupBy("model").agg(F.try_divide(won, pairs).alias("roc_auc"))


def strategy_name(strategy: str, used_floors: Column) -> Column:
    return F.when(used_floors, F.lit(f"{strategy} +floors")).otherwise(F.lit(strategy))


def model_summary(
    scores: DataFrame,
    strategy: str = "f1",
    threshold: float | None = None,
    min_specificity: float | None = None,
    min_precision: float | None = None,
    min_recall: float | None = None,
    scan: DataFrame | None = None,
) -> DataFrame:
    """One row per model: strategy, floors, chosen threshold and its metrics."""
    floors = {
        "min_specificity": min_specificity, "min_precision": min_precision, "min_recall": min_recall,
    }
    if threshold is not None:
        rows = metrics_at(scores, threshold).withColumn("strategy", F.lit(f"fixed@{threshold:.2f}"))
    else:
        scan = threshold_scan(scores) if scan is None else scan
        rows = choose_threshold(scan, strategy, **floors)
        rows = rows.withColumn("strategy", strategy_name(strategy, F.col("used_floors")))
    return _metric_rows(rows, floors)


def scan_rows(scan: DataFrame, strategy: str, floors: dict[str, float | None]) -> DataFrame:
    """The scan in the layout of the metrics table."""
    return _metric_rows(scan.withColumn("strategy", F.lit(strategy)), floors)


def _metric_rows(rows: DataFrame, floors: dict[str, float | None]) -> DataFrame:
    stated = [F.lit(v).cast("double").alias(n) for n, v in floors.items()]
    return rows.select("model", "strategy", *stated, "threshold", *COUNTS, *METRICS)


def export_predictions(scores: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every row with the prediction at its model's chosen threshold."""
    cut = lookup_join(scores, chosen.select("model", "threshold"), "model")
    return cut.select(
        "model",
        "key",
        F.col("label").alias("y_true"),
        F.col("score").alias("y_prob"),
        F.when(reaches(F.col("score").cast("double"), F.col("threshold")), 1).otherwise(0).alias("y_pred"),
    )
