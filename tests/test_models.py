"""Invariants of the fitted models."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sessionloom import schemas as S
from sessionloom.checks.modelling import FAMILY, LABEL
from sessionloom.operators import evaluate as E
from sessionloom.operators import features as V
from sessionloom.operators import models as M
from sessionloom.operators import prepare as P
from sessionloom.plans import training as T
from sessionloom.plans.evaluation import evaluate_capture


@pytest.fixture(scope="module")
def compact(raw):
    return P.build_binary_label(V.compact_view(raw)).persist()


@pytest.fixture(scope="module")
def wide(raw):
    return V.training_view_fused(raw, keep=["uid", "source_file"]).persist()


@pytest.fixture(scope="module")
def logreg(compact):
    return M.fit_logreg(compact, S.ALL_FEATURES, LABEL)


def share(bundle, df, label):
    scored = bundle.add_score(df).withColumn("prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    return E.accuracy(scored.select(F.col(label).alias("label"), "prediction")).first()[0]


def test_logreg_beats_the_majority(compact, logreg):
    majority = max(r["n"] for r in compact.groupBy(LABEL).agg(F.count("*").alias("n")).collect())
    assert share(logreg, compact, LABEL) > max(0.99, majority / compact.count())


def test_logreg_is_at_its_optimum(spark):
    """The gradient of the stated objective vanishes: C * sum(loss) + |w|^2 / 2."""
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(300, 2)) * [1.0, 5.0]
    y = (x[:, 0] + 0.3 * rnd.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    model = M.fit_logreg(df, ["a", "b"], "y", C=2.0, scale=False).pipeline.stages[-1]
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(2.0 * x.T @ (p - y) + w).max() < 0.5
    assert abs((p - y).sum()) < 0.1


def test_compact_and_wide_fit_the_same(compact, wide, logreg):
    same = M.fit_logreg(wide, S.ALL_FEATURES, LABEL)
    a, b = (m.pipeline.stages[-1].coefficients.toArray() for m in (logreg, same))
    assert same.features == logreg.features == S.ALL_FEATURES
    assert a == pytest.approx(b, abs=1e-6)


def test_top_coefficients(logreg):
    rows = M.top_coefficients(logreg).collect()
    values = [r.importance for r in rows]
    assert len(rows) == 15 and values == sorted(values, reverse=True)
    assert rows[0].feature.startswith("svc_")


def test_svm_probability_follows_the_margin(compact):
    bundle = M.fit_calibrated_svm(compact, S.TABULAR_FEATURES, FAMILY, "uid")
    scored = bundle.pipeline.transform(compact).select(
        vector_to_array("margin_0")[1].alias("m"), vector_to_array("probability_0")[1].alias("p")
    ).toPandas().sort_values("m")
    assert scored.p.between(0, 1).all() and scored.p.is_monotonic_increasing
    assert len(bundle.outputs) == 3 and share(bundle, compact, FAMILY) > 0.9


def test_reconstruction_error_falls_with_components(compact):
    latent = M.fit_latent(compact, S.TABULAR_FEATURES, 6)
    errors = M.reconstruction_error(compact, latent).toPandas()
    total = errors.groupby("components").mse.sum().sort_index()
    assert len(errors) == 6 * 51 and total.is_monotonic_decreasing
    rows = latent.encode(compact).select(vector_to_array("tab_latent").alias("z")).toPandas()
    assert np.stack(rows.z).shape == (compact.count(), 6)


def test_hybrid_and_history_latents(compact):
    bundle = M.fit_hybrid(compact, LABEL)
    assert bundle.features == [f"tab_latent_{i}" for i in range(4)] + ["hist_latent_0", "hist_latent_1"]
    assert 0.5 <= share(bundle, compact, LABEL) <= 1


def test_mlp_and_its_input_weights(compact):
    bundle = M.fit_mlp(compact, S.TABULAR_FEATURES, LABEL, (8,), 60)
    assert share(bundle, compact, LABEL) > 0.9
    top = M.top_input_weights(bundle).collect()
    assert len(top) == 15 and {r.feature for r in top} <= set(S.TABULAR_FEATURES)
    weights = bundle.pipeline.stages[-1].weights.toArray()
    assert len(weights) == 52 * 8 + 9 * 2
    assert top[0].importance == pytest.approx(np.abs(weights[: 51 * 8]).reshape(51, 8).mean(axis=1).max())


def test_saved_models_score_the_same(spark, compact, logreg, tmp_path):
    bundles = [logreg, M.fit_on_latents(compact, [M.fit_history_latent(compact)], LABEL, name="History latent")]
    M.save_bundles(bundles, str(tmp_path / "models"))
    loaded = M.load_bundles(spark, str(tmp_path / "models"))
    assert {b.name for b in loaded} == {b.name for b in bundles}
    before = M.score_all(bundles, compact, "uid", LABEL)
    after = M.score_all(loaded, compact, "uid", LABEL)
    assert before.exceptAll(after).count() == 0 and before.count() == 2 * compact.count()
    with pytest.raises(ValueError):
        M.score_all([], compact, "uid", LABEL)


def test_train_all_then_evaluate(spark, wide, tmp_path):
    bundles, metrics = T.train_all(wide, trees=5, mlp_hidden=(64, 32), mlp_iterations=10)
    rows = metrics.collect()
    assert len(rows) == 4 and {r.tp + r.fp + r.tn + r.fn for r in rows} == {200}
    assert not set(S.LEAKY_FEATURES) & set(bundles[0].features) and len(bundles[0].features) == 293
    path = str(tmp_path / "metrics")
    unseen = wide.filter(F.col("source_file") == "capture_3.csv").drop("svc_dhcp")
    done = evaluate_capture(bundles[:2], unseen, strategy="youden", metrics_path=path,
                            predictions_path=str(tmp_path / "predictions"))
    assert done.summary.count() == 2 and done.predictions.count() == 2 * unseen.count()
    assert spark.read.option("header", True).csv(path).count() == 2 * 102
    predicted, accuracy = T.predict_capture(bundles[0], unseen, ["uid"])
    assert predicted.count() == unseen.count() and 0 <= accuracy.first()[0] <= 1
    assert T.predict_capture(bundles[0], unseen.drop(LABEL), ["uid"])[1] is None


def test_scores_without_a_probability(compact):
    """A decision value is mapped to 0..1; a bare class is its own score."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LinearSVC

    stages, names = M.input_stages(compact, S.TABULAR_FEATURES)
    svm = LinearSVC(featuresCol="assembled", labelCol=FAMILY, maxIter=5).fit(M._run(stages, compact))
    fitted = PipelineModel([*stages, svm])
    margin = M.Bundle("margin", names, fitted, ["rawPrediction"], "margin")
    label = M.Bundle("label", names, fitted, ["prediction"], "label")
    scores = M.score_all([margin, label], compact, "uid", FAMILY).toPandas()
    by_model = scores.groupby("model").score
    assert by_model.min().tolist() == [0.0, 0.0] and by_model.max().tolist() == [1.0, 1.0]
    assert set(scores[scores.model == "label"].score) <= {0.0, 1.0}


def test_a_capture_is_scored_once(spark):
    class Tenth:
        inputs = ["x"]

        def add_score(self, df):
            return df.withColumn("score", F.col("x") / 10)

    n = F.col("id")
    rows = spark.range(11).select(n.cast("string").alias("uid"), n.cast("double").alias("x"), (n > 5).cast("int").alias("simple_label_encoded"))
    predictions, accuracy = T.predict_capture(Tenth(), rows, ["uid"])
    assert accuracy.first()["accuracy"] == 1.0 and predictions.filter("prediction = 1").count() == 5
    for df in (predictions, accuracy):
        assert "Range (" not in df._jdf.queryExecution().executedPlan().toString()
