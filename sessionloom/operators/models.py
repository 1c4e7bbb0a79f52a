"""Distributed classifiers and latent features, each as one pipeline from columns to score.

A scaler is a stage of the model's own pipeline, so a model can never be applied to data scaled
for another one.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import (
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import (
    PCA,
    CountVectorizerModel,
    ElementwiseProduct,
    SQLTransformer,
    StandardScaler,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from sessionloom import schemas as S
from sessionloom.operators.margins import fit_margins, margin_gradients, margin_model, margin_rows
from sessionloom.operators.networks import (
    SELF,
    Schedule,
    fit_network,
    held_by_key,
    losses,
    n_weights,
    network_model,
    train_network,
)
from sessionloom.operators.partial_sums import matrix, second_moments, summed
from sessionloom.operators.prepare import (
    align_inputs,
    fit_sample,
    stratified_folds,
    upsample_minority,
    with_class_weight,
)
from sessionloom.operators.scaling import RobustScale, minmax_score

# The training budgets and stopping tolerances of the models.
LOGREG_ITERATIONS = 1000
LINEAR_TOLERANCE = 1e-4
FOREST_TREES = 300
CALIBRATION_FOLDS = 3
MLP_HIDDEN = (512, 256, 128, 64)
MLP_ITERATIONS = 300
BALANCED_MLP_HIDDEN = (256, 128)
BALANCED_MLP_ITERATIONS = 1000
BALANCED_MLP_PENALTY = 1e-3
CLEAN_MLP_HIDDEN = (128, 64)
LATENT_MLP_HIDDEN = (128, 64, 32, 16)
TABULAR_LATENTS = 4
FULL_LATENTS = 20
HISTORY_LATENTS = 2
HISTORY_WINDOW = 3
AUTOENCODER_HIDDEN = 64
AUTOENCODER_EPOCHS = 20
TOP_FEATURES = 15
SEED = 42

# The deepest that the library's trees can grow.
FOREST_DEPTH = 30
#: Statistics of the nodes that a task splits at a time: two tasks share an executor's heap with the rows kept there.
FOREST_STATISTICS_MB = 256
#: Newton steps end when no part of the margin's gradient is larger, per unit of the rows' weight.
SVM_TOLERANCE = 1e-6
SVM_STEPS = 200
#: The networks' steps: hidden units are sigmoids, which need larger ones than rectified units do.
BALANCED_MLP_RATE = 3e-3
#: Passes over the rows between two looks at the rows set aside, and looks without a smaller loss that end a fit.
BALANCED_MLP_PASSES = 5
BALANCED_MLP_PATIENCE = 3


@dataclass
class Bundle:
    """A fitted model: its vector's names, its stages, where its score comes from, what it reads.

    `features` names the entries of the vector the classifier sees; `inputs` are the columns that the
    stages read, with `history_terms` among them if the flags come as that array. `kind` is `probability` or `margin` (vector columns whose second entry counts), or `label`.
    With several outputs the score is their mean.
    """

    name: str
    features: list[str]
    pipeline: PipelineModel
    outputs: list[str]
    kind: str = "probability"
    notes: dict = field(default_factory=dict)
    inputs: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.inputs = self.inputs or stage_inputs(self.pipeline.stages)

    def add_score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """`df` with the score as one more column; stage outputs are not kept."""
        # Intermediate columns of the stages must not collide with those of `df`.
        out = self.pipeline.transform(df)
        if self.kind == "label":
            return out.select(*df.columns, F.col(self.outputs[0]).cast("double").alias(name))
        values = [vector_to_array(c)[1] for c in self.outputs]
        total: Column = values[0]
        for v in values[1:]:
            total = total + v
        scored = out.select(*df.columns, (total / len(values)).alias(name))
        return minmax_score(scored, name, name) if self.kind == "margin" else scored


def stage_inputs(stages: Iterable[Transformer]) -> list[str]:
    """The columns that stages read and none of them makes."""
    made, read = set(), []
    for stage in stages:
        for param in ("inputCols", "inputCol", "featuresCol"):
            if stage.hasParam(param) and stage.isDefined(param):
                value = stage.getOrDefault(param)
                read += [c for c in ([value] if isinstance(value, str) else value) if c not in made]
        for param in ("outputCol", "rawPredictionCol", "probabilityCol", "predictionCol"):
            if stage.hasParam(param) and stage.isDefined(param):
                made.add(stage.getOrDefault(param))
    return list(dict.fromkeys(read))


# --- stages --------------------------------------------------------------------


def input_stages(df: DataFrame, features: Sequence[str], output: str = "assembled") -> tuple[list[Transformer], list[str]]:
    """Stages from the columns of `df` to one vector, and the feature names in vector order.

    If the history flags come as `history_terms` instead of columns, a fixed vocabulary turns
    them into a sparse vector.
    """
    features = list(features)
    history = [f for f in features if f in set(S.HISTORY_FEATURES)]
    if "history_terms" in df.columns and history:
        plain = [f for f in features if f not in set(history)]
        terms = CountVectorizerModel.from_vocabulary(
            history, inputCol="history_terms", outputCol="history_vector"
        )
        join = VectorAssembler(inputCols=[*plain, "history_vector"], outputCol=output)
        return [terms, join], plain + history
    return [VectorAssembler(inputCols=features, outputCol=output)], features


def scale_stages(vectors: DataFrame, source: str, output: str, n: int, center: bool) -> list[Transformer]:
    """Fit population scaling in one pass over the vectors.

    The library's scaler uses the sample deviation and maps a constant column to 0, so only its
    centring is used, and the factors are applied as a stage of their own. Without centring a
    sparse vector stays sparse; a linear model with an intercept fits the same either way.
    """
    model = StandardScaler(
        withMean=True, withStd=False, inputCol=source, outputCol="centered" if center else output
    ).fit(vectors)
    shrink = ((n - 1) / n) ** 0.5 if n > 1 else 0.0
    mean = model.mean.toArray()
    deviation = model.std.toArray() * shrink
    constant = deviation <= 1e-12 * np.maximum(1.0, np.abs(mean))
    factors = Vectors.dense(np.where(constant, 1.0, 1.0 / np.where(constant, 1.0, deviation)))
    scale = ElementwiseProduct(
        scalingVec=factors, inputCol="centered" if center else source, outputCol=output
    )
    return [model, scale] if center else [scale]


def _run(stages: Iterable[Transformer], df: DataFrame) -> DataFrame:
    """The stages in turn; one whose output `df` already holds is not run again."""
    given = set(df.columns)
    for stage in stages:
        if not (stage.hasParam("outputCol") and stage.getOrDefault("outputCol") in given):
            df = stage.transform(df)
    return df


def assembled(df: DataFrame, features: Sequence[str], keep: Iterable[str]) -> DataFrame:
    """The kept columns and the assembled vector, sparse where that is smaller: what the fits
    below read, for holding in memory when several of them follow."""
    stages, _ = input_stages(df, features)
    return _run(stages, df).select(*keep, "assembled")


def _vectors(
    df: DataFrame, features: Sequence[str], n: int, scale: bool, center: bool
) -> tuple[list[Transformer], list[str]]:
    """Input stages, with scaling if asked for; the vector is in column `vector`."""
    if not scale:
        return input_stages(df, features, "vector")
    stages, names = input_stages(df, features)
    return stages + scale_stages(_run(stages, df), "assembled", "vector", n, center), names


def _bundle(name, names, stages, outputs, kind="probability", notes=None) -> Bundle:
    return Bundle(name, list(names), PipelineModel(stages), outputs, kind, notes or {})


# --- classifiers -----------------------------------------------------------------


def fit_logreg(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    C: float = 1.0,
    balanced: bool = False,
    scale: bool = True,
    name: str = "logistic_regression",
) -> Bundle:
    """L2 logistic regression; `C` weighs the summed loss against the penalty."""
    n = df.count()
    stages, names = _vectors(df, features, n, scale, center=False)
    rows = with_class_weight(df, label) if balanced else df
    model = LogisticRegression(
        featuresCol="vector", labelCol=label, regParam=1.0 / (C * n), elasticNetParam=0.0,
        standardization=False, maxIter=LOGREG_ITERATIONS, tol=LINEAR_TOLERANCE,
    )
    if balanced:
        model.setWeightCol("weight")
    return _bundle(name, names, [*stages, model.fit(_run(stages, rows))], ["probability"])


def logreg_gradient(bundle: Bundle, df: DataFrame, label: str, C: float = 1.0, balanced: bool = False) -> np.ndarray:
    """The gradient of the stated objective per coefficient and, last, for the intercept.

    It is zero at the optimum. Tasks sum their rows; one vector per task moves.
    """
    *stages, model = bundle.pipeline.stages
    w, b = model.coefficients.toArray(), model.intercept
    rows = _run(stages, with_class_weight(df, label) if balanced else df.withColumn("weight", F.lit(1.0)))
    vectors = rows.select(vector_to_array("vector").alias("x"), F.col(label).cast("double").alias("y"), "weight")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n, weight = np.zeros(len(w) + 1), 0, 0.0
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                error = (1 / (1 + np.exp(-(x @ w + b))) - batch["y"]) * batch["weight"]
                total += np.append(x.T @ error, error.sum())
                n += len(batch)
                weight += batch["weight"].sum()
        yield pd.DataFrame({"g": [total.tolist()], "n": [n], "weight": [weight]})

    parts = vectors.mapInPandas(partial, "g array<double>, n long, weight double")
    sums = parts.agg(
        *[F.sum(F.get("g", i)).alias(f"g{i}") for i in range(len(w) + 1)], F.sum("n").alias("n"),
        F.sum("weight").alias("weight"),
    ).first()
    mean = np.array(sums[: len(w) + 1]) / sums["weight"]
    return mean + np.append(w, 0.0) / (C * sums["n"])


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    trees: int = FOREST_TREES,
    depth: int = FOREST_DEPTH,
    name: str = "random_forest",
    key: str | None = None,
    max_fit_rows: int | None = None,
) -> Bundle:
    """Random forest on unscaled features with balanced class weights.

    With `max_fit_rows` (and a `key`) at most so many rows are fitted on, each class in proportion.
    """
    df, notes = _bounded(df, key, label, max_fit_rows)
    stages, names = input_stages(df, features)
    model = RandomForestClassifier(
        featuresCol="assembled", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth,
        featureSubsetStrategy="sqrt", seed=SEED, maxMemoryInMB=FOREST_STATISTICS_MB, cacheNodeIds=False,
    ).fit(_run(stages, with_class_weight(df, label)))
    return _bundle(name, names, [*stages, model], ["probability"], notes=notes)


def _bounded(df: DataFrame, key: str | None, label: str, max_fit_rows: int | None) -> tuple[DataFrame, dict]:
    """The rows to fit on, and their number if it was bounded."""
    if max_fit_rows is None:
        return df, {}
    if key is None:
        raise ValueError("max_fit_rows needs a key to choose rows by")
    rows = fit_sample(df, key, label, max_fit_rows, SEED)
    return rows, {"fit_rows": rows.count()}


def fit_calibrated_svm(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    C: float = 1.0,
    folds: int = CALIBRATION_FOLDS,
    parallel: int = 1,
    name: str = "support_vector_machine",
) -> Bundle:
    """Balanced linear SVM per fold, its margin mapped to a probability on the fold left out.

    The machines have the squared hinge and are fitted for all folds at once. The sigmoid is fitted to smoothed
    targets (Platt): a fractional target t is a row of each class with weights t and 1 - t. The score is the mean
    over the folds, each of which has its share of both classes. `parallel` sigmoids are fitted at a time.
    """
    n = df.count()
    stages, names = _vectors(df, features, n, scale=True, center=False)
    rows = _svm_rows(df, stages, label, key, folds).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = {r["_fold"]: r for r in rows.groupBy("_fold").agg(
            F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg")
        ).collect()}
        order = sorted(sizes)
        data = margin_rows(rows, "vector", "_y", "weight", "_fold")
        machines = fit_margins(data, len(names), order, C, SVM_TOLERANCE, SVM_STEPS)

        def fit_fold(k: int) -> list[Transformer]:
            weights = machines[order.index(k)].weights
            svm = margin_model(df.sparkSession, weights, f"LinearSVC_{uuid.uuid4().hex[:12]}", "vector", f"margin_{k}", f"side_{k}")
            held = svm.transform(rows.filter(F.col("_fold") == k))
            sigmoid = LogisticRegression(
                featuresCol=f"margin_{k}", labelCol="_t", weightCol="_w", rawPredictionCol=f"logit_{k}",
                probabilityCol=f"probability_{k}", predictionCol=f"class_{k}",
            ).fit(_platt_rows(held, f"margin_{k}", sizes[k]["pos"], sizes[k]["neg"]))
            return [svm, sigmoid]

        with ThreadPoolExecutor(parallel) as pool:
            fitted = list(pool.map(inheritable_thread_target(df.sparkSession)(fit_fold), order))
    finally:
        rows.unpersist()
    outputs = [f"probability_{k}" for k in order]
    return _bundle(name, names, [*stages, *[m for pair in fitted for m in pair]], outputs)


def _svm_rows(df: DataFrame, stages: Sequence[Transformer], label: str, key: str, folds: int) -> DataFrame:
    folded = stratified_folds(df, key, label, folds, "_fold", SEED)
    return _run(stages, with_class_weight(folded, label)).select(
        F.col("vector"), F.col(label).alias("_y"), "weight", "_fold"
    )


def svm_gradients(
    bundle: Bundle, df: DataFrame, label: str, key: str, C: float = 1.0, folds: int = CALIBRATION_FOLDS
) -> list[np.ndarray]:
    """Per fold the gradient of its machine's objective at the fitted coefficients, per unit of the rows' weight.

    It is zero at the optimum.
    """
    stages = bundle.pipeline.stages
    machines = stages[len(stages) - 2 * folds :: 2]
    rows = _svm_rows(df, stages[: len(stages) - 2 * folds], label, key, folds)
    data = margin_rows(rows, "vector", "_y", "weight", "_fold")
    weights = np.stack([np.append(m.coefficients.toArray(), m.intercept) for m in machines])
    return margin_gradients(data, weights, range(folds), C)


def _platt_rows(held: DataFrame, margin: str, pos: int, neg: int) -> DataFrame:
    target = F.when(F.col("_y") == 1, (pos + 1.0) / (pos + 2.0)).otherwise(1.0 / (neg + 2.0))
    sides = F.array(
        F.struct(F.lit(1).alias("_t"), target.alias("_w")),
        F.struct(F.lit(0).alias("_t"), (1 - target).alias("_w")),
    )
    return held.select(margin, F.inline(sides))


def fit_mlp(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    hidden: Sequence[int] = MLP_HIDDEN,
    iterations: int = MLP_ITERATIONS,
    scale: bool = True,
    before: Sequence[Transformer] = (),
    name: str = "mlp_classifier",
    key: str | None = None,
    max_fit_rows: int | None = None,
    width: int | None = None,
) -> Bundle:
    """Multilayer perceptron on standardised features, or on those the `before` stages leave, fitted by L-BFGS.

    Every iteration reads every row, from blocks packed once; the sums are made in the tasks. `notes` holds the
    iterations' losses and whether it was done before the last. With `max_fit_rows` (and a `key`) at most so many rows are
    fitted on, each class in proportion. `width` is the vector's length where features are vectors.
    """
    df, notes = _bounded(df, key, label, max_fit_rows)
    n = df.count() if scale else 0
    prepared = _run(before, df)
    stages, names = _vectors(prepared, features, n, scale, center=True)
    vectors = _run(stages, prepared)
    layers = [width or len(names), *hidden, 2]
    trained = fit_network(vectors, "vector", label, layers, iterations, SEED)
    model = network_model(df.sparkSession, trained.weights, layers)
    notes |= {"losses": trained.losses, "stopped": trained.stopped}
    return _bundle(name, names, [*before, *stages, model], ["probability"], notes=notes)


def fit_balanced_mlp(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: str,
    hidden: Sequence[int] = BALANCED_MLP_HIDDEN,
    iterations: int = BALANCED_MLP_ITERATIONS,
    exact: bool = True,
    quartiles_from: DataFrame | None = None,
    name: str = "mlp_classifier",
) -> Bundle:
    """Perceptron on robustly scaled features, the minority class drawn up to the majority.

    Trained in rounds of five passes with an L2 term; a tenth of the keys is set aside, training stops when their
    loss has not fallen for three rounds, and the best round's weights are kept. `iterations` bounds the passes.
    `notes` holds the rounds' losses, the best one, and whether it stopped early. `quartiles_from` is the same rows as `assembled` leaves them, if those are at hand.
    """
    if "history_terms" in df.columns:
        df = align_inputs(df, features, [c for c in (key, label) if c not in features])
    vector = None if quartiles_from is None else vector_to_array("assembled")
    robust = RobustScale.fit(df if vector is None else quartiles_from, features, exact, vector)
    stage, columns = robust_stage(robust)
    balanced = upsample_minority(df, key, label, SEED)
    stages, _ = _vectors(_run([stage], balanced), columns, 0, scale=False, center=True)
    plan = Schedule(
        -(-iterations // BALANCED_MLP_PASSES), BALANCED_MLP_RATE, BALANCED_MLP_PENALTY, passes=BALANCED_MLP_PASSES,
        patience=BALANCED_MLP_PATIENCE, seed=SEED,
    )
    layers = [len(columns), *hidden, 2]
    held = held_by_key(key, plan.held_share, SEED)
    trained = train_network(_run([stage, *stages], balanced), "vector", label, held, layers, plan)
    model = network_model(df.sparkSession, trained.weights, layers)
    notes = {"losses": trained.losses, "best": trained.best, "stopped": trained.stopped}
    fitted = _bundle(name, columns, [stage, *stages, model], ["probability"], notes=notes)
    fitted.features, fitted.inputs = list(features), list(features)
    return fitted


def robust_stage(scaling) -> tuple[SQLTransformer, list[str]]:
    """A column scaling as a pipeline stage; columns it leaves as they are keep their name."""
    cells, columns = [], []
    for c, center, scale in zip(scaling.cols, scaling.centers, scaling.scales):
        if center == 0.0 and scale == 1.0:
            columns.append(c)
        else:
            columns.append(f"{c}_robust")
            cells.append(f"(`{c}` - {center!r}D) / {scale!r}D AS `{c}_robust`")
    return SQLTransformer(statement=f"SELECT {', '.join(['*', *cells])} FROM __THIS__"), columns


# --- latent features ---------------------------------------------------------------


@dataclass
class Latent:
    """Stages from columns to a latent vector in column `output`.

    `basis` has a direction per latent as its columns, `variances` what each accounts for.
    """

    stages: list[Transformer]
    features: list[str]
    output: str
    k: int
    basis: np.ndarray
    variances: np.ndarray

    def encode(self, df: DataFrame) -> DataFrame:
        """`df` with the latent vector; what the stages need on the way is dropped."""
        return _run(self.stages, df).select(*df.columns, self.output)


def fit_latent(
    df: DataFrame, features: Sequence[str], k: int = FULL_LATENTS, output: str = "tab_latent"
) -> Latent:
    """The first `k` principal components of the standardised features.

    The Gram matrix is summed on the executors; only its features x features total leaves them.
    """
    stages, names = _vectors(df, features, df.count(), scale=True, center=True)
    pca = PCA(k=k, inputCol="vector", outputCol=output).fit(_run(stages, df))
    return Latent([*stages, pca], names, output, k, pca.pc.toArray(), pca.explainedVariance.toArray())


def window_moments(flags: np.ndarray, width: int = HISTORY_WINDOW) -> tuple[np.ndarray, int]:
    """What the outer products of all histories say of the outer products of their windows.

    `flags` is the sum of outer products of history flags with a constant 1 before them. A window is `width`
    positions next to each other, of which some may lie before the first or after the last position. Returns
    the windows' summed outer products (with the constant) and the number of windows of one history.
    """
    codes, positions = len(S.HISTORY_CODES), S.HISTORY_POSITIONS
    total = np.zeros((1 + width * codes, 1 + width * codes))
    starts = range(1 - width, positions)
    for at in starts:
        # Which flag (or the constant) each entry of the window is; none beyond the edges.
        entry = [0] + [
            1 + (at + j) * codes + c if 0 <= at + j < positions else -1 for j in range(width) for c in range(codes)
        ]
        here = np.array(entry) >= 0
        total[np.ix_(here, here)] += flags[np.ix_(np.array(entry)[here], np.array(entry)[here])]
    return total, len(starts)


def fit_history_latent(
    df: DataFrame, k: int = HISTORY_LATENTS, output: str = "hist_latent", width: int = HISTORY_WINDOW
) -> Latent:
    """`k` filters over windows of positions, shared by all positions, and their mean responses as the latents.

    The filters are the principal directions of all windows of all histories. One pass sums the histories' outer
    products on the executors; the windows' follow from them. A response is a sigmoid of the filtered window in units
    of its spread, so that the mean keeps what stands next to what and not only how often each code occurs.
    A history that is moved inside its positions has the same latents. The filters run as one layer of the
    library's perceptron, whose weights are the filters at every place, and the mean is its second layer.
    """
    stages, names = input_stages(df, S.HISTORY_FEATURES, f"{output}_flags")
    n, sums, outer = second_moments(_run(stages, df), f"{output}_flags")
    whole = np.block([[np.array([[float(n)]]), sums[None, :]], [sums[:, None], outer]])
    moments, places = window_moments(whole, width)
    mean = moments[0, 1:] / max(n * places, 1)
    spread = moments[1:, 1:] / max(n * places, 1) - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(spread)
    order = np.argsort(-values, kind="stable")[:k]
    filters, variances = vectors[:, order], np.maximum(values[order], 0.0)
    # A direction and its opposite are the same; the larger side is taken as positive.
    filters = filters * np.where(np.abs(filters.min(0)) > filters.max(0), -1.0, 1.0)
    scale = np.where(variances > 1e-12, 1.0 / np.sqrt(np.maximum(variances, 1e-12)), 1.0)
    codes, positions = len(S.HISTORY_CODES), S.HISTORY_POSITIONS
    first = np.zeros((positions * codes, places * k))
    for place in range(places):
        for j in range(width):
            at = place + 1 - width + j
            if 0 <= at < positions:
                first[at * codes : (at + 1) * codes, place * k : (place + 1) * k] = (
                    filters[j * codes : (j + 1) * codes] * scale
                )
    bias = np.tile(-(mean @ filters) * scale, places)
    average = np.tile(np.eye(k) / places, (places, 1))
    weights = np.concatenate((first.ravel(), bias, average.ravel(), np.zeros(k)))
    model = network_model(
        df.sparkSession, weights, [positions * codes, places * k, k], f"{output}_flags", rawPredictionCol=output,
        probabilityCol=f"{output}_shares", predictionCol=f"{output}_largest",
    )
    return Latent([*stages, model], names, output, k, filters, variances)


@dataclass
class Autoencoder:
    """A latent that is no line: what encodes it, the whole network's layers and weights, its held-out losses."""

    latent: Latent
    layers: list[int]
    weights: np.ndarray
    losses: list[float]


def fit_autoencoder(
    df: DataFrame, features: Sequence[str], key: str, k: int = FULL_LATENTS, hidden: int = AUTOENCODER_HIDDEN,
    rounds: int = AUTOENCODER_EPOCHS, output: str = "tab_latent", plan: Schedule | None = None,
) -> Autoencoder:
    """Latents of a network that gives back the standardised features through `k` units.

    The layers are inputs, `hidden`, `k`, `hidden`, inputs. The network is trained in rounds with a share of the keys set
    aside, and the best round is kept. The latents are what the `k` units take in, and are computed by the first
    two layers as the library's perceptron.
    """
    stages, names = _vectors(df, features, df.count(), scale=True, center=True)
    plan = plan or Schedule(rounds, rate=3e-3, penalty=0.0, batch=32, passes=BALANCED_MLP_PASSES, seed=SEED)
    layers = [len(names), hidden, k, hidden, len(names)]
    rows = _run(stages, df)
    trained = train_network(rows, "vector", None, held_by_key(key, plan.held_share, SEED), layers, replace(plan, goal=SELF))
    encoder = layers[:3]
    model = network_model(
        df.sparkSession, trained.weights[: n_weights(encoder)], encoder, rawPredictionCol=output,
        probabilityCol=f"{output}_shares", predictionCol=f"{output}_largest",
    )
    latent = Latent([*stages, model], names, output, k, np.zeros((0, 0)), np.zeros(0))
    return Autoencoder(latent, layers, trained.weights, trained.losses)


def autoencoder_error(df: DataFrame, fitted: Autoencoder) -> float:
    """Mean squared error over all rows and standardised features."""
    vectors = _run(fitted.latent.stages[:-1], df).select(vector_to_array("vector").alias("x"))
    layers, weights = fitted.layers, fitted.weights

    def partial(batches: Iterator) -> np.ndarray:
        out = np.zeros(2)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                out += [losses(weights, layers, x, x, SELF).sum(), len(x)]
        return out

    total, n = summed(vectors, 2, partial)
    return float(total / n) if n else 0.0


def fit_on_latents(
    df: DataFrame, latents: Sequence[Latent], label: str, hidden: Sequence[int] | None = None,
    name: str = "latent", iterations: int = MLP_ITERATIONS,
) -> Bundle:
    """A classifier on one or more latent vectors side by side: logistic regression, or a
    perceptron if `hidden` is given."""
    encoded = df
    for latent in latents:
        encoded = latent.encode(encoded)
    columns = [latent.output for latent in latents]
    if hidden is None:
        head = fit_logreg(encoded, columns, label, scale=False, name=name)
    else:
        head = fit_mlp(
            encoded, columns, label, hidden, iterations, scale=False, name=name,
            width=sum(latent.k for latent in latents),
        )
    stages = [s for latent in latents for s in _own_columns(latent)] + list(head.pipeline.stages)
    names = [f"{latent.output}_{i}" for latent in latents for i in range(latent.k)]
    return Bundle(name, names, PipelineModel(stages), head.outputs, head.kind, head.notes)


def _own_columns(latent: Latent) -> list[Transformer]:
    """The latent's stages, writing their intermediate vectors under names of their own."""
    out, renamed = [], {}
    for stage in latent.stages:
        copy = stage.copy()
        for param in ("inputCol", "inputCols", "featuresCol", "outputCol"):
            if not copy.hasParam(param) or not copy.isDefined(param):
                continue
            value = copy.getOrDefault(param)
            if param == "inputCols":
                copy._set(inputCols=[renamed.get(v, v) for v in value])
            elif param in ("inputCol", "featuresCol"):
                copy._set(**{param: renamed.get(value, value)})
            elif value != latent.output:
                renamed[value] = f"{latent.output}_{value}"
                copy._set(outputCol=renamed[value])
        out.append(copy)
    return out


def fit_hybrid(
    df: DataFrame, label: str, tabular_k: int = TABULAR_LATENTS, history_k: int = HISTORY_LATENTS
) -> Bundle:
    """Logistic regression on tabular and history latents together."""
    latents = [
        fit_latent(df, S.TABULAR_FEATURES, tabular_k), fit_history_latent(df, history_k),
    ]
    return fit_on_latents(df, latents, label, name="hybrid")


def reconstruction_error(df: DataFrame, latent: Latent) -> DataFrame:
    """Mean squared error per input column when only the first 1..k components are kept.

    From the second moments of the rows, which one pass sums on the executors: what a projection leaves of them
    is on their diagonal.
    """
    source = latent.stages[-1].getInputCol()
    n, _, outer = second_moments(_run(latent.stages[:-1], df), source)
    rows, rest = [], outer / max(n, 1)
    for i in range(latent.k if n else 0):
        side = np.eye(len(rest)) - np.outer(latent.basis[:, i], latent.basis[:, i])
        rest = side @ rest @ side.T
        rows += [(i + 1, c, max(float(e), 0.0)) for c, e in zip(latent.features, np.diag(rest))]
    # Components times columns rows.
    return df.sparkSession.createDataFrame(rows, "components int, column_name string, mse double")


def direct_reconstruction_error(df: DataFrame, latent: Latent) -> DataFrame:
    """The same by reconstructing every row: each task reduces its rows to one sum per (components kept, column)."""
    source, basis, k, names = latent.stages[-1].getInputCol(), latent.basis, latent.k, latent.features

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        errors, n = np.zeros((k, len(names))), 0
        for batch in batches:
            if not len(batch):
                continue
            rest = np.stack(batch["x"].to_numpy())
            scores = rest @ basis
            for i in range(k):
                rest = rest - np.outer(scores[:, i], basis[:, i])
                errors[i] += np.square(rest).sum(axis=0)
            n += len(batch)
        if n:
            yield pd.DataFrame({
                "components": np.repeat(np.arange(1, k + 1), len(names)),
                "column_name": names * k,
                "sse": errors.ravel(),
                "n": n,
            })

    vectors = _run(latent.stages[:-1], df).select(vector_to_array(source).alias("x"))
    sums = vectors.mapInPandas(partial, "components int, column_name string, sse double, n long")
    return sums.groupBy("components", "column_name").agg(
        (F.sum("sse") / F.sum("n")).alias("mse")
    )


# --- inspection ----------------------------------------------------------------------


def _ranked(spark: SparkSession, names: Sequence[str], values: Iterable[float], top: int) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(names, values)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top)


def top_coefficients(bundle: Bundle, top: int = TOP_FEATURES) -> DataFrame:
    """Features with the largest absolute coefficients of a linear model."""
    model = bundle.pipeline.stages[-1]
    values = np.abs(model.coefficients.toArray())
    return _ranked(SparkSession.active(), bundle.features, values, top)


def top_input_weights(bundle: Bundle, top: int = TOP_FEATURES) -> DataFrame:
    """Inputs with the largest mean absolute first-layer weight of a perceptron."""
    model = bundle.pipeline.stages[-1]
    width, first = model.getLayers()[:2]
    # The first width * first weights are the input layer, all of one input's weights together.
    weights = np.asarray(model.weights.toArray()[: width * first]).reshape(width, first)
    return _ranked(SparkSession.active(), bundle.features, np.abs(weights).mean(axis=1), top)


# --- scoring -----------------------------------------------------------------------------


def score_all(bundles: Sequence[Bundle], df: DataFrame, key: str, label: str) -> DataFrame:
    """(key, model, label, score) for every model, from one pass over the rows."""
    if not bundles:
        raise ValueError("no models to score with")
    scored = df
    for i, bundle in enumerate(bundles):
        scored = bundle.add_score(scored, f"_score_{i}")
    cells = F.array(*[
        F.struct(F.lit(b.name).alias("model"), F.col(f"_score_{i}").alias("score"))
        for i, b in enumerate(bundles)
    ])
    return scored.select(
        F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.inline(cells)
    ).select("key", "model", "label", "score")


def slug(name: str) -> str:
    return re.sub(r"\W+", "_", name.lower())


def save_bundles(bundles: Sequence[Bundle], path: str) -> None:
    """Stages, feature and input lists and score rule of each model below one folder."""
    spark = SparkSession.active()
    for b in bundles:
        b.pipeline.write().overwrite().save(f"{path}/stages/{slug(b.name)}")
        card = [(b.name, b.kind, b.outputs, b.features, b.inputs)]
        schema = (
            "name string, kind string, outputs array<string>, features array<string>,"
            " inputs array<string>"
        )
        spark.createDataFrame(card, schema).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/cards/{slug(b.name)}"
        )


def load_bundles(spark: SparkSession, path: str) -> list[Bundle]:
    """Every model saved below a folder; an error if there is none."""
    cards = spark.read.parquet(f"{path}/cards/*").orderBy("name").collect()
    if not cards:
        raise FileNotFoundError(f"no models below {path}")
    return [
        Bundle(c["name"], list(c["features"]), PipelineModel.load(f"{path}/stages/{slug(c['name'])}"),
               list(c["outputs"]), c["kind"], inputs=list(c["inputs"]))
        for c in cards
    ]
