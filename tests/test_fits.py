"""Fits summed over tasks against NumPy on one machine."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from sessionloom import schemas as S
from sessionloom.checks import modelling
from sessionloom.checks.modelling import FAMILY, _stays_when_shifted
from sessionloom.operators import features as V
from sessionloom.operators import margins as G
from sessionloom.operators import models as M
from sessionloom.operators import networks as N
from sessionloom.operators import partial_sums as Q
from sessionloom.operators import prepare as P
from sessionloom.operators.scaling import exact_quartiles


@pytest.fixture(scope="module")
def compact(raw):
    return P.build_binary_label(V.compact_view(raw)).persist()


def frame(spark, x, y, parts=5):
    rows = [(f"k{i}", [float(v) for v in a], int(b), i % 3) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "uid string, x array<double>, y int, fold int").repartition(parts)
    return df.select("uid", array_to_vector("x").alias("vector"), "y", "fold")


def rings(seed, n, spread=0.15):
    """Two classes that no line separates."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    turn, far = rng.uniform(0, 2 * np.pi, n), 1.0 + 2.0 * y + spread * rng.normal(size=n)
    return np.column_stack((far * np.cos(turn), far * np.sin(turn))), y


def test_sums_over_tasks_and_pieces(spark):
    df = spark.range(1000, numPartitions=7)
    size = 3 * Q.PIECE + 5

    def partial(batches):
        out = np.zeros(size)
        for b in batches:
            for i in b.column(0).to_pylist():
                out[i::1000] += i
        return out

    want = np.arange(size) % 1000.0
    assert (Q.summed(df, size, partial) == want).all()
    assert (Q.summed(df.limit(0), 4, lambda b: np.zeros(4) + sum(x.num_rows for x in b)) == 0).all()


def test_second_moments(spark):
    x = np.random.default_rng(1).normal(size=(200, 6))
    n, total, outer = Q.second_moments(frame(spark, x, np.zeros(200)), "vector")
    assert n == 200 and np.allclose(total, x.sum(0)) and np.allclose(outer, x.T @ x)
    assert Q.second_moments(frame(spark, x, np.zeros(200)).limit(0), "vector")[0] == 0


def test_margins_are_at_the_optimum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 4)) * [1, 3, 0.2, 1]
    y = (x[:, 0] - x[:, 1] + rng.normal(size=240) > 0).astype(int)
    weight = np.where(y == 1, 1.5, 0.75)
    df = frame(spark, x, y).withColumn("weight", F.when(F.col("y") == 1, 1.5).otherwise(0.75))
    rows = G.margin_rows(df, "vector", "y", "weight", "fold")
    fitted = G.fit_margins(rows, 4, [0, 2, None], 0.7, 1e-9, 100)
    one, fold = np.column_stack((x, np.ones(240))), np.arange(240) % 3

    def objective(w, use):
        rest = np.maximum(0, 1 - (2 * y - 1) * (one @ w))
        return w @ w / 2 + 0.7 * (weight * rest**2)[use].sum()

    for machine, use in zip(fitted, [fold != 0, fold != 2, fold >= 0]):
        w, at = machine.weights, objective(machine.weights, use)
        rest = np.maximum(0, 1 - (2 * y - 1) * (one @ w))
        assert np.abs(w - 2 * 0.7 * one[use].T @ (weight * (2 * y - 1) * rest)[use]).max() < 1e-5
        assert machine.gradient < 1e-9
        assert all(objective(w + 1e-3 * d, use) >= at for d in rng.normal(size=(50, 5)))
    assert not np.allclose(fitted[0].weights, fitted[2].weights)


def test_steps_read_packed_rows(spark):
    """A block holds the entries other than zero of the columns that occur, whatever the vectors' width."""
    x = np.zeros((6000, 300))
    x[np.arange(6000), np.arange(6000) % 7] = np.arange(6000) + 1.0
    y = np.arange(6000) % 2
    df = frame(spark, x, y, 2).withColumn("weight", F.lit(1.0))
    packed = G.packed_rows(G.margin_rows(df, "vector", "y", "weight", "fold"))
    length = sum(F.length(n) for n, _ in G.PACKED)
    assert packed.agg(F.sum(length)).first()[0] < 6000 * 60
    found = list(G._blocks(packed.toArrow().to_batches()))
    back = np.zeros(301)
    for used, rows, *_ in found:
        back[used] += rows.sum(0)
    assert np.allclose(back, np.append(x.sum(0), 6000.0))
    assert sum(len(side) for *_, side, _, _ in found) == 6000


def test_margin_model_scores_and_survives_saving(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(20, 3))
    df = frame(spark, x, np.zeros(20))
    w = np.array([0.5, -2.0, 1.0, 0.25])
    model = G.margin_model(spark, w, "LinearSVC_test", "vector", "margin_0", "side_0")
    PipelineModel([model]).save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    for m in (model, loaded):
        got = {r.uid: r.m for r in m.transform(df).select("uid", vector_to_array("margin_0")[1].alias("m")).collect()}
        assert all(got[f"k{i}"] == pytest.approx(a @ w[:3] + w[3]) for i, a in enumerate(x))


def test_svm_bundle_is_at_its_optimum(compact):
    bundle = M.fit_calibrated_svm(compact, S.TABULAR_FEATURES, FAMILY, "uid")
    found = M.svm_gradients(bundle, compact, FAMILY, "uid")
    assert len(found) == 3 and max(np.abs(g).max() for g in found) < 1e-5
    moved = bundle.pipeline.stages[-2]
    w = np.append(moved.coefficients.toArray() + 0.1, moved.intercept)
    bundle.pipeline.stages[-2] = G.margin_model(compact.sparkSession, w, "LinearSVC_x", "vector", "margin_2", "side_2")
    assert np.abs(M.svm_gradients(bundle, compact, FAMILY, "uid")[2]).max() > 1e-3


def test_network_gradient_by_differences():
    rng = np.random.default_rng(4)
    layers, x, y = [3, 5, 4, 3], rng.normal(size=(9, 3)), rng.integers(0, 3, 9)
    w = N.first_weights(layers, 1)
    matrices = lambda v: sum((m**2).sum() for m, _ in N.split_weights(v, layers))
    f = lambda v: N.losses(v, layers, x, y).mean() + 0.3 / (2 * 9) * matrices(v)
    got = N.gradient(w, layers, x, y, 0.3)
    for k in range(0, len(w), 3):
        step = np.zeros(len(w))
        step[k] = 1e-6
        assert got[k] == pytest.approx((f(w + step) - f(w - step)) / 2e-6, abs=1e-6)


def test_network_stops_before_its_budget_and_keeps_the_best_round(spark):
    x, y = rings(5, 1200)
    held = N.held_by_key("uid", 0.2, 1)
    plan = N.Schedule(400, rate=0.02, penalty=1e-3, batch=32, patience=6)
    df = frame(spark, x, y)
    out = N.train_network(df, "vector", "y", held, [2, 16, 2], plan)
    assert out.stopped and len(out.losses) < 400
    assert out.losses[out.best] == min(out.losses) < 0.1
    rows = df.withColumn("held", held).filter("held").select(vector_to_array("vector").alias("x"), "y").collect()
    judged = N.losses(out.weights, [2, 16, 2], np.array([r.x for r in rows]), np.array([r.y for r in rows])).mean()
    assert judged == pytest.approx(min(out.losses)) and 150 < len(rows) < 330
    model = N.network_model(spark, out.weights, [2, 16, 2])
    wrong = model.transform(df).filter("cast(prediction as int) <> y").count()
    assert wrong < 40


def test_penalty_shrinks_weights_and_tasks_are_averaged(spark):
    x, y = rings(6, 900)
    sizes = []
    for penalty in (0.0, 3.0):
        plan = N.Schedule(12, rate=0.01, penalty=penalty, batch=4)
        out = N.train_network(frame(spark, x, y, 4), "vector", "y", F.lit(False), [2, 8, 2], plan)
        assert out.losses[out.best] < out.losses[0]
        sizes.append(np.square(out.weights).sum())
    assert sizes[1] < sizes[0]


def test_reconstruction_error_from_second_moments(compact):
    latent = M.fit_latent(compact, S.TABULAR_FEATURES, 5)
    for rows in (compact, compact.filter("source_file = 'capture_1.csv'")):
        a = {(r.components, r.column_name): r.mse for r in M.reconstruction_error(rows, latent).collect()}
        b = {(r.components, r.column_name): r.mse for r in M.direct_reconstruction_error(rows, latent).collect()}
        assert len(a) == 5 * 51 and a == pytest.approx(b, abs=1e-9)
    assert M.reconstruction_error(compact.limit(0), latent).count() == 0


def test_window_moments_by_brute_force():
    rng = np.random.default_rng(7)
    codes, positions = len(S.HISTORY_CODES), S.HISTORY_POSITIONS
    x = (rng.random((40, positions * codes)) < 0.05).astype(float)
    windows = []
    for row in x.reshape(40, positions, codes):
        padded = np.vstack((np.zeros((2, codes)), row, np.zeros((2, codes))))
        windows += [np.append(1.0, padded[at : at + 3].ravel()) for at in range(positions + 2)]
    windows = np.array(windows)
    flags = np.column_stack((np.ones(40), x))
    got, places = M.window_moments(flags.T @ flags, 3)
    want = windows.T @ windows
    want[0, 0] = got[0, 0]
    assert places == positions + 2 and got[0, 0] == 40 * places and np.allclose(got, want)


def test_history_latents_share_their_filters(spark, compact):
    latent = M.fit_history_latent(compact)
    assert latent.basis.shape == (63, 2) and np.allclose(latent.basis.T @ latent.basis, np.eye(2))
    assert _stays_when_shifted(latent, compact)
    terms = lambda *codes: [f"history_{i}_{c}" for i, c in enumerate(codes, 1)]
    rows = spark.createDataFrame([(0, terms("ss", "h", "a")), (1, terms("a", "h", "ss")), (2, [])], "k int, history_terms array<string>")
    z = {r.k: np.array(r.z) for r in latent.encode(rows).select("k", vector_to_array("hist_latent").alias("z")).collect()}
    weights = latent.stages[-1].weights.toArray()
    bias = weights[252 * 28 : 252 * 28 + 2]
    at = {f"history_1_{c}": k for k, (_, c) in enumerate(S.HISTORY_CODES)}
    for k, codes in enumerate([("ss", "h", "a"), ("a", "h", "ss"), ()]):
        flags = np.zeros((16, 21))
        for i, c in enumerate(codes):
            flags[2 + i, at[f"history_1_{c}"]] = 1.0
        scale = 1 / np.sqrt(latent.variances)
        windows = np.array([flags[i : i + 3].ravel() for i in range(14)])
        assert z[k] == pytest.approx((1 / (1 + np.exp(-(windows @ latent.basis * scale + bias)))).mean(0), abs=1e-9)
    assert np.abs(z[0] - z[2]).max() > 1e-3
    bundle = M.fit_hybrid(compact, FAMILY)
    assert bundle.add_score(compact).filter("score between 0 and 1").count() == compact.count()


@pytest.mark.parametrize("n,most", [(1, 1000), (7, 1000), (99, 1000), (400, 1000), (5000, 1000), (30_000, 1000), (30_000, 5)])
def test_quartiles_by_brackets(spark, n, most):
    """Against NumPy, with hot values, gaps, columns without values, and brackets that must be narrowed."""
    rng = np.random.default_rng(n + most)
    x = np.column_stack((
        rng.normal(size=n) * 1e6, rng.integers(0, 2, n), np.where(rng.random(n) < 0.4, 7.5, rng.normal(size=n)),
        np.full(n, 3.0), rng.integers(0, 50, n), np.where(rng.random(n) < 0.9, 0.0, rng.exponential(size=n)),
    ))
    gaps = rng.random(n) < 0.3
    rows = [([*map(float, a), None if g else float(a[0]), None, float("nan") if g else 1.0 * float(a[4])],) for a, g in zip(x, gaps)]
    df = spark.createDataFrame(rows, "v array<double>").repartition(5)
    got = exact_quartiles(df, F.col("v"), 9, most)
    for c in range(6):
        assert got[c] == pytest.approx(np.percentile(x[:, c], [25, 50, 75]).tolist(), rel=1e-12)
    if (~gaps).any():
        assert got[6] == pytest.approx(np.percentile(x[~gaps, 0], [25, 50, 75]).tolist(), rel=1e-12)
        assert got[8] == pytest.approx(np.percentile(x[~gaps, 4], [25, 50, 75]).tolist(), rel=1e-12)
    assert 7 not in got and exact_quartiles(df.limit(0), F.col("v"), 9) == {}


def test_quartiles_need_no_sort_and_two_scans(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(50_000).select(F.array(F.col("id").cast("double"), (F.col("id") % 3).cast("double")).alias("v"))
    got = exact_quartiles(df.mapInArrow(counted, df.schema), F.col("v"), 2)
    assert got == {0: [12499.75, 24999.5, 37499.25], 1: [0.0, 1.0, 2.0]} and read.value == 100_000


def test_autoencoder_beats_the_linear_form_on_a_curve(spark):
    """One latent for points along a curve, which no line follows."""
    rng = np.random.default_rng(9)
    t = rng.uniform(-1, 1, 1500)
    x = np.column_stack((t, t**2, np.sin(3 * t), np.cos(3 * t))) + 0.02 * rng.normal(size=(1500, 4))
    df = spark.createDataFrame([(f"k{i}", *map(float, a)) for i, a in enumerate(x)], "uid string, a double, b double, c double, d double")
    names = ["a", "b", "c", "d"]
    linear = M.fit_latent(df, names, 1)
    line = M.reconstruction_error(df, linear).agg(F.avg("mse")).first()[0]
    plan = N.Schedule(60, rate=0.02, penalty=0.0, batch=64, passes=10, patience=10)
    fitted = M.fit_autoencoder(df, names, "uid", 1, hidden=16, plan=plan)
    error = M.autoencoder_error(df, fitted)
    assert error < 0.5 * line
    scaled = (x - x.mean(0)) / x.std(0)
    assert error == pytest.approx(N.losses(fitted.weights, fitted.layers, scaled, scaled, N.SELF).mean(), rel=1e-6)
    got = {r.uid: r.z for r in fitted.latent.encode(df).select("uid", vector_to_array("tab_latent")[0].alias("z")).collect()}
    (w1, b1), (w2, b2) = N.split_weights(fitted.weights, fitted.layers)[:2]
    want = (1 / (1 + np.exp(-(scaled @ w1 + b1)))) @ w2 + b2
    assert all(got[f"k{i}"] == pytest.approx(z[0], abs=1e-6) for i, z in enumerate(want))


def test_self_gradient_by_differences():
    rng = np.random.default_rng(10)
    layers, x = [3, 4, 2, 4, 3], rng.normal(size=(8, 3))
    w = N.first_weights(layers, 1)
    got = N.gradient(w, layers, x, x, 0.0, N.SELF)
    for k in range(0, len(w), 3):
        step = np.zeros(len(w))
        step[k] = 1e-6
        want = (N.losses(w + step, layers, x, x, N.SELF).mean() - N.losses(w - step, layers, x, x, N.SELF).mean()) / 2e-6
        assert got[k] == pytest.approx(want, abs=1e-6)


def test_lbfgs_ends_where_the_gradient_vanishes():
    """A long curved valley, and no iteration left over for what is flat."""

    def valley(w):
        a, b = w[:-1], w[1:]
        grad = np.zeros(len(w))
        grad[:-1] += -400 * a * (b - a * a) - 2 * (1 - a)
        grad[1:] += 200 * (b - a * a)
        return float((100 * (b - a * a) ** 2 + (1 - a) ** 2).sum()), grad

    at, values, done = N.minimised(valley, np.array([-1.2, 1.0, -1.2, 1.0]), 300)
    assert done and len(values) < 150 and all(x >= y for x, y in zip(values, values[1:]))
    assert np.abs(valley(at)[1]).max() < 1e-2 * np.abs(valley(np.array([-1.2, 1.0, -1.2, 1.0]))[1]).max()
    assert len(N.minimised(valley, np.array([-1.2, 1.0, -1.2, 1.0]), 3)[1]) == 4


def test_network_by_lbfgs_sums_all_rows(spark):
    """The same as on one machine, whatever the parts; all rows count, and the classes are told apart."""
    x, y = rings(11, 900)
    layers = [2, 12, 2]
    fitted = N.fit_network(frame(spark, x, y, 5), "vector", "y", layers, 200, 3)
    alone = N.minimised(lambda w: tuple(v / 900 for v in N.loss_and_gradient(w, layers, x, y)), N.first_weights(layers, 3), 8)
    assert fitted.losses[: len(alone[1])] == pytest.approx(alone[1], rel=1e-6)
    assert N.losses(fitted.weights, layers, x, y).mean() == pytest.approx(fitted.losses[-1]) and fitted.losses[-1] < 0.05


class Reached(Exception):
    pass


@pytest.mark.parametrize("query,fit", [
    ("m_mlp", "fit_mlp"), ("m_latent_mlp", "fit_mlp"), ("m_clean_train", "fit_mlp"), ("m_random_forest", "fit_forest"),
    ("m_mlp_balanced", "fit_balanced_mlp"), ("m_train_all", "fit_forest"), ("m_train_all", "fit_balanced_mlp"),
])
def test_fits_read_the_whole_train_side(spark, sf_dir, monkeypatch, query, fit):
    monkeypatch.setattr(modelling, "FIT_ROWS", 300)
    # The bundles before the one in question are not needed.
    for other in ("fit_logreg", "fit_forest", "fit_calibrated_svm"):
        monkeypatch.setattr(M, other, lambda *a, **b: None)

    def reached(df, *args, **named):
        raise Reached(df.count(), named.get("max_fit_rows"))

    monkeypatch.setattr(M, fit, reached)
    with pytest.raises(Reached) as found:
        modelling.QUERIES[query](spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert found.value.args == (n - -(-n // 5), None)
