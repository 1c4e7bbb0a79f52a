"""Equalities between operators, and brute force on small skewed inputs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sessionloom import fixtures as X
from sessionloom import schemas as S
from sessionloom.operators import evaluate as V
from sessionloom.operators import features as Fe
from sessionloom.operators import joins as J
from sessionloom.operators import normalize as N
from sessionloom.operators import prepare as P
from sessionloom.operators import quality as Q
from sessionloom.operators.ordered import running_totals
from sessionloom.operators.scaling import RobustScale, StandardScale
from sessionloom.plans import warehouse as W
from sessionloom.sources import conn_log as L
from sessionloom.sources.tables import with_row_id
from sessionloom.streaming.ingest import stream_ingest


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("legend", ["literal", "full"])
def test_fused_view_equals_joined_view(spark, raw, legend):
    tables = N.build_tables(raw, legend)
    joined = Fe.training_view(tables, "capture_2.csv", ["uid"])
    assert same(joined, Fe.training_view_fused(raw, "capture_2.csv", ["uid"], legend))


def test_fused_view_does_not_shuffle(raw, spark, sf_dir):
    view = Fe.training_view_fused(X.conn(spark, sf_dir))
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_capture_filter_prunes_partitions(spark, raw, tmp_path):
    stored = W.materialize(raw, str(tmp_path / "raw"))
    plan = Fe.filter_capture(stored, "capture_1.csv")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_file" in plan


def test_stream_equals_batch_and_takes_new_files_once(spark, tmp_path, sf_dir):
    lines = X.conn_lines(X.read_table(spark, sf_dir, "events")).select("value")
    source, out, done = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    first, second = lines.filter(F.crc32("value") % 2 == 0), lines.filter(F.crc32("value") % 2 == 1)
    first.write.mode("append").text(source)
    stream_ingest(spark, source, out, done)
    n_first = spark.read.parquet(out).count()
    second.write.mode("append").text(source)
    stream_ingest(spark, source, out, done)
    stream_ingest(spark, source, out, done)
    batch = L.read_conn_logs(spark, source)
    streamed = spark.read.schema(batch.schema).parquet(out)
    assert 0 < n_first < streamed.count() and same(streamed, batch)


def test_rebuild_twice_equals_once(spark, raw, tmp_path):
    once = {k: t.count() for k, t in W.rebuild(raw, str(tmp_path)).items()}
    again = W.rebuild(raw, str(tmp_path))
    assert once == {k: t.count() for k, t in again.items()}
    assert set(W.open_tables(spark, str(tmp_path))) == set(again)


def test_a_view_of_one_capture_reads_that_capture_alone(spark, raw, tmp_path):
    tables = W.rebuild(raw, str(tmp_path))
    view = Fe.training_view(tables, "capture_2.csv", keep=["uid"])
    assert same(view, Fe.training_view_fused(raw, "capture_2.csv", keep=["uid"]))
    scans = [x for x in view._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x]
    parts = [x for x in scans if not any(f"/{t}/rows" in x for t in W.SHARED_TABLES)]
    assert len(parts) >= 6 and all("PartitionFilters: [isnotnull(source_file" in x for x in parts)


def test_lookup_join_beyond_its_bound(spark, monkeypatch):
    left = spark.range(200).select((F.col("id") % 40).alias("k"))
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = J.lookup_join(left, right, "k")
    assert J.local_copy(right, 49) is None
    monkeypatch.setattr(J, "local_copy", lambda df: None)
    assert same(small, J.lookup_join(left, right, "k"))


def test_dimension_numbers_do_not_depend_on_its_size(raw, monkeypatch):
    few = N.build_label(raw)
    monkeypatch.setattr(N, "small_rows", lambda df: None)
    assert same(few, N.build_label(raw)) and few.count() > 1


def skewed(n=3000, seed=1):
    """A third of the rows share one score."""
    rnd = random.Random(seed)
    pick = lambda: 0.25 if rnd.random() < 0.34 else round(rnd.random(), 3)
    return pd.DataFrame({
        "key": [f"k{i}" for i in range(n)],
        "model": [rnd.choice("ab") for _ in range(n)],
        "label": [int(rnd.random() < 0.3) for _ in range(n)],
        "score": [pick() for _ in range(n)],
    })


def test_running_totals_by_brute_force(spark):
    pdf = skewed().groupby(["model", "score"], as_index=False).agg(n=("key", "count"))
    df = spark.createDataFrame(pdf).repartition(7)
    got = running_totals(df, ["model"], [F.desc("score")], {"upto": F.col("n")}).toPandas()
    pdf = pdf.sort_values(["model", "score"], ascending=[True, False])
    pdf["upto"] = pdf.groupby("model")["n"].cumsum()
    got = got.sort_values(["model", "score"], ascending=[True, False])
    assert got["upto"].tolist() == pdf["upto"].tolist() and len(got) == len(pdf)


def test_row_ids_with_a_hot_first_key(spark):
    pdf = pd.DataFrame({"a": [1] * 1500 + list(range(1500)), "b": range(3000)})
    got = with_row_id(spark.createDataFrame(pdf).repartition(6), ["a", "b"]).toPandas()
    want = pdf.sort_values(["a", "b"]).reset_index(drop=True)
    got = got.sort_values("id").reset_index(drop=True)
    assert got["id"].tolist() == list(range(1, 3001)) and got[["a", "b"]].equals(want)


def test_curve_and_auc_by_brute_force(spark):
    pdf = skewed()
    df = spark.createDataFrame(pdf).repartition(5)
    auc = {r.model: r.roc_auc for r in V.roc_auc(df).collect()}
    points = V.pr_curve(df).toPandas()
    for model, part in pdf.groupby("model"):
        pos, neg = part[part.label == 1].score.values, part[part.label == 0].score.values
        wins = (pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2
        assert auc[model] == pytest.approx(wins / (len(pos) * len(neg)))
        curve = points[points.model == model]
        assert len(curve) == part.score.nunique() + 1
        for row in curve.dropna().sample(20, random_state=1).itertuples():
            chosen = part[part.score >= row.threshold]
            assert row.precision == pytest.approx(chosen.label.mean())
            assert row.recall == pytest.approx(chosen.label.sum() / len(pos))


def test_scan_equals_single_thresholds(spark):
    df = spark.createDataFrame(skewed())
    scan = V.threshold_scan(df)
    assert scan.count() == 2 * 101
    for i in (0, 25, 35, 41, 100):
        t = V.threshold_grid()[i]
        at = scan.filter(F.col("threshold") == F.lit(t))
        assert same(at, V.metrics_at(df, t).select(at.columns))


def test_grid_is_multiples_of_the_step():
    assert V.threshold_grid() == list(np.linspace(0.0, 1.0, 101))


def test_splits_are_exact_and_reproducible(spark):
    df = spark.createDataFrame(skewed(1003)).repartition(4)
    marked = P.random_split(df, "key", 0.2, 7)
    assert marked.filter("is_test = 1").count() == 201
    assert same(marked, P.random_split(df.repartition(3), "key", 0.2, 7))
    other = P.random_split(df, "key", 0.2, 8)
    assert not same(marked, other)
    strat = P.stratified_split(df, "key", "label", 0.2, 7)
    assert strat.filter("is_test = 1").count() == 201
    for r in strat.groupBy("label").agg(F.avg("is_test").alias("p"), F.count("*").alias("n")).collect():
        assert abs(r.p * r.n - 0.2 * r.n) <= 1


def test_split_keeps_copies_of_a_key_together(spark):
    pdf = pd.DataFrame({"key": ["hot"] * 300 + [f"k{i}" for i in range(600)]})
    marked = P.random_split(spark.createDataFrame(pdf), "key", 0.2, 1)
    sides = marked.groupBy("key").agg(F.countDistinct("is_test").alias("n"))
    assert sides.filter("n > 1").count() == 0 and marked.count() == 900


def test_rows_of_a_frequent_class_stay_in_their_tasks(spark):
    """Marked and weighted rows are not dealt by class, of which there may be two only."""
    rows = spark.range(8000, numPartitions=8).select("id", (F.col("id") % 100 == 0).cast("int").alias("y")).persist()
    for marked in (
        P.stratified_split(rows, "id", "y"), P.stratified_folds(rows, "id", "y", 3), P.with_class_weight(rows, "y"),
    ):
        assert "SortMergeJoin" not in marked._jdf.queryExecution().toString()
        sizes = marked.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) <= 2000


def test_passes_over_a_sample_do_not_read_the_input(spark):
    rows = spark.range(4000, numPartitions=4).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    for most, n in ((200, 200), (5000, 4000)):
        sample = P.fit_sample(rows, "id", "y", most)
        assert "Range" not in sample._jdf.queryExecution().toString()
        assert sample.count() == n and sample.filter("y = 1").count() == n // 10
        assert sample.rdd.getNumPartitions() == P.FIT_PARTITIONS


def test_split_of_an_empty_share(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "key string, label int")
    assert P.random_split(df, "key", 0.0, 1).filter("is_test = 1").count() == 0


def test_upsample_reaches_the_majority(spark):
    df = spark.createDataFrame(skewed(2000)).repartition(4)
    up = P.upsample_minority(df, "key", "label", 3)
    counts = {r.label: r.n for r in up.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts[0] == counts[1] == df.filter("label = 0").count()
    assert up.join(df, df.columns, "left_anti").count() == 0
    assert same(up.filter("label = 0"), df.filter("label = 0"))


def test_scalers_by_brute_force(spark):
    rnd = np.random.default_rng(5)
    pdf = pd.DataFrame({
        "u": rnd.normal(5, 3, 1001), "v": rnd.integers(0, 2, 1001).astype(float),
        "w": np.where(rnd.random(1001) < 0.4, 7.0, rnd.exponential(10, 1001)),
    })
    df = spark.createDataFrame(pdf).repartition(5)
    model = StandardScale.fit(df, list(pdf))
    assert model.centers == pytest.approx(pdf.mean().tolist())
    assert model.scales == pytest.approx(pdf.std(ddof=0).tolist())
    exact = RobustScale.fit(df, list(pdf))
    low, mid, high = (pdf.quantile(q) for q in (0.25, 0.5, 0.75))
    assert exact.centers == pytest.approx(mid.tolist())
    assert exact.scales == pytest.approx([s or 1.0 for s in (high - low)])
    near = RobustScale.fit(df, list(pdf), exact=False)
    assert near.centers == pytest.approx(mid.tolist(), abs=0.2)


def test_feature_names_are_complete():
    assert len(S.TRAINING_COLUMNS) == len(set(S.TRAINING_COLUMNS)) == 312
    assert (len(S.TABULAR_FEATURES), len(S.HISTORY_FEATURES)) == (51, 252)


def test_aligning_adds_orders_and_drops(spark):
    df = spark.createDataFrame([(1, 2)], "b int, z int")
    out = P.align_features(df, ["a", "b"])
    assert out.columns == ["a", "b"] and tuple(out.first()) == (0, 1)


def test_parent_keys_are_sent_to_all_tasks_only_if_few(spark, monkeypatch):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,), (9,), (9,), (9,)], "k long")
    parent = spark.createDataFrame([(1,), (1,), (2,), (None,)], "p long")
    for found in (Q.local_copy, lambda df: None):
        monkeypatch.setattr(Q, "local_copy", found)
        orphans = Q.fk_violations(child, parent, "k", "p")
        assert [tuple(r) for r in orphans.collect()] == [(9, 3)]
    assert "BroadcastExchange" not in orphans._jdf.queryExecution().executedPlan().toString()
