"""Held-out accuracy, ordered thresholds and the defined cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from sessionloom.llm.quality import features, fit_ordinal, graded, score_quality, selected


def some(seed, n):
    r, rows = random.Random(seed), []
    for i in range(n):
        words = r.choices([f"w{k}" for k in range(500)], k=r.randint(20, 200))
        grade = r.choice([0, 1, 2, 2, 2])
        if grade == 0:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(["vile", "Nasty", "awful"]))
        if grade == 1:
            words = [w + r.choice(["!!", "###"]) for w in words]
        rows.append((i, " ".join(words), grade))
    return rows


def test_held_out_accuracy(spark):
    rows = some(1, 1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows if i % 2], "id long, grade int")
    docs = docs.selectExpr("*", "'x' as tail", "1 as grade")
    scored = score_quality(docs, ratings, max_fit_rows=600).withColumn("kept", selected(F.col("tail")))
    right = [r.kept == (rows[r.doc_id][2] == 2) for r in scored.collect() if r.doc_id % 2 == 0]
    assert len(right) == 750 and np.mean(right) > 0.97


def test_thresholds_are_ordered_and_tails_fall():
    rows = some(2, 400)
    number, at = features([t.encode() for _, t, _ in rows])
    model = fit_ordinal(number, at, np.array([g for _, _, g in rows]))
    tails = model.tails(number, at)
    assert (np.diff(model.thresholds) >= 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    expected = tails.sum(1)
    grade = np.array([g for _, _, g in rows])
    assert expected[grade == 0].mean() < expected[grade == 1].mean() < expected[grade == 2].mean()


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = [b"", b"The cat!! sat", b"a\nb\nb", b"\x00\xc3\x89 " * 50]
    number, at = features(texts)
    for k, t in enumerate(texts):
        alone, _ = features([t])
        assert number[at[k] : at[k + 1]].tolist() == alone.tolist()


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "a " * 50000), (2, "a " * 50000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, None), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = score_quality(docs, graded(labels)).collect()
    assert len(got) == 4 and all(r.expected_grade is None and r.tail is None for r in got)
    rated = spark.createDataFrame([(1, 0), (2, 2)], "id long, grade int")
    assert all(0 <= r.expected_grade <= 2 for r in score_quality(docs, rated).collect())
    assert score_quality(docs.limit(0), rated).collect() == []
    assert len(score_quality(docs, graded(labels.limit(0))).collect()) == 4
