"""Exact shard sizes and the uniformity of the shuffle."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from sessionloom.llm.shards import communication_matrix, draw_without_return, uniform_shards


def test_matrix_follows_the_law():
    rows, cols = np.array([5, 7, 0, 8]), np.array([6, 4, 10])
    draws = np.array([communication_matrix(rows, cols, s) for s in range(4000)])
    assert (draws.sum(2) == rows).all() and (draws.sum(1) == cols).all()
    assert np.abs(draws.mean(0) - np.outer(rows, cols) / 20).max() < 0.1
    n, k, total = 5, 6, 20
    want = n * k / total * (1 - k / total) * (total - n) / (total - 1)
    assert abs(draws[:, 0, 0].var() - want) < 0.1


def test_any_rows_of_the_matrix_alone():
    rows, cols = np.array([5, 0, 900, 8, 31]), np.array([6, 4, 934, 0, 0])
    whole = communication_matrix(rows, cols, 3)
    for i in range(6):
        for j in range(i, 6):
            assert (communication_matrix(rows, cols, 3, i, j) == whole[i:j]).all()


def test_draws_are_hypergeometric():
    r = np.random.default_rng(5)
    for good, bad, n in [(40, 60, 50), (3, 200, 90), (500, 20, 400), (1000, 1000, 17), (0, 9, 4), (9, 0, 9)]:
        got = draw_without_return(r, np.full(40_000, good), np.full(40_000, bad), np.full(40_000, n))
        # An independent way: the law's chances by logarithms of factorials.
        log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
        low, high = max(0, n - bad), min(good, n)
        assert low <= got.min() and got.max() <= high
        want = np.array([math.exp(log(good, x) + log(bad, n - x) - log(good + bad, n)) for x in range(low, high + 1)]) * 40_000
        seen = np.bincount(got - low, minlength=len(want))
        often = want > 20
        assert ((seen - want)[often] ** 2 / want[often]).sum() < often.sum() + 5 * np.sqrt(2 * often.sum())


def test_draws_of_any_size():
    r = np.random.default_rng(6)
    good, bad, n = 3 * 10**12, 10**12, 2 * 10**12
    got = draw_without_return(r, np.full(3000, good), np.full(3000, bad), np.full(3000, n))
    total = good + bad
    spread = math.sqrt(n * (good / total) * (bad / total) * (total - n) / (total - 1))
    z = (got - n * good / total) / spread
    assert abs(z.mean()) < 0.08 and abs(z.var() - 1) < 0.12
    sent = communication_matrix(np.full(3, 10**10), np.array([2 * 10**10, 10**10]), 1)
    assert (sent.sum(1) == 10**10).all() and sent.sum(0).tolist() == [2 * 10**10, 10**10]


def test_exact_sizes_and_slots(spark):
    rows = [(i % 90 if i % 7 else None, "same" if i % 3 else f"t{i}", i) for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, slot string, shard long").repartition(7)
    got = uniform_shards(df.selectExpr("*", "slot as text"), 8).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [125] * 5 + [126] * 3
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r.text) for r in got) == Counter((a, b) for a, b, _ in rows)


def test_uniform(spark):
    df = spark.range(24).repartition(3)
    where = np.zeros((24, 8))
    for seed in range(40):
        for r in uniform_shards(df, 8, seed=seed * 10).collect():
            where[r.id, r.shard] += 1
    assert (where.sum(1) == 40).all()
    # 7 * 24 cells near 5 of 40: chi-square with 161 degrees of freedom.
    assert ((where - 5) ** 2 / (5 * 7 / 8)).sum() < 161 * 8 / 7 * 1.5


def test_few_rows(spark):
    df = spark.range(3)
    assert sorted(r.slot for r in uniform_shards(df, 8).collect()) == [0, 0, 0]
    assert uniform_shards(df.limit(0), 8).collect() == []


def test_clashing_column_names(spark):
    names = ["_part", "_pos", "_cell", "_from", "_to", "_begin", "_rank", "whole", "shard", "slot", "a.b"]
    df = spark.range(50).select(*[(F.col("id") + k).alias(n) for k, n in enumerate(names)]).repartition(3)
    got = uniform_shards(df, 8)
    kept = [n for n in names if n not in ("shard", "slot")]
    assert got.columns == [*kept, "shard", "slot"]
    rows = sorted(tuple(r)[:-2] for r in got.collect())
    assert rows == sorted(tuple(i + names.index(n) for n in kept) for i in range(50))
