"""Clusters against plain integer arithmetic."""

import math
import random
from hashlib import sha256

import pytest

from sessionloom.llm import centroids as C


def brute(rows, k, rounds, dims):
    """(vec_id, cluster, distance, cluster inertia, inertia, centroid) of each usable (vec_id, vector)."""
    ok = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(C.SCALE * x) if math.isfinite(C.SCALE * x) else C.SCALE * int(x) for x in v]) for i, v in ok]
    order = sorted(range(len(ok)), key=lambda n: (ok[n][0] is None, sha256(f"2:{ok[n][0]}".encode()).hexdigest(), ok[n][1]))
    cent = [ints[n][1] for n in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cent))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in ints]
        for j in range(len(cent)):
            members = [v for (_, v), o in zip(ints, own) if o == j]
            if members:
                cent[j] = [sum(x) // len(members) for x in zip(*members)]
    last = [(i, *nearest(v)) for i, v in ints]
    fits = lambda x: x if x < 1 << 63 else None
    per = {j: sum(d for _, d, o in last if o == j) for j in range(len(cent))}
    lost = any(d >= 1 << 63 for _, d, _ in last)
    bad = {o for _, d, o in last if d >= 1 << 63}
    return [
        (i, j, fits(d), None if j in bad else fits(per[j]), None if lost else fits(sum(per.values())), ",".join(map(str, cent[j])))
        for i, d, j in last
    ]


def some_rows(r, n, dims, spread):
    rows = [(i, [r.gauss(0, spread) for _ in range(dims)]) for i in range(n)]
    rows += [(i + n, list(rows[r.randrange(n)][1])) for i in range(n // 2)]
    rows += [(1, rows[1][1]), (1, rows[1][1]), (1, rows[2][1]), (None, rows[3][1]), (None, rows[4][1]), (900, [0.0] * dims), (901, None)]
    rows += [(902, [0.5] * (dims - 1)), (903, [0.5] * (dims + 1)), (904, []), (905, [None] + [0.5] * (dims - 1))]
    return rows + [(906 + i, [x] + [0.5] * (dims - 1)) for i, x in enumerate((math.nan, math.inf, -math.inf))]


@pytest.mark.parametrize("seed,k,dims,spread,block", [
    (1, 40, 64, 0.3, 8192), (2, 7, 3, 0.01, 10), (3, 5, 4, 1e6, 50), (4, 4, 3, 1e16, 16), (5, 300, 2, 1.0, 64), (6, 3, 2, 1e30, 9),
])
def test_equals_brute_force(spark, seed, k, dims, spread, block):
    rows = some_rows(random.Random(seed), 90, dims, spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cluster", "2 as distance")
    got = C.cluster_vectors(df.repartition(4), k=k, dims=dims, block_rows=block)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows, k, C.ROUNDS, dims), key=str)


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [0.0, 0.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = C.cluster_vectors(df, k=3, dims=2).collect()
    assert {(r.cluster, r.distance, r.inertia, r.centroid) for r in got} == {(0, 0, 0, "0,0")}


def test_infinite_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert C.cluster_vectors(spark.createDataFrame([], schema)).collect() == []
    assert C.cluster_vectors(spark.createDataFrame([(1, None), (2, [1.0])], schema)).collect() == []
