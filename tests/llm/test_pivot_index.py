"""Links and groups against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest

from sessionloom.llm.pivot_index import NEAREST, Entries, embedding_groups, rank_difference
from sessionloom.llm.queries import op5_result

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    ok = [
        (i, np.array(v, np.float32).astype(float), l) for i, v, l in rows
        if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and any(v)
    ]
    near = {i: set() for i, _, _ in rows}
    n = {i: 0 for i, _, _ in rows}
    for a, (i, x, l) in enumerate(ok):
        for j, y, k in ok[:a]:
            if l == k and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= cosine:
                near[i].add(j)
                near[j].add(i)
                n[i] += 1
                n[j] += 1
    root = {}
    for i in sorted(k for k in near if k is not None):
        stack = [i] if i not in root else []
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = i
                stack += near[x]
    return n, root


def some(seed, n=400, d=64):
    r = np.random.default_rng(seed)
    rows, last = [], r.normal(size=d)
    for i in range(n):
        kind = r.random()
        if kind < 0.4:
            last = r.normal(size=d)
            v = last
        elif kind < 0.55:
            v = last
        else:
            v = last + r.normal(size=d) * r.uniform(0.02, 0.45) * np.linalg.norm(last) / math.sqrt(d)
        rows.append((i * 3, v.astype(np.float32).tolist(), int(r.integers(0, 3)) if kind < 0.4 or not rows else rows[-1][2]))
    hot = r.normal(size=d)
    rows += [(5000 + i, (hot + 0.05 * r.normal(size=d)).astype(np.float32).tolist(), 1) for i in range(150)]
    return rows


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 40)])
def test_links_against_brute_force(spark, seed, block):
    rows = some(seed)
    d = 64
    odd = [(9000, None, 1), (9001, [0.0] * d, 1), (9002, [float("nan")] * d, 1), (9003, [None] * d, 1), (9004, rows[0][1], None),
           (9005, [float("inf")] + [1.0] * (d - 1), 1), (9006, [], 1), (9007, [1.0, 2.0], 1), (9008, [1.0, 2.1], 1), (9009, [2.0, 4.0], 1)]
    df = spark.createDataFrame(rows + odd + [(None, rows[0][1], 1)], SCHEMA).selectExpr("*", "1 as id", "2 as vector").repartition(4)
    got = op5_result(embedding_groups(df, block=block)).collect()
    n, root = brute(rows + odd)
    assert len(got) == len(rows) + len(odd) + 1
    have = {r.vec_id: r for r in got}
    assert all(have[i].n_links <= n[i] for i in n)
    assert sum(r.n_links for r in got) >= 0.97 * sum(n.values())
    assert all(have[i].n_links == 0 and have[i].kept for i, _, _ in odd[:7])
    assert all(r.kept == (r.component_id == r.vec_id) for r in got if r.vec_id is not None)
    # What is found hangs together only where brute force says so.
    assert all(root[r.component_id] == root[r.vec_id] and r.component_id <= r.vec_id for r in got if r.vec_id is not None)
    assert {have[i].component_id for i in range(5000, 5150)} == {root[5000]}
    assert [have[i].n_links for i in (9007, 9008, 9009)] == [2, 2, 2]


def footrule(a, b):
    """Ranks of all pivots that either names, the others' rank being the number of pivots."""
    place = lambda p, x: p.index(x) if x in p else len(p)
    return sum(abs(place(a, x) - place(b, x)) for x in {*a, *b})


def test_rank_difference_against_its_definition():
    r = np.random.default_rng(3)
    a, b = (np.array([r.permutation(9)[:NEAREST] for _ in range(300)], np.int16) for _ in range(2))
    assert rank_difference(a, b).tolist() == [footrule(x, y) for x, y in zip(a.tolist(), b.tolist())]
    assert rank_difference(a, a).tolist() == [0] * 300
    assert rank_difference(a[:1], a[:1] + 20).tolist() == [NEAREST * (NEAREST + 1)]


def entries(pivots):
    n, v = len(pivots), np.ones(2).tobytes()
    fixed = {"key": 1, "i": 0, "j": 0, "block": 0, "size": 1, "low": 0, "high": 1}
    return Entries(pa.table({
        **{k: np.full(n, x) for k, x in fixed.items()}, "id": np.arange(n),
        "pivots": [np.array(p, np.int16).tobytes() for p in pivots], "vector": [v] * n,
    }))


def test_rank_differences_prune():
    """All hold the same pivots (0 to 5): sets alone could not tell them apart."""
    e = entries([[0, 1, 2, 3, 4, 5], [1, 0, 2, 3, 4, 5], [5, 4, 3, 2, 1, 0], [0, 1, 9, 8, 7, 6]])
    a, b = np.array([0, 0, 0]), np.array([1, 2, 3])
    pairs = lambda bound: e.candidates(a, b, bound)[1].tolist()
    assert [pairs(k) for k in (1, 2, 17, 18, 20)] == [[], [1], [1], [1, 2], [1, 2, 3]]
    u, v = e.close(np.arange(4), np.arange(4), 2)
    assert set(zip(u.tolist(), v.tolist())) == {(i, i) for i in range(4)} | {(0, 1), (1, 0), (0, 3), (3, 0), (1, 3), (3, 1)}


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(2, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)], SCHEMA)
    assert sorted(map(tuple, embedding_groups(df).collect())) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
    assert embedding_groups(df.limit(0)).collect() == []
