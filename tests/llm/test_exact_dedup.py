"""Groups of equal texts against a dictionary of them; no Python on the executors."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from sessionloom.llm import exact_dedup as E


def brute(rows):
    """(id, keep_id, size, kept, sha256) of each (id, text), in scan order."""
    groups = defaultdict(list)
    plain = [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in rows]
    for k, p in enumerate(plain):
        groups[p].append(k)
    best = {p: min(g, key=lambda k: (-len(rows[k][1] or ""), rows[k][0] is None, rows[k][0] or 0, k)) for p, g in groups.items()}
    return [
        (i, rows[best[p]][0], len(groups[p]), best[p] == k, hashlib.sha256(p.encode()).hexdigest())
        for k, ((i, _), p) in enumerate(zip(rows, plain))
    ]


@pytest.mark.parametrize("seed,parts,run_rows,fan_bits", [(1, 1, 1 << 16, 4), (2, 23, 7, 1), (3, 40, 3, 2)])
def test_equals_brute_force(spark, seed, parts, run_rows, fan_bits):
    r = random.Random(seed)
    base = ["", "ab", "a b", "é 😀", " x", "\x1cx", "x", "long " * 20_000] + [f"text {i}" for i in range(30)]
    rows = [(r.choice([None, i, -i, 5]), None if r.random() < 0.03 else "".join(
        c + r.choice(["", "", "", " ", "\t", "\x0b", "\n\r\x0c"]) if len(t) < 50 else c for c in t)) for i in range(600)
        for t in [r.choice(base)]]
    rows += [(1, "third")] * 400  # one text with many copies
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    # Scan order must be the list's for ties, so partitions are cut from it in order.
    df = spark.createDataFrame(spark.sparkContext.parallelize(df.collect(), parts), df.schema)
    df = df.selectExpr("*", "1 as run", "2 as digest", "3 as row", "4 as best", "5 as id")
    found = E.exact_groups(df, run_rows=run_rows, fan_bits=fan_bits)
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("ExistingRDD", ""))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute(rows), key=str)


def test_rounds_follow_the_number_of_runs(spark):
    """Every round cuts the number of runs by the fan; each text's count and best row come through."""
    marks = spark.range(0, 4000, 1, 64).selectExpr(
        "id", "id as row", "struct(id div 63 as task, 0L as part) as run", "pmod(id, 10) as digest", "X'00' as sha",
        "1 as n_bytes", "cast(pmod(id, 7) as int) as n_points",
    )
    runs = E.first_runs(marks)
    assert runs.count() == 64 * 10
    for bits in (1, 3, 6):
        got = {r.digest: (r.n, r.best.id) for r in E.tree_merge(runs, bits).collect()}
        assert got == {d: (400, next(i for i in range(d, 4000, 10) if i % 7 == 6)) for d in range(10)}


def test_digests_alone_do_not_make_texts_equal(spark):
    """Equal digests with another SHA-256 or length stay apart."""
    rows = [(0, 1, "aa", 5), (1, 1, "aa", 5), (2, 1, "bb", 5), (3, 1, "aa", 6)]
    marks = spark.createDataFrame(rows, "id long, digest long, sha string, n_bytes int").selectExpr(
        "*", "id as row", "struct(id as task, 0L as part) as run", "1 as n_points"
    )
    assert sorted(r.n for r in E.tree_merge(E.first_runs(marks)).collect()) == [1, 1, 2]


def test_empty_table(spark):
    assert E.exact_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
