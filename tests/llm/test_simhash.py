"""Fingerprints, links and groups against brute force."""

import random

import numpy as np
import pytest
import xxhash

from sessionloom.llm import simhash as S
from sessionloom.llm.components import components
from sessionloom.llm.queries import op2_result


def naive_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def roots(values):
    """Smallest value that hangs together with each by links of at most four bits."""
    values, left, out = sorted(set(values)), set(values), {}
    for v in values:
        if v in left:
            queue = [v]
            left.discard(v)
            while queue:
                x = queue.pop()
                out[x] = v
                near = {y for y in left if (x ^ y).bit_count() <= 4}
                left -= near
                queue += near
    return out


def some_prints(seed, n):
    r, out = random.Random(seed), [0, 2**64 - 1, 15, 31]
    while len(out) < n:
        base = r.getrandbits(64) if r.random() < 0.3 else r.choice(out[-60:])
        for _ in range(r.randint(1, 5)):
            base ^= 1 << r.randrange(64)
        out.append(base)
    return out


@pytest.mark.parametrize("seed,chunk", [(1, 1 << 16), (2, 50), (3, 5)])
def test_links_connect_what_hangs_together(spark, seed, chunk):
    values = some_prints(seed, 1500)
    dense = [sum(1 << b for b in random.Random(i).sample(range(20), 2)) for i in range(200)]
    values += dense
    signed = np.unique(np.array(values, np.uint64)).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long").repartition(4)
    links = S.fingerprint_links(df, chunk)
    found = {r.node: r.root for r in components(links).collect()}
    want = roots([v % 2**64 for v in signed])
    together = lambda labels: sorted(map(sorted, labels.values()))
    a, b = {}, {}
    for v in signed:
        a.setdefault(found.get(v, v), []).append(v)
        b.setdefault(want[v % 2**64], []).append(v)
    assert together(a) == together(b)


def test_ring_keys_meet_every_near_pair():
    r = random.Random(5)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 4)):
            b ^= 1 << bit
        both = np.array([a, b], np.uint64)
        batch = next(S._keys(iter([S.pa.RecordBatch.from_arrays([S.pa.array(both.view(np.int64))], names=["f"])])))
        key = batch.column(0).to_numpy().view(np.uint64).reshape(64, 2)
        seg = (key[:, 0] & np.uint64(7)).astype(int)
        met = key[:, 0] == key[:, 1]
        assert (met & S.linked(np.full(64, both[0]), np.full(64, both[1]), seg)).any()


def test_groups_equal_brute_force(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(300)] + ["É", "The"]
    rows = []
    for i in range(120):
        w = r.choices(words, k=r.choice([0, 2, 5, 80]))
        rows.append((i, " ".join(w)))
        for _ in range(r.choice([0, 0, 1, 4])):
            w = list(w)
            if w:
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((len(rows) + 1000, "\t".join(w).upper()))
    rows += [(5000, None), (5001, ""), (5002, " \n "), (None, rows[0][1]), (5003, "x " * 30000)]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fingerprint", "2 as id").repartition(5)
    got = op2_result(S.simhash_groups(df)).collect()
    prints = [naive_print(t) for _, t in rows]
    root = roots(prints)
    least = {}
    for (i, _), f in zip(rows, prints):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = [(i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, prints)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert S.simhash_groups(df.limit(0)).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 7), (9, 9), (5, -4), (-4, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{i: -4 for i in (7, 3, 5, -4)}}


def test_keep_one_row_of_each_group(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        w = r.choices(words, k=r.choice([0, 2, 80]))
        texts.append(" ".join(w))
        for _ in range(r.choice([0, 1, 4])):
            w = list(w)
            if w:
                w[r.randrange(len(w))] = r.choice(words)
            texts.append("\n".join(w))
    texts += [None, "", "x " * 30000]
    rows = [(r.choice([None, 1, 2, i, -i]), t, k) for k, (i, t) in enumerate(enumerate(texts + texts[:20]))]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int").selectExpr("*", "1 as id", "2 as whole")
    got = S.keep_one(df)
    assert got.dtypes == df.dtypes
    prints = [naive_print(t) for _, t, _ in rows]
    root, best = roots(prints), {}
    for (i, _, k), f in zip(rows, prints):
        key = (i is None, i or 0, k)
        best[root[f]] = min(key, best.get(root[f], key))
    assert sorted(x.row for x in got.collect()) == sorted(k for *_, k in best.values())
    assert S.keep_one(df.limit(0)).collect() == []
