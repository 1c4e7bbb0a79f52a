"""Substring removal against a brute-force version."""

import random
import re

import pytest

from sessionloom.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, w in texts:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, float("inf")), key(i))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < key(i):
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("seed,block_bytes,group_bytes", [(1, 8 << 20, 8 << 20), (2, 2000, 300), (3, 300, 1000)])
def test_equals_brute_force(spark, seed, block_bytes, group_bytes):
    r = random.Random(seed)
    vocabulary = ["a", "bb", "the", "É", "word", "longer-than-eight"] + [f"w{i}" for i in range(40)]
    passage = [" ".join(r.choices(vocabulary, k=30)) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [" ".join(r.choices(vocabulary, k=r.randint(0, 30))) for _ in range(3)]
        if r.random() < 0.5:
            parts.insert(r.randint(0, 3), r.choice(passage))
        if r.random() < 0.2:
            parts = ["the"] * r.randint(0, 40)
        rows.append((r.choice([i, i, i, 7, None]), r.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(900, None), (901, ""), (902, " \n"), (3, rows[0][1]), (904, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = docs.selectExpr("doc_id", "text", "1 as block", "2 as data", "'x' as kept_text")
    got = substring_dedup(docs, block_bytes=block_bytes, group_bytes=group_bytes).collect()
    assert order(got) == order(brute(rows, 13))


def test_long_text_and_empty_table(spark):
    text = " ".join(f"w{i % 5000}" for i in range(60000))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup(docs).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].kept_text) == (0, 60000, "")
    assert substring_dedup(docs.limit(0)).collect() == []
