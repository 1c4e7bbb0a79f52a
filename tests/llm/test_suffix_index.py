"""Byte removal against a brute-force version, and the sizes of the index's levels."""

import random

import pytest
from pyspark.sql import functions as F

from sessionloom.llm import blocks as B
from sessionloom.llm.suffix_index import SuffixIndex, dedup_bytes, unpack_sorted


def brute(rows, n=50):
    key = lambda i: float("inf") if i is None else i
    first = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for s in range(len(t) - n + 1):
            first[t[s : s + n]] = min(first.get(t[s : s + n], float("inf")), key(i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - n + 1):
            if first[t[s : s + n]] < key(i):
                gone[s : s + n] = b"\1" * n
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def order(rows):
    return sorted(((a, b, c, d, bytes(e)) for a, b, c, d, e in rows), key=str)


@pytest.mark.parametrize("seed,batch_bytes,block_bytes", [(1, 5000, 8 << 20), (2, 4000, 3000), (3, 1 << 30, 500)])
def test_equals_brute_force(spark, seed, batch_bytes, block_bytes):
    r = random.Random(seed)
    text = lambda n: "".join(r.choices("abcdé \n", k=n))
    passages = [text(r.randint(45, 120)) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [text(r.randint(0, 60)) for _ in range(3)]
        if r.random() < 0.6:
            p = r.choice(passages)
            parts.insert(r.randint(0, 3), p[r.randint(0, 5) :])
        if r.random() < 0.1:
            parts = ["a" * r.randint(40, 200)]
        rows.append((r.choice([i, i, i, 7, None]), "".join(parts)))
    rows += [(900, None), (901, ""), (902, "x" * 49), (903, "x" * 50), (904, "x" * 51), (3, rows[0][1]), (905, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block", "2 as kept").repartition(4)
    got = dedup_bytes(df, batch_bytes=batch_bytes, block_bytes=block_bytes).collect()
    assert order(got) == order(brute(rows))


def test_long_text_and_empty_table(spark):
    r = random.Random(4)
    text = "".join(r.choices("abcdefgh", k=300_000))
    df = spark.createDataFrame([(1, text), (2, "new" + text)], "doc_id long, text string")
    got = {x.doc_id: x for x in dedup_bytes(df).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans, bytes(got[2].kept)) == (0, 300_000, 1, b"new")
    assert dedup_bytes(df.limit(0)).collect() == []


def test_levels_merge_geometrically(spark):
    index = SuffixIndex(spark)
    sizes = []
    for k in range(5):
        df = spark.createDataFrame([(k, f"{k} " * 60)], "doc_id long, text string")
        index.add(B.write_blocks(df, "doc_id", "text"))
        sizes.append([n for n, _, _ in index.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1]]


def test_the_number_of_levels_follows_the_data(spark, monkeypatch):
    """Sixteen batches through the operator: each addition merges what became equal."""
    sizes, add = [], SuffixIndex.add

    def watched(self, blocks):
        add(self, blocks)
        sizes.append([n for n, *_ in self.levels])

    monkeypatch.setattr(SuffixIndex, "add", watched)
    r = random.Random(6)
    rows = [(i, "".join(r.choices("abcdefgh ", k=200))) for i in range(80)]
    rows += [(80 + i, rows[i][1]) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup_bytes(df, batch_bytes=2000).collect()
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1], [4, 1, 1], [4, 2, 1], [4, 2, 1, 1], [8, 1], [8, 1, 1], [8, 2, 1],
                     [8, 2, 1, 1], [8, 4, 1], [8, 4, 1, 1], [8, 4, 2, 1], [8, 4, 2, 1, 1]]
    assert all(x.n_removed == (200 if x.doc_id >= 80 else 0) for x in got)


def test_every_two_batches_meet_once(spark, monkeypatch):
    """Sixteen batches: an entry is read by scans and merges once for each level it is in, not once for each later batch."""
    read, beside = [], SuffixIndex._beside

    def watched(self, left, right, *more):
        for name in (left, right):
            read.append(sum(len(unpack_sorted(r["keys"])) for r in spark.table(name).select("keys").collect()))
        return beside(self, left, right, *more)

    monkeypatch.setattr(SuffixIndex, "_beside", watched)
    r = random.Random(8)
    rows = [(i, "".join(r.choices("abcdefgh ", k=200))) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = SuffixIndex(spark)
    for k in range(16):
        index.add(B.write_blocks(df.filter(F.col("doc_id") % 16 == k), "doc_id", "text"))
    index.marks()
    one = sum(read[:2]) / 2
    assert 0 < sum(read) < 1.1 * 16 * 4 * one


def test_blocks_stay_whole_when_ids_are_in_no_order(spark, monkeypatch):
    made, write = [], B.write_blocks
    monkeypatch.setattr(B, "write_blocks", lambda *a, **b: made.append(write(*a, **b)) or made[-1])
    r = random.Random(9)
    texts = ["".join(r.choices("abcdefgh ", k=200)) for _ in range(80)]
    rows = [(i, texts[i % 80]) for i in range(160)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = dedup_bytes(df, batch_bytes=4000).collect()
    assert sorted(x.doc_id for x in got if x.n_removed == 200) == list(range(80, 160))
    assert made[0].select("batch").distinct().count() == 8 and made[0].count() <= 2 * 8 + 8
