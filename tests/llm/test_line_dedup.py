"""Removed lines against a brute-force version that knows no chunks, and the chunks' shift resistance."""

import random

import pytest

from sessionloom.llm.line_dedup import LONG_WORDS, Chunks, dedup_lines


def chunks(text):
    c = Chunks([text.encode()])
    return [text.encode()[c.lines.start[i] : c.lines.end[j]].decode() for i, j in zip(c.first, c.last)]


def brute(rows):
    """Texts by row; `rows` in the order in which occurrences count. A line goes if it and a neighbour
    with text stood together before, or if it is long and stood anywhere before."""
    seen, out = set(), []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        dark = [k for k, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c")]
        gone = set()
        units = [(a, b) for a, b in zip(dark, dark[1:])]
        units += [(k, k) for k in dark if len(lines[k].encode().split()) >= LONG_WORDS]
        for a, b in sorted(units):
            key = tuple(lines[a : b + 1])
            if key in seen:
                gone.update(range(a, b + 1))
            seen.add(key)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    return out


def test_boundaries_resist_shifts():
    r = random.Random(1)
    lines = [f"line {r.random()}" for _ in range(60)]
    a, b = chunks("\n".join(lines)), chunks("\n".join(["new", *lines[:20], "inserted", *lines[20:]]))
    assert "\n".join(a) == "\n".join(lines) and len(a) > 8
    assert len(set(a) & set(b)) >= len(a) - 4


@pytest.mark.parametrize("seed,block_bytes", [(1, 8 << 20), (2, 400)])
def test_equals_brute_force(spark, seed, block_bytes):
    r = random.Random(seed)
    lines = [f"line {i}" for i in range(50)] + ["", " ", "É", "\r"]
    passages = [r.choices(lines, k=8) for _ in range(5)]
    rows = []
    for i in range(120):
        body = r.choices(lines, k=r.randint(0, 6))
        if r.random() < 0.5:
            body[1:1] = r.choice(passages)
        rows.append((i, "\n".join(body)))
    rows += [(300, None), (301, ""), (302, "\n\n\n"), (303, "long line\n" * 20000), (304, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as n_lines", "1 as data", "2 as block")
    got = dedup_lines(df.repartition(4), block_bytes=block_bytes).collect()
    assert sorted((x.doc_id, x.text, x.n_lines, x.n_removed) for x in got if x.text is not None) == sorted(
        x for x in brute(rows) if x[1] is not None
    )
    assert [(x.data, x.block) for x in got] == [(1, 2)] * len(rows)
    assert dedup_lines(df.limit(0)).collect() == []


def test_repeated_and_null_ids(spark):
    text = "\n".join(f"l{i}" for i in range(30))
    df = spark.createDataFrame([(None, text), (1, text), (1, text)], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id is None, r.n_removed) for r in dedup_lines(df).collect())
    assert got == [(False, 0), (False, 30), (True, 30)]


@pytest.mark.parametrize("seed", range(4))
def test_passages_over_many_blocks(spark, seed):
    """Whole, cut and overlapping passages, some with blank lines, in blocks of a few lines to some documents each."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(30)]
    line = lambda n: " ".join(r.choices(words, k=n))
    pool = [line(r.choice([1, 2, 3, 55])) for _ in range(25)] + ["", "", " "]
    passages = [r.choices(pool, k=r.randint(2, 12)) for _ in range(12)]
    rows = []
    for i in range(150):
        body = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            body += p[a : a + r.randint(1, 12)] + r.choices([*pool, f"own {i}"], k=r.randint(0, 2))
        rows.append((i, "\n".join(body)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: (x.text, x.n_removed) for x in dedup_lines(df, block_bytes=r.choice([100, 700, 5000])).collect()}
    assert got == {i: (t, n) for i, t, _, n in brute(rows)}


def test_no_chunk_of_one_line():
    r = random.Random(3)
    for n in range(2, 60):
        assert all("\n" in c for c in chunks("\n".join(f"line {r.random()}" for _ in range(n))))


@pytest.mark.parametrize("block_bytes", [8 << 20, 2000])
def test_long_repeated_passages_go_whole(spark, block_bytes):
    """Passages of over 50 words on one to three lines, in the middle of other text."""
    r = random.Random(8)
    line = lambda n: " ".join(f"w{r.randrange(9000)}" for _ in range(n))
    passages = [[line(55)], [line(30), line(30)], [line(20), line(20), line(20)], [line(60), line(5)], [line(26) for _ in range(6)]]
    rows, want = [], {}
    for i in range(40):
        before, after = [line(12) for _ in range(3)], [line(12) for _ in range(2)]
        rows.append((i, "\n".join([*before, *passages[i % 5], *after])))
        want[i] = "\n".join([*before, *(passages[i % 5] if i < 5 else []), *after])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x.doc_id: x.text for x in dedup_lines(df, block_bytes=block_bytes).collect()} == want
