"""Runs against a search over all periods."""

import random
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from sessionloom.llm import period_runs as R
from sessionloom.llm.queries import op12_result


def brute(words):
    """For every period the maximal stretches with it; of a stretch the smallest period counts."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        start = None
        for x in range(n - q + 1):
            if x < n - q and words[x] == words[x + q]:
                start = x if start is None else start
            elif start is not None:
                length = x - start + q
                if length >= max(24, 3 * q) and not any(
                    length > p and all(words[y] == words[y + p] for y in range(start, start + length - p)) for p in range(1, q)
                ):
                    found[start, length, q] = True
                start = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    n, h = len(words), crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = (g % n), None
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    sha = lambda s: sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)),
    )


def some_words(r):
    letters = "ab" if r.random() < 0.5 else "abcdefgh"
    words = r.choices(letters, k=r.randint(0, 40))
    for _ in range(r.randint(0, 4)):
        unit = r.choices(letters, k=r.randint(1, 12)) if r.random() < 0.7 else words[-r.randint(1, 20) :]
        words += unit * r.randint(1, 9) + unit[: r.randint(0, len(unit))]
        words += r.choices(letters, k=r.randint(0, 5))
    if words and r.random() < 0.3:
        words[r.randrange(len(words))] = "x"
    return words


@pytest.mark.parametrize("seed", range(6))
def test_equals_brute_force(seed):
    r = random.Random(seed)
    docs = [some_words(r) for _ in range(150)]
    docs += [["a"] * k for k in (23, 24, 25, 100)] + [["a", "b"] * 12, ["a", "a", "b"] * 8, []]
    code = R.word_codes([[w.encode() for w in d] for d in docs])
    assert R.find_runs(code, np.array([len(d) for d in docs])) == [brute(d) for d in docs]


def test_fibonacci_and_cube_rich_words():
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    docs = [list(b[:400]), list("aabaabaab" * 12), list(("aab" * 3 + "b") * 14), list("abcabcabd" * 9)]
    code = R.word_codes([[w.encode() for w in d] for d in docs])
    found = R.find_runs(code, np.array([len(d) for d in docs]))
    assert found == [brute(d) for d in docs]
    assert found[0] and found[2]


def test_query_result(spark):
    r = random.Random(8)
    rows = [(i, r.choice(" \t\n\x0b").join(some_words(r))) for i in range(300)]
    rows += [(None, "a b " * 20), (None, None), (301, None), (302, ""), (303, " \r\x0c "), (5, "same " * 30), (5, "same " * 30)]
    rows += [(304, "é ü " * 40), (305, "x " * 300 + " ".join(map(str, range(5000))))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_runs", "2 as runs", "'z' as start")
    got = op12_result(R.periodic_runs(df.repartition(4), change=R.planted))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((digest(*x) for x in rows), key=str)
    assert R.periodic_runs(df.limit(0)).collect() == []
    kept = R.periodic_runs(df).columns
    assert kept == ["doc_id", "text", "start", "n_runs", "runs", "kept_text"]


def test_very_long_text():
    words = [str(k).encode() for k in range(100_000)] + [b"p", b"q"] * 50_000 + [str(k % 30_000).encode() for k in range(95_000)]
    assert R.find_runs(R.word_codes([words]), np.array([len(words)])) == [[(100_000, 100_000, 2), (200_000, 95_000, 30_000)]]
