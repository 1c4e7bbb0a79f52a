"""Spans against Python's regular expressions; mandatory trigrams; no Python on the executors."""

import random
import re

from sessionloom.llm import secret_scan as S
from sessionloom.llm.queries import op10_result

BASE = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    ("hex", r"[0-9a-f]+", 0, 0, 24),
]


def brute(text):
    out = []
    for k, (kind, pattern, flags, group, least) in enumerate(BASE):
        for m in re.finditer(pattern, text or "", flags):
            if len(m[group]) >= least:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def counts(text):
    return tuple(sum(x[1] == k for x in brute(text)) for k in range(3))


def test_counts_of_single_kinds_and_of_several_of_one_kind(spark):
    key, run = "AKIA" + "A1B2" * 5, "0f" * 15
    rows = [
        ("token=abcdef token=ghijkl", (2, 0, 0)), (run, (0, 0, 1)), (key, (0, 1, 0)), (f"{key} {key} {key}", (0, 3, 0)),
        (f"{run} {run}", (0, 0, 2)), (f"{run} secret: abcdefg {key} {run} {key}", (1, 2, 2)), ("", (0, 0, 0)), (None, (0, 0, 0)),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in op10_result(S.scan_secrets(df)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}


def test_many_mandatory_trigrams(spark):
    """More trigrams than one word of bits holds."""
    words = [f"{a}{b}marker" for a in "bcdfghjk" for b in "qwrtzpxv"]
    rules = [S.Rule(w, w) for w in words]
    assert len({t for w in words for t in S._trigrams(w)}) > 63
    rows = [(i, f"{w} {words[-1 - i]}") for i, w in enumerate(words)] + [(99, "bqmarke"), (98, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: {rules[s.order].kind for s in r.found} for r in S.scan_secrets(df, rules=rules).collect()}
    assert got == {i: {w for w in words if w in (t or "")} for i, t in rows}


def test_trigram_queries():
    assert S.trigram_query(r"AKIA[A-Z0-9]{16,}") == {frozenset({"aki", "kia"})}
    assert S.trigram_query(r"[0-9a-f]{24,}") == set()
    assert S.trigram_query(S.RULES[0].pattern) == {
        S._trigrams(w) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")
    }
    assert S.trigram_query(r"ab+cde|x") == set()
    assert S.trigram_query(r"(abc|xyz1)+q*") == {frozenset({"abc"}), frozenset({"xyz", "yz1"})}


def test_equals_brute_force(spark):
    r = random.Random(3)
    bits = ["password", "PassWd", "api_key", "apikey", "token", "AKIA", "KIA", "0123456789abcdef", "deadbeef", ":", "=", '"',
            "'", " ", "  ", "\n", "é", "😀", "AAAABBBBCCCCDDDD", "x", "abc123", "secret", "K", "-_.", "\x00", "|"]
    rows = [(i, "".join(r.choices(bits, k=r.randint(0, 40)))) for i in range(400)]
    rows += [(None, "token=abcdef"), (None, None), (7, "secret: abcdefg"), (900, None), (901, "password: token: abcdefgh")]
    rows += [(902, "z" * 100_000 + " token='abcdefgh'" + "0f" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as found", "3 as kinds")
    found = S.scan_secrets(df)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = [(r.id, [(s.start, s.order, s.end) for s in r.found]) for r in found.collect()]
    want = [(i, [x[:3] for x in brute(t)]) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    result = op10_result(found).collect()
    counted = [(r.doc_id, r.n_assign, r.n_access, r.n_hex) for r in result]
    assert sorted(counted, key=str) == sorted(((i, *counts(t)) for i, t in rows), key=str)
    texts = {r.doc_id: r.spans for r in result}
    assert texts[902] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute(rows[-1][1]))
    assert S.scan_secrets(df.limit(0)).collect() == []
