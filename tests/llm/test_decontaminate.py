"""Contamination against a brute-force version."""

import hashlib
import random
import re

import numpy as np
import pytest

from sessionloom.llm import decontaminate as D
from sessionloom.llm.queries import op3_result

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    out = {}
    for i, t in docs:
        w = words(t)
        gone, names = [False] * len(w), set()
        for name, text in items:
            v = words(text)
            n = min(window, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        gone[p : p + n] = [True] * n
                        names.add("" if name is None else str(name))
        out[i] = (len(w), sum(gone), sorted(names))
    return out


def test_suffix_array():
    r = np.random.default_rng(1)
    for n, s in [(1, 2), (50, 3), (300, 2), (400, 1)]:
        text = np.append(r.integers(1, s + 1, n), 0)
        assert D.suffix_array(text).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("seed,slice_bytes,pass_slices", [(1, 1 << 20, 32), (2, 300, 32), (3, 300, 2)])
def test_equals_brute_force(spark, seed, slice_bytes, pass_slices):
    r = random.Random(seed)
    vocabulary = ["Éa", "b", "the", "x9"] + [f"w{i}" for i in range(12)]
    phrase = lambda k: " ".join(r.choices(vocabulary, k=k))
    items = [(k, phrase(r.choice([0, 3, 6, 13, 25]))) for k in range(12)]
    items += [(3, phrase(20)), (None, phrase(15)), (77, None), (78, "..")] + items[:3] * 5
    docs = []
    for i in range(80):
        parts = [phrase(r.randint(0, 20)), "zz", phrase(5)]
        if r.random() < 0.6:
            parts.insert(1, r.choice(items)[1] or "")
        docs.append((i, "-, ".join(parts).upper() if i % 3 else "\n".join(parts)))
    docs += [(500, None), (501, ""), (502, "the " * 3000)]
    found = D.find_contamination(
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as items", "3 as id").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"), slice_bytes=slice_bytes,
        pass_slices=pass_slices,
    )
    want = brute(docs, items)
    for row in found.collect():
        n = sum(b - a for a, b in zip(row.spans[::2], row.spans[1::2]))
        assert (row.n_words, n, row.items) == want[row.doc_id]
    for row in op3_result(found).collect():
        n, hit, names = want[row.doc_id]
        assert (row.n_words, row.n_hit, row.n_items) == (n, hit, len(names))
        assert row.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert row.contaminated == (hit > 0 and 20 * hit >= n)


def test_windows_of_items():
    """Against windows made one by one."""
    texts = ["", "a", "b c", "d e f g h", "h"]
    p = D.Phrases([(str(k), t.encode()) for k, t in enumerate(texts)], 3)
    want = []
    for k, t in enumerate(texts):
        w = t.split()
        n = min(3, len(w))
        want += [(k, w[s : s + n]) for s in range(len(w) - n + 1) if n]
    code = {int(h): w for h, w in zip(D.words_of([b"a b c d e f g h"])[0], "abcdefgh")}
    word = lambda x: code[int(p.vocabulary[x - D.FIRST_SYMBOL])]
    got = [(i, [word(p.words[k, c]) for k in range(n - 1, -1, -1)]) for c, (i, n) in enumerate(zip(p.item, p.length))]
    assert got == want and p.shortest == 1


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [r.spans for r in D.find_contamination(docs, items).collect()] == [[]]
    assert D.find_contamination(docs.limit(0), items).collect() == []
