"""Round trip of all ids, gapless sequences and little padding."""

import random
from collections import defaultdict
from unicodedata import normalize

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from sessionloom.llm.packing import TAIL, _tokenizer, pack_documents, shortest_pack_first, token_ids  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_patterns_use_every_piece_once():
    r = random.Random(2)
    for _ in range(50):
        histogram = {r.randint(1, 64): r.randint(1, 50) for _ in range(r.randint(1, 30))}
        used = defaultdict(int)
        for pattern, count in shortest_pack_first(histogram, 64):
            assert sum(s * k for s, k in pattern) <= 64
            for s, k in pattern:
                used[s] += k * count
        assert used == histogram
    # The emptiest pack is filled first.
    assert shortest_pack_first({9: 1, 6: 1, 2: 1}, 10) == [(((9, 1),), 1), (((6, 1), (2, 1)), 1)]


def odd_letters():
    """Code points that change when lowered or composed."""
    for c in map(chr, range(128, 0x110000)):
        if not 0xD800 <= ord(c) < 0xE000 and (c.lower() != c or normalize("NFC", c) != c):
            yield c


def same_ids(texts):
    tokenizer = Tokenizer.from_file(PATH)
    ids, at = token_ids([t.encode() for t in texts], _tokenizer(PATH))
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return [t for t, i, j, w in zip(texts, at, at[1:], want) if ids[i:j].tolist() != w]


def test_ids_of_odd_letters_beside_marks():
    letters = [*odd_letters(), "\u0130", "\u00df", "\u01c5", "\u0345"]
    for mark in [*TAIL, "!?"]:
        assert same_ids([t for c in letters for t in (c + mark, f"a{c}{mark}", mark + c, f"{c}a{mark}{c}")]) == []


def test_ids_of_random_texts():
    r = random.Random(6)
    bits = ["\u0130", "\u0131", "\u00df", "\u1e9e", "\u03a3", "\u0149", "\u01f0", "\u0345", "\u00e9", "e\u0301", "a", "Z", "7", "\u00b2", "'s", " ", "\n", "\u00a0", *TAIL]
    assert same_ids(["".join(r.choices(bits, k=r.randint(0, 12))) for _ in range(10_000)]) == []


@pytest.mark.parametrize("length", [2048, 32])
def test_round_trip(spark, length):
    r = random.Random(1)
    bits = ["Hello", "<|endoftext|>", "world's", " ", "\n", "é", "é", " ", "\x1c", "日本", "2024", "...", " ́a", "\r\n", "\t", ",", "<|EndOfText|>", "x).", "É.", "ΑΣ!", "it's.", "<|startoftext|>.", "²,", "e\u0301.", "=\u0338", "\x0b", "\x0c", "a,b"]
    rows = [(i, "".join(r.choices(bits, k=r.randint(0, 60)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "word " * 9000), (None, "same"), (None, "same"), (5, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as ids").repartition(3)
    got = pack_documents(df, PATH, length=length).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    whole = defaultdict(dict)
    sequences = defaultdict(list)
    for p in got:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length <= length
        sequences[p.sequence_id].append((p.offset, p.length))
        if p.doc_id is not None and p.doc_id != 5:
            whole[p.doc_id][p.start] = ids
            assert p.doc_tokens == len(want[p.doc_id][0])
    for i, parts in whole.items():
        assert [x for s in sorted(parts) for x in parts[s]] == want[i][0]
    assert sum(p.length for p in got) == sum(len(x) for v in want.values() for x in v)
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= length
    if length == 32:
        assert sum(p.length for p in got) > 0.95 * 32 * len(sequences)
    assert pack_documents(df.limit(0), PATH).collect() == []
