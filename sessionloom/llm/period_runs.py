"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q, of `LEAST` words and three periods at
least, that no neighbouring word extends with that period. A document's basic factors are its stretches
of 1, 2, 4, ... words; equal ones share a name, and the names of one length follow from pairs of names
of half the length. Two occurrences of a factor of L words that lie within 2 L words are at most L apart, and
occurrences so close form an arithmetic progression whose difference is the factor's period. So each factor's
successor proposes a period, and a run of period q shows at the least power L of two not below q: there every
place but the run's last L + q - 1 words has its successor q words on, because a smaller distance would
mean a smaller period of the whole run. Neighbouring places with one distance make a candidate,
which is extended word by word; candidates found twice count once.

Factors that occur once in their document cannot be part of longer ones that recur, so only the others are
named again; prose leaves few after two or three lengths. Words are compared by their bytes. A task takes
documents in chunks; nothing is shuffled.

Defined cases: a null text, an empty and a blank one have no words and no runs. Texts of any length are
taken whole. Repeated rows and rows with null ids are repeated. An empty table gives no rows. All input
columns but `n_runs`, `runs` and `kept_text` are returned; these three are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 24
TIMES = 3
CHUNK_BYTES = 4 << 20
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FOUND = [
    T.StructField("n_runs", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
    T.StructField("kept_text", T.StringType()),
]
Run = tuple[int, int, int]


def word_codes(documents: list[list[bytes]]) -> np.ndarray:
    """One number per distinct word, of all documents end to end."""
    words = pa.array(chain.from_iterable(documents), pa.binary())
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def successors(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For factors at ascending `place` named by `key`: new names from 0 on (-1 if it occurs once), how far
    the next occurrence is (0 if there is none), and the number of names."""
    if not len(key):
        return key, key, 1
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    gap = np.zeros(len(key), np.int64)
    gap[order[:-1][same]] = (place[order[1:]] - place[order[:-1]])[same]
    several = np.concatenate((same, [False])) | np.concatenate(([False], same))
    number = np.cumsum(np.concatenate(([True], ~same)))
    name = np.full(len(key), -1, np.int64)
    name[order[several]] = number[several]
    return name, gap, int(number[-1]) + 1


def candidates(place: np.ndarray, gap: np.ndarray, length: int) -> Iterator[Run]:
    """(start, length, period) of what neighbouring places with one distance above length / 2 and up to
    `length` span."""
    near = np.flatnonzero((2 * gap > length) & (gap <= length))
    if not len(near):
        return
    at, period = place[near], gap[near]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])
    begin = np.flatnonzero(first)
    size = at[np.append(begin[1:], len(at)) - 1] - at[begin] + length + period[begin]
    yield from zip(at[begin].tolist(), size.tolist(), period[begin].tolist())


def extended(code: np.ndarray, run: Run, begin: int, end: int) -> Run:
    """The run drawn out to both sides as far as words a period apart are equal."""
    start, length, q = run
    stop = start + length
    while start > begin and code[start - 1] == code[start - 1 + q]:
        start -= 1
    while stop < end and code[stop] == code[stop - q]:
        stop += 1
    return start, stop - start, q


def find_runs(code: np.ndarray, size: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """Runs of each document by start, then period; `code` numbers the words of all documents end to
    end, `size` is how many each has. `times` is 3 at least, for which the method is complete."""
    if times < 3:
        raise ValueError("runs of fewer than three periods are not found by successors alone")
    end = np.cumsum(size)
    begin = end - size
    doc = np.repeat(np.arange(len(size)), size)
    found: list[set[Run]] = [set() for _ in size]
    place = np.flatnonzero((size >= max(least, times))[doc])
    width = int(code.max()) + 1 if len(code) else 1
    name, gap, names = successors(doc[place] * width + code[place], place)
    length = 1
    while len(place):
        for run in candidates(place, gap, length):
            d = doc[run[0]]
            start, n, q = extended(code, run, begin[d], end[d])
            if n >= max(least, times * q):
                found[d].add((int(start - begin[d]), int(n), q))
        # The next length's periods are longer than `length`; it needs room for `times` of them.
        live = (name >= 0) & (size[doc[place]] >= times * (length + 1))
        known = np.full(len(code), -1, np.int64)
        known[place[live]] = name[live]
        first = place[live]
        first = first[first + 2 * length <= end[doc[first]]]
        place = first[known[first + length] >= 0]
        name, gap, names = successors(known[place] * names + known[place + length], place)
        length *= 2
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def kept_places(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay if of every run the first period alone does (of what no other run drops)."""
    cover = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return np.cumsum(cover[:-1]) == 0


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a repetition that the document's id decides on, for one id in ten."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // len(unit))))[: n - a]


def _scan(id_at: int, text_at: int, change: Callable | None, columns: list[str]):
    def results(batch: pa.RecordBatch, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        documents = [t.split() for t in texts]
        if change is not None:
            documents = [change(i, w) for i, w in zip(ids, documents)]
        size = np.array([len(w) for w in documents], np.int64)
        runs = find_runs(word_codes(documents), size)
        kept = []
        for words, own in zip(documents, runs):
            if own:
                words = [words[k] for k in np.flatnonzero(kept_places(len(words), own))]
            kept.append(b" ".join(words))
        rows = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs]
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        new = {
            "n_runs": pa.array([len(r) for r in runs], pa.int64()), "runs": pa.array(rows, kind),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        }
        own = dict(zip(batch.schema.names, batch.columns))
        return pa.RecordBatch.from_arrays([new[c] if c in new else own[c] for c in columns], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(id_at).to_pylist()
            texts = [t or b"" for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
            at, bytes_ = 0, 0
            for k, t in enumerate(texts):
                bytes_ += len(t)
                if bytes_ >= CHUNK_BYTES or k + 1 == len(texts):
                    yield results(batch.slice(at, k + 1 - at), ids[at : k + 1], texts[at : k + 1])
                    at, bytes_ = k + 1, 0

    return run


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    change: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """All columns, and n_runs, runs (start, length, period; by start, then period) and kept_text: the words
    that no run holds after its first period, joined by one blank.

    `change`, a function of (id, words), is applied to the words first.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in {f.name for f in FOUND}])
    names = rows.columns
    schema = T.StructType([*rows.schema, *FOUND])
    return rows.mapInArrow(_scan(names.index(id_col), names.index(text_col), change, schema.names), schema)
