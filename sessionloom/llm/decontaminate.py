"""Benchmark decontamination with an FM-index per training shard.

Test items become windows of `window` consecutive words (a shorter item is one window). A shard is
some consecutive documents of a scan task. Its text, as word numbers, is indexed: suffix array,
Burrows-Wheeler transform, wavelet matrix with rank counts, and the suffix positions at every
`SAMPLE`th place. All windows are searched backward at once, two ranks per word. The rows found are
walked to the next sampled position, which gives where they occur; overlapping occurrences are merged
to spans.

A shard's index holds the runs of words that test items use, as far as they are as long as the
shortest window, with one separator between runs: no other place can hold a window.

Repeated test items are dropped first; the others go to the tasks as slices of about `SLICE_BYTES` of text,
compressed. A task turns one slice at a time into windows, so neither the driver nor a task ever holds
those of more than one. A pass over the documents takes `PASS_SLICES` slices, which bounds what is broadcast; the
rows with what they have found so far are written before the next pass. Nothing is shuffled.

Words are found by 64-bit hashes of their bytes. Nulls: a null text has no words; a null item id is
the empty string; a null document id stays null. Repeated item ids count once, repeated documents
are judged each. Empty tables: no documents give no rows, no items give no hits. Columns named like
a result column are replaced, all others kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm import blocks as B
from sessionloom.session import scratch_path

WINDOW = 13
SLICE_BYTES = 8 << 20
PASS_SLICES = 32
#: Every so many text positions the suffix array's value is kept.
SAMPLE = 16
OTHER, FIRST_SYMBOL = 1, 2
UPPER_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Bytes that end a word after lower-casing: all of ASCII but digits and small letters.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False

STATE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of words before each text (and after the last)."""
    data, at = B.concat([t.translate(UPPER_TO_LOWER) for t in texts])
    start, end = B.word_bounds(data, MARKS)
    return B.span_hashes(data, start, end), np.searchsorted(start, at)


class Phrases:
    """The windows of a slice of test items as word numbers."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.names = np.array([i for i, _ in items], object)
        hashes, at = words_of([t for _, t in items])
        self.vocabulary = np.unique(hashes)
        symbol = np.searchsorted(self.vocabulary, hashes) + FIRST_SYMBOL
        n = np.minimum(window, np.diff(at))
        windows = np.where(n > 0, np.diff(at) - n + 1, 0)
        self.item, self.length = np.repeat(np.arange(len(n)), windows), np.repeat(n, windows)
        first = np.arange(len(self.item)) + np.repeat(at[:-1] - (np.cumsum(windows) - windows), windows)
        self.words = np.zeros((window, len(first)), np.int32)
        for k in range(window):  # from the end
            live = self.length > k
            self.words[k, live] = symbol[(first + self.length - 1 - k)[live]]
        self.shortest = int(self.length.min(initial=window))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; each round sorts only suffixes that are not yet alone in their group."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    live, rank, width = order, np.empty(n + 1, np.int64), 1
    rank[n] = -1
    new = np.ones(n, bool)
    new[1:] = text[order][1:] != text[order][:-1]
    begin = np.flatnonzero(new)
    group = begin[np.cumsum(new) - 1]
    rank[order] = group
    place = np.arange(n)
    while True:
        size = np.diff(np.append(np.flatnonzero(new), len(live)))
        many = np.repeat(size > 1, size)
        live, place = live[many], place[many]
        if not len(live):
            return order
        head, follow = rank[live], rank[np.minimum(live + width, n)]
        by = np.lexsort((follow, head))
        live, head, follow = live[by], head[by], follow[by]
        order[place] = live
        new = np.ones(len(live), bool)
        new[1:] = (head[1:] != head[:-1]) | (follow[1:] != follow[:-1])
        rank[live] = place[np.flatnonzero(new)][np.cumsum(new) - 1]
        width *= 2


class Wavelet:
    """Wavelet matrix: how often a symbol stands before a place, in one step per bit."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (values >> b) & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        begin = np.zeros(len(symbol), np.int64)
        for b, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            one = (symbol >> b) & 1 == 1
            begin = np.where(one, zeros + ones[begin], begin - ones[begin])
            place = np.where(one, zeros + ones[place], place - ones[place])
        return place - begin


class FMIndex:
    def __init__(self, text: np.ndarray, symbols: int):
        """`text` ends with its only 0."""
        order = suffix_array(text)
        self.bwt = text[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))
        self.wavelet = Wavelet(self.bwt, symbols)
        self.sampled = order % SAMPLE == 0
        self.kept = order[self.sampled]
        self.sample_no = np.cumsum(self.sampled) - 1

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.before[symbol] + self.wavelet.rank(symbol, row)

    def search(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end row of each phrase; words[k] is the word k places from the phrase's end."""
        low, high = np.zeros(len(length), np.int64), np.full(len(length), len(self.bwt))
        live = np.arange(len(length))
        for k in range(len(words)):
            live = live[(length[live] > k) & (low[live] < high[live])]
            low[live], high[live] = self.step(words[k, live], low[live]), self.step(words[k, live], high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        found, live, row = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        steps = 0
        while len(live):
            done = self.sampled[row]
            found[live[done]] = self.kept[self.sample_no[row[done]]] + steps
            live, row = live[~done], row[~done]
            row = self.step(self.bwt[row], row)
            steps += 1
        return found


def searchable(symbol: np.ndarray, doc: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard's text for the index, and the word that each of its places stands for (-1: none)."""
    known = symbol >= FIRST_SYMBOL
    edge = np.ones(len(symbol) + 1, bool)
    edge[1:-1] = (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(edge)
    size = np.diff(begin)
    begin = begin[:-1]
    run = known[begin] & (size >= shortest) if len(begin) else np.zeros(0, bool)
    begin, size = begin[run], size[run] + 1
    before = np.cumsum(size) - size
    word = np.arange(int(size.sum())) + np.repeat(begin - before, size)
    last = before + size - 1
    text = symbol[np.minimum(word, len(symbol) - 1)] if len(word) else word
    text[last] = OTHER
    word[last] = -1
    return np.append(text, 0), np.append(word, -1)


def merged(hit: np.ndarray) -> np.ndarray:
    """Starts and ends, in turn, of the runs of true values."""
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))


def occurrences(phrases: Phrases, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, first word) of every place of the shard where a phrase occurs."""
    at = np.searchsorted(phrases.vocabulary, hashes)
    at = np.minimum(at, max(0, len(phrases.vocabulary) - 1))
    known = phrases.vocabulary[at] == hashes if len(phrases.vocabulary) else np.zeros(len(hashes), bool)
    text, word = searchable(np.where(known, at + FIRST_SYMBOL, OTHER), doc, phrases.shortest)
    index = FMIndex(text, len(phrases.vocabulary) + FIRST_SYMBOL)
    low, high = index.search(phrases.words, phrases.length)
    n = np.maximum(0, high - low)
    rows = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
    return np.repeat(np.arange(len(n)), n), word[index.locate(rows)]


class Slices:
    """The slices of a pass in a task; the windows of one slice are held at a time."""

    def __init__(self, packed: list[Broadcast], window: int):
        self.packed, self.window, self.no, self.now = packed, window, -1, None

    def phrases(self, no: int) -> Phrases:
        if no != self.no:
            self.now = None
            self.no, self.now = no, Phrases(B.unpack(self.packed[no].value), self.window)
        return self.now


def _search(packed: list[Broadcast], window: int, text_at: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = Slices(packed, window)
        for batch in batches:
            texts = [t or b"" for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
            spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            n_words = np.zeros(len(texts), np.int64)
            size = np.cumsum([len(t) for t in texts])
            cut = np.flatnonzero(np.diff(size // B.BLOCK_BYTES, prepend=-1)) if len(texts) else []
            for i, j in zip(cut, [*cut[1:], len(texts)]):
                hashes, at = words_of(texts[i:j])
                n_words[i:j] = np.diff(at)
                doc = np.repeat(np.arange(j - i), np.diff(at))
                for no in range(len(packed)):
                    phrases = slices.phrases(no)
                    if not len(phrases.length):
                        continue
                    phrase, first = occurrences(phrases, hashes, doc)
                    edge = np.bincount(first, minlength=len(hashes) + 1)
                    edge -= np.bincount(first + phrases.length[phrase], minlength=len(hashes) + 1)
                    hit = np.cumsum(edge) > 0
                    pairs = np.unique(doc[first] * len(phrases.names) + phrases.item[phrase])
                    for d in np.unique(doc[first]):
                        own = hit[at[d] : at[d + 1]].copy()
                        for s, e in zip(spans[i + d][::2], spans[i + d][1::2]):
                            own[s:e] = True
                        spans[i + d] = merged(own).tolist()
                    for d, item in zip(*divmod(pairs, len(phrases.names))):
                        items[i + d].append(phrases.names[item])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-3], pa.array(n_words),
                    pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())),
                ],
                names=batch.schema.names,
            )

    return search


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
    slice_bytes: int = SLICE_BYTES, pass_slices: int = PASS_SLICES,
) -> DataFrame:
    """All rows and columns of `docs` with n_words, spans and items.

    `spans` has start and end, in turn, of the merged runs of hit words; `items` the ids, as text and
    sorted, of the items whose windows occur.
    """
    spark = docs.sparkSession
    tests = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"),
        F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("t"),
    ).distinct()
    total = tests.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first().b
    n = max(1, -(-int(total) // slice_bytes))
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in STATE.names])
    schema = T.StructType(list(rows.schema) + list(STATE))
    found = rows.withColumns(
        {
            "n_words": F.lit(0).cast("long"), "spans": F.expr("cast(array() as array<int>)"),
            "items": F.expr("cast(array() as array<string>)"),
        }
    )
    at = rows.columns.index(text_col)
    for begin in range(0, n, pass_slices):
        packed = []
        for k in range(begin, min(n, begin + pass_slices)):
            part = tests.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
            packed.append(spark.sparkContext.broadcast(B.pack([(r.i, r.t.encode()) for r in part])))
        found = found.mapInArrow(_search(packed, window, at), schema)
        if begin + pass_slices < n:
            path = scratch_path(spark, "contamination")
            found.write.parquet(path)
            found = spark.read.schema(schema).parquet(path)
            for p in packed:
                p.destroy()
    return found.withColumn("items", F.array_sort(F.array_distinct("items")))


def contaminated(n_words, n_hit):
    """At least one word hit, and a twentieth of all words."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def n_hit(spans):
    """How many words lie in the spans."""
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x)
