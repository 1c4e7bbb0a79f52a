"""Packing tokenised documents into sequences by shortest-pack-first over the length histogram.

Each document is tokenised, ended with one id, and cut into full sequences and a rest. Only the
histogram of piece lengths goes to the driver; it has at most `length` rows. There the lengths
are placed from the longest to the shortest: pieces of one length go, as many as there are, into the kinds of
packs with the most free space, and where no kind has room new packs begin. What comes out is a list of
patterns and how many sequences follow each; it is bounded by the histogram, not by the documents.
Pieces are then joined to patterns by rank: a piece's rank among those of its length says which
slot of which sequence it fills. Ranks are counted inside each chunk of a scan task and completed by
the chunks' totals, so a length that a third of all documents have is not gathered anywhere.

Texts are tokenised by distinct words: the tokenizer drops white space, so a text's ids are those of
its parts between ASCII white space; marks at a word's end are such a part too. Pieces are written once before they are counted.

Defined cases: a null text is empty and gives the end id alone. Null, repeated and equal ids make
pieces like any others. Very long texts give many full pieces. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.session import scratch_path

LENGTH = 2048
END_ID = 1
CHUNK_BYTES = 12 << 20
#: Marks that are split from the end of a word.
TAIL = ".,!?*#$%&;:"
#: Words of letters that are encoded in one call.
TOGETHER = 64
#: So many words' ids a worker keeps.
KNOWN_WORDS = 250_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, block long, rank long, ids binary"
_TOKENIZERS: dict = {}


class Tokenized:
    """A tokenizer in a worker, which of its tokens end a word, and the words it has lately met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.word_end[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)


def _tokenizer(path: str) -> Tokenized:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Tokenized(path)
    return _TOKENIZERS[path]


def _split_tails(words: pa.Array) -> tuple[pa.Array, list[str]]:
    """Words without the marks at their end, and these, which are tokens of their own after a letter or digit.

    Only after an ASCII one: others may end in something else once the tokenizer has normalised them.
    """
    stem = pc.utf8_rtrim(words, characters=TAIL)
    apart = pc.and_(
        pc.and_(pc.match_substring_regex(stem, "[a-z0-9]$"), pc.not_equal(stem, words)),
        pc.invert(pc.match_substring(words, "<|")),
    )
    cut = np.flatnonzero(apart.to_numpy(zero_copy_only=False))
    tails = [""] * len(words)
    for k, w, t in zip(cut.tolist(), words.take(cut).to_pylist(), stem.take(cut).to_pylist()):
        tails[k] = w[len(t) :]
    return pc.if_else(apart, stem, words), tails


def encode_words(words: list[str], tokenizer: Tokenized) -> list[bytes]:
    """Ids of each word, four bytes each.

    Words of letters alone are encoded together: each of them ends with its only word-end token.
    """
    out = [tokenizer.known.get(w) for w in words]
    new = [k for k, b in enumerate(out) if b is None]
    plain = [k for k in new if words[k].isalpha()]
    groups = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
    for at in range(0, len(groups), 64):
        some = groups[at : at + 64]
        joined = [" ".join([words[k] for k in g]) for g in some]
        for g, e in zip(some, tokenizer.encode(joined)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(tokenizer.word_end[ids]) + 1
            if len(ends) == len(g) and ends[-1] == len(ids):  # else they are encoded one by one
                data, begin = ids.tobytes(), 0
                for k, end in zip(g, (4 * ends).tolist()):
                    out[k] = data[begin:end]
                    begin = end
    rest = [k for k in new if out[k] is None]
    for at in range(0, len(rest), 4096):
        some = rest[at : at + 4096]
        for k, e in zip(some, tokenizer.encode([words[k] for k in some])):
            out[k] = np.array(e.ids, "<u4").tobytes()
    if len(tokenizer.known) + len(new) > KNOWN_WORDS:
        tokenizer.known.clear()
    tokenizer.known.update((words[k], out[k]) for k in new[:KNOWN_WORDS] if len(words[k]) < 40)
    return out


def token_ids(texts: list[bytes], tokenizer: Tokenized) -> tuple[np.ndarray, np.ndarray]:
    """All ids of all texts end to end, and where each text's begin (and the last's end)."""
    # The tokenizer lowers letters but for those of its special tokens.
    split = [(t if b"<|" in t else t.lower()).split() for t in texts]
    offsets = np.cumsum([0, *map(len, split)])
    coded = pa.array(chain.from_iterable(split), pa.binary()).cast(pa.string()).dictionary_encode()
    del split
    distinct = coded.dictionary
    stems, tails = _split_tails(distinct)
    stems = stems.dictionary_encode()
    stem_ids = encode_words(stems.dictionary.to_pylist(), tokenizer)
    marks = sorted(set(tails))
    mark_ids = dict(zip(marks, encode_words(marks, tokenizer)))
    parts = [stem_ids[k] + mark_ids[t] for k, t in zip(stems.indices.to_pylist(), tails)]
    size = np.array([len(p) for p in parts], np.int32) // 4
    begin = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(parts), "<u4")
    code = coded.indices.to_numpy(zero_copy_only=False)
    n = size[code] if len(code) else np.zeros(0, np.int32)
    before = np.concatenate(([0], np.cumsum(n)))
    shift = (begin[code] - before[:-1]).astype(np.int32) if len(code) else n
    ids = flat[np.arange(before[-1], dtype=np.int32) + np.repeat(shift, n)] if before[-1] else flat[:0]
    return ids, before[offsets]


def _pieces(path: str, length: int, end_id: int, keep_ids: bool):
    def piece_rows(doc_ids: list, texts: list, block: int) -> pa.RecordBatch:
        ids, at = token_ids(texts, _tokenizer(path))
        total = np.diff(at) + 1
        n = -(-total // length)
        doc = np.repeat(np.arange(len(texts)), n)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * length
        size = np.minimum(length, total[doc] - start)
        last = start + size == total[doc]
        data = []
        for d, s, k, e in zip(doc, start, size, last):
            own = ids[at[d] + s : at[d] + s + k - e].astype("<u4").tobytes()
            data.append(own + end_id.to_bytes(4, "little") if e else own)
        order = np.argsort(size, kind="stable")
        first = np.flatnonzero(np.diff(size[order], prepend=0))
        rank = np.empty(len(size), np.int64)
        rank[order] = np.arange(len(size)) - np.repeat(first, np.diff(np.append(first, len(size))))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([doc_ids[d] for d in doc], pa.int64()), pa.array(start), pa.array(size),
                pa.array([zlib.crc32(x) for x in data], pa.int64()), pa.array(total[doc]),
                pa.array(np.full(len(doc), block)), pa.array(rank),
                pa.array(data if keep_ids else [None] * len(data), pa.binary()),
            ],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "block", "rank", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, no = TaskContext.get().partitionId() << 24, 0
        doc_ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                doc_ids.append(i)
                texts.append(t or b"")
                size += len(t or b"") + 16
                if size >= CHUNK_BYTES:
                    yield piece_rows(doc_ids, texts, base + no)
                    doc_ids, texts, size, no = [], [], 0, no + 1
        if texts:
            yield piece_rows(doc_ids, texts, base + no)

    return run


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((piece length, how many), ...), longest first, each with its number of sequences."""
    kinds: dict[int, list] = defaultdict(list)  # free space: patterns with counts
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        space = length
        while left:
            while space >= size and not kinds.get(space):
                space -= 1
            if space < size:
                kinds[length - size].append((((size, 1),), left))
                break
            pattern, count = kinds[space].pop()
            used = min(left, count)
            if used < count:
                kinds[space].append((pattern, count - used))
            if pattern[-1][0] == size:
                grown = (*pattern[:-1], (size, pattern[-1][1] + 1))
            else:
                grown = (*pattern, (size, 1))
            kinds[space - size].append((grown, used))
            left -= used
    return [p for space in sorted(kinds) for p in kinds[space]]


class Slots:
    """Where the pieces of each length go by rank; one entry per length of a pattern."""

    def __init__(self, patterns: list[tuple[tuple[tuple[int, int], ...], int]]):
        rows, sequence = [], 0
        taken: dict[int, int] = defaultdict(int)
        for pattern, count in patterns:
            offset = 0
            for size, times in pattern:
                rows.append((size, taken[size], sequence, offset, times))
                taken[size] += count * times
                offset += size * times
            sequence += count
        rows.sort()
        self.size, self.rank, self.sequence, self.offset, self.times = np.array(rows, np.int64).reshape(-1, 5).T
        self.place = self.size << 48 | self.rank

    def of(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.place, size << 48 | rank, side="right") - 1
        sequence, turn = np.divmod(rank - self.rank[at], self.times[at])
        return self.sequence[at] + sequence, self.offset[at] + turn * size


def _place(slots: Slots, width: int):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = slots.of(size, rank)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(sequence), pa.array(offset)],
                names=[*batch.schema.names[:width], "sequence_id", "offset"],
            )

    return place


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    length: int = LENGTH, end_id: int = END_ID, ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    With `ids` also the piece's ids, as little-endian 32-bit numbers.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = rows.mapInArrow(_pieces(tokenizer_path, length, end_id, ids), PIECE)
    (made if ids else made.drop("ids")).write.option("compression", "zstd").parquet(path)
    pieces = spark.read.parquet(path)
    per_chunk = pieces.groupBy("block", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in per_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = Slots(shortest_pack_first(histogram, length))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = per_chunk.select("block", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if ids else [])]
    ranked = pieces.join(before, ["block", "length"]).select(*columns, (F.col("rank") + F.col("before")).alias("rank"))
    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_place(slots, len(columns)), schema)
