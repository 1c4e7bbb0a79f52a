"""Line dedup by content-defined chunks of lines.

A document's lines are cut into chunks where a rolling hash over the hashes of the last `WINDOW` lines
hits a fixed pattern, on average every `MEAN_LINES` lines. Of pattern hits on consecutive lines only the first
cuts, and none cuts off a document's last line, so every chunk has two lines or more, unless the document has
one. Boundaries depend on the lines around them alone, so the same passage is cut in the same way wherever
it stands, whatever was inserted before it. On the finest level every line is a boundary: any two successive lines with
text (and blank ones between them) are a chunk, and so is a single line of `LONG_WORDS` words or more. A chunk
that occurs more than once in all documents stays only where it occurs first (by document id, then by place).

The coarse level carries whole passages at one comparison each; the finest level extends them, line by line, to the
edges that chunk boundaries cut off, and finds what is too short to hold a chunk. In the end exactly those lines
go that stand in a run of two or more lines with text of which every two neighbours stood together earlier, and
repeated lines of `LONG_WORDS` words. The first occurrence of every line stays.

Blocks of documents are written once, with the hashes of their chunks. First only hashes move: each block sends each of
its distinct ones once to the hash's group, which answers where a hash is held by several blocks. Only such
chunks are then sent whole, once per block, and settled byte by byte in the group; pairs of lines inside a larger
chunk that the block holds as a repetition stay behind. Copies inside a block are settled there. A chunk that a third
of all documents share thus reaches its group once per block. The number of groups follows the number of chunks.

Defined cases: a null text stays null and has no lines; an empty text is one empty line. Blank lines at the edge of a
chunk do not belong to it, so chunks of blank lines alone are kept. A document that loses all its lines stays, with an
empty text. Null ids come after all others; rows with the same id are ordered by their place in the scan, so of
repeated rows one keeps its chunks. Very long texts are cut like others. An empty table gives no rows. All columns are
kept; `n_lines` and `n_removed` are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm import blocks as B
from sessionloom.session import scratch_path

WINDOW = 2
MEAN_LINES = 3
LONG_WORDS = 50
#: Distinct chunks of all blocks that one group settles, about.
GROUP_CHUNKS = 1 << 17
COUNTS = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
#: An odd factor, and what undoes it, modulo 2 ** 64.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


class Chunks:
    """Lines of some texts in order, and the chunks of both levels as (first line, last line)."""

    def __init__(self, texts: list[bytes], window: int = WINDOW, mean_lines: int = MEAN_LINES):
        self.lines = Lines(texts)
        s = self.lines
        n, doc = len(s.start), s.doc
        line = B.span_hashes(s.data, s.start, s.end)
        rolling = np.zeros(n, np.uint64)
        for k in range(window):
            rolling[k:] += line[: n - k] * np.uint64(pow(FACTOR, k + 1, 1 << 64))
        place = np.arange(n) - s.line_at[doc] if n else np.zeros(0, np.int64)
        cut = (B.mix(rolling) % np.uint64(mean_lines) == 0) & (place >= window - 1)
        again = np.zeros(n, bool)
        again[1:] = cut[:-1] & (place[1:] > 0)
        cut &= ~again & (place + 2 != np.diff(s.line_at)[doc])
        new = np.ones(n, bool)
        new[1:] = cut[:-1] | (doc[1:] != doc[:-1])
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], n) - 1 if n else self.first
        starts, _ = B.word_bounds(s.data)
        words = np.diff(np.searchsorted(starts, np.append(s.start, len(s.data))))
        dark = np.flatnonzero(words)
        pair = np.flatnonzero(doc[dark[1:]] == doc[dark[:-1]])
        long = np.flatnonzero(words >= LONG_WORDS)
        # Coarse chunks without the blank lines at their edges, of two lines with text at least.
        begin, stop = np.searchsorted(dark, self.first), np.searchsorted(dark, self.last, side="right") - 1
        coarse = stop > begin
        first = np.concatenate((dark[begin[coarse]], dark[pair], long))
        last = np.concatenate((dark[stop[coarse]], dark[pair + 1], long))
        order = np.lexsort((last, first))
        first, last = first[order], last[order]
        distinct = np.ones(len(first), bool)
        distinct[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
        self.begin, self.stop = first[distinct], last[distinct]
        # Hashes of stretches of lines from running sums: no byte is hashed twice.
        power = np.cumprod(np.full(n + 1, FACTOR, np.uint64))
        undo = np.cumprod(np.full(n + 1, INVERSE, np.uint64))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(line * power[:-1], dtype=np.uint64)))
        spread = (total[self.stop + 1] - total[self.begin]) * undo[self.begin]
        self.hash = B.mix(spread + (self.stop - self.begin + 1).astype(np.uint64))


class Lines:
    """The bytes of some texts, where their lines begin and end, and whose they are."""

    def __init__(self, texts: list[bytes]):
        self.data, self.at = B.concat(texts)
        self.end = np.flatnonzero(self.data == 10)
        self.start = np.concatenate(([0], self.end[:-1] + 1)) if len(self.end) else self.end
        self.line_at = np.searchsorted(self.start, self.at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.line_at))

    def bytes(self, first: int, last: int) -> bytes:
        return self.data[self.start[first] : self.end[last]].tobytes()

    def covered(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Which lines lie in one of the stretches."""
        cover = np.zeros(len(self.start) + 1, np.int64)
        np.add.at(cover, first, 1)
        np.add.at(cover, last + 1, -1)
        return np.cumsum(cover[:-1]) > 0


def block_plan(ids: np.ndarray, texts: list[bytes]) -> dict[str, np.ndarray]:
    """A block's chunks: first and last line, hash, the owner's id, and the first equal one in the block (itself, too)."""
    c = Chunks(texts)
    heads: dict[tuple[int, bytes], int] = {}
    head = np.arange(len(c.begin))
    _, inverse, n = np.unique(c.hash, return_inverse=True, return_counts=True)
    for k in np.flatnonzero(n[inverse] > 1).tolist():
        head[k] = heads.setdefault((inverse[k], c.lines.bytes(c.begin[k], c.stop[k])), k)
    return {
        "first": c.begin.astype(np.int32), "last": c.stop.astype(np.int32), "hash": c.hash,
        "id": ids[c.lines.doc[c.begin]], "head": head.astype(np.int32),
    }


def _dealt(plan: dict[str, np.ndarray], groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """The block's distinct chunks by group, each group's in order."""
    heads = np.flatnonzero(plan["head"] == np.arange(len(plan["head"])))
    group = (B.mix(plan["hash"][heads] ^ np.uint64(7)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    heads, group = heads[order], group[order]
    cut = np.flatnonzero(np.diff(group, prepend=-1))
    for i, j in zip(cut, np.append(cut[1:], len(heads))):
        yield int(group[i]), heads[i:j]


def _messages(block: int, sent: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([g for g, _ in sent], pa.int32()), pa.array([block] * len(sent), pa.int64()),
            pa.array([p for _, p in sent], pa.binary()),
        ],
        names=["group", "block", "data"],
    )


def _send_hashes(groups: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                plan = B.unpack(data.as_py())
                yield _messages(block, [
                    (g, B.pack((plan["hash"][own], plan["id"][own], own), level=1)) for g, own in _dealt(plan, groups)
                ])

    return send


def _received(table: pa.Table):
    """The blocks, and what they sent: hash, id and place of each chunk with the number of its block."""
    blocks = np.array(table.column("block").to_pylist(), np.int64)
    parts = [B.unpack(p) for p in table.column("data").to_pylist()]
    size = [len(p[0]) for p in parts]
    columns = [np.concatenate([p[k] for p in parts]) for k in range(3)]
    return blocks, parts, np.repeat(np.arange(len(blocks)), size), columns


def _replies(blocks: np.ndarray, owner: np.ndarray, flags: list[np.ndarray], places: np.ndarray) -> pa.Table:
    """Per block the places that have the first flag, with what other flags say of them."""
    hit = np.flatnonzero(flags[0])
    hit = hit[np.argsort(owner[hit], kind="stable")]
    cut = np.flatnonzero(np.diff(owner[hit], prepend=-1))
    out = [
        (blocks[owner[hit[i]]], B.pack((places[hit[i:j]], *[f[hit[i:j]] for f in flags[1:]]), level=1))
        for i, j in zip(cut, np.append(cut[1:], len(hit)))
    ]
    return pa.table({
        "block": pa.array([b for b, _ in out], pa.int64()), "hits": pa.array([h for _, h in out], pa.binary()),
    })


def _find_shared(table: pa.Table) -> pa.Table:
    """Of each block's chunks in this group, which other blocks hold by their hash, and which of these come first."""
    blocks, _, owner, (value, ids, places) = _received(table)
    order = np.lexsort((places, blocks[owner], ids, value))
    same = value[order[1:]] == value[order[:-1]]
    shared, first = np.zeros(len(order), bool), np.zeros(len(order), bool)
    shared[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    first[order] = np.concatenate(([True], ~same))
    return _replies(blocks, owner, [shared, first], places)


def _hits(replies: list | None) -> list[np.ndarray]:
    parts = [B.unpack(r) for r in replies or []]
    return [np.concatenate(c) for c in zip(*parts)] if parts else []


def _send_shared(groups: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, planned, replies in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3).to_pylist()):
                hits = _hits(replies)
                if not hits:
                    continue
                plan = B.unpack(planned.as_py())
                shared, first = np.zeros(len(plan["head"]), bool), np.zeros(len(plan["head"]), bool)
                shared[hits[0]], first[hits[0]] = True, hits[1]
                lines = Lines(B.unpack(data.as_py())[1])
                shared &= ~_inside_repeats(plan, shared, first)
                yield _messages(block, [
                    (g, B.pack((plan["hash"][k], plan["id"][k], k, [lines.bytes(plan["first"][i], plan["last"][i]) for i in k])))
                    for g, own in _dealt(plan, groups) for k in [own[shared[own]]] if len(k)
                ])

    return send


def _inside_repeats(plan: dict[str, np.ndarray], shared: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Chunks all of whose occurrences in the block lie inside larger ones that repeat another block's earlier one.

    Where they occur first is in some earlier document, which sends them, and here they go with the larger ones.
    """
    head = plan["head"]
    goes = shared & ~first
    large = goes[head] & (plan["last"] - plan["first"] > 1)
    # Chunks of more than two lines do not overlap, so the last that began before says how far it reaches.
    begin, stop = plan["first"][large], plan["last"][large]
    inside = np.zeros(len(head), bool)
    if len(begin):
        stop = np.maximum.accumulate(stop)
        at = np.searchsorted(begin, plan["first"], side="right") - 1
        inside = (at >= 0) & (plan["last"] <= stop[np.maximum(at, 0)]) & ~large
    everywhere = np.ones(len(head), bool)
    np.logical_and.at(everywhere, head, inside)
    return everywhere & goes


def _settle(table: pa.Table) -> pa.Table:
    """Of each block's chunks in this group, which also occur earlier in another block, byte for byte."""
    blocks, parts, owner, (value, ids, places) = _received(table)
    texts = [t for p in parts for t in p[3]]
    again = np.zeros(len(value), bool)
    order = np.lexsort((places, blocks[owner], ids, value))
    begins = np.concatenate(([True], value[order[1:]] != value[order[:-1]]))
    seen: dict[bytes, int] = {}
    for row, new in zip(order.tolist(), begins.tolist()):
        if new:
            seen = {}
        again[row] = seen.setdefault(texts[row], row) != row
    return _replies(blocks, owner, [again], places)


def _remove(text_col: str, columns: list[str]):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, planned, replies in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                _, texts, rows = B.unpack(data.as_py())
                rows = pa.ipc.open_stream(rows).read_all()
                plan, s = B.unpack(planned.as_py()), Lines(texts)
                gone = plan["head"] != np.arange(len(plan["head"]))
                for places in _hits(replies):
                    gone[places] = True
                lines = s.covered(plan["first"][gone], plan["last"][gone])
                keep = np.repeat(~lines, s.end - s.start + 1)
                out = s.data[keep].tobytes()
                at = np.concatenate(([0], np.cumsum(keep)))[s.at]
                removed = np.concatenate(([0], np.cumsum(lines)))[s.line_at]
                null = rows.column(text_col).is_null().to_numpy()
                n_lines = np.where(null, 0, np.diff(s.line_at))
                text = [None if x else out[i : max(i, j - 1)].decode() for i, j, x in zip(at[:-1], at[1:], null)]
                new = {
                    text_col: pa.array(text, pa.string()), "n_lines": pa.array(n_lines),
                    "n_removed": pa.array(np.diff(removed).astype(np.int64)),
                }
                whole = pa.table({k: new[k] if k in new else rows.column(k) for k in columns})
                yield from whole.combine_chunks().to_batches()

    return remove


def _block_writer(id_col: str, text_col: str, block_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 24
        for n, (ids, texts, rows) in enumerate(B.row_blocks(batches, id_col, text_col, block_bytes)):
            rest = pa.BufferOutputStream()
            keep = rows.set_column(
                rows.schema.get_field_index(text_col), text_col,
                pa.array([None if x else "" for x in rows.column(text_col).is_null().to_pylist()], pa.string()),
            )
            with pa.ipc.new_stream(rest, keep.schema) as sink:
                sink.write_table(keep)
            plan = block_plan(ids, texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([base + n], pa.int64()),
                    pa.array([B.pack((ids, texts, rest.getvalue().to_pybytes()))], pa.binary()),
                    pa.array([B.pack(plan)], pa.binary()), pa.array([len(plan["head"])], pa.int64()),
                ],
                names=["block", "data", "plan", "n_chunks"],
            )

    return write


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES
) -> DataFrame:
    """All rows and columns, texts without repeated chunks, plus n_lines and n_removed."""
    spark = docs.sparkSession
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in COUNTS.names])
    name = f"line_blocks_{uuid.uuid4().hex}"
    made = rows.mapInArrow(
        _block_writer(id_col, text_col, block_bytes), "block long, data binary, plan binary, n_chunks long"
    )
    (
        made.write.format("parquet").option("path", scratch_path(spark, name)).option("compression", "none")
        .bucketBy(B.partitions(spark), "block").saveAsTable(name)
    )
    table = spark.table(name)
    n_chunks = table.agg(F.sum("n_chunks")).first()[0] or 0
    groups = max(B.partitions(spark), -(-n_chunks // GROUP_CHUNKS))
    message, reply = "group int, block long, data binary", "block long, hits binary"

    def by_block(replies: DataFrame) -> DataFrame:
        return replies.groupBy("block").agg(F.collect_list("hits").alias("replies")).hint("merge")

    hashes = table.select("block", "plan").mapInArrow(_send_hashes(groups), message)
    shared = by_block(hashes.groupBy("group").applyInArrow(_find_shared, reply))
    whole = table.join(shared, "block").select("block", "data", "plan", "replies").mapInArrow(_send_shared(groups), message)
    again = by_block(whole.groupBy("group").applyInArrow(_settle, reply))
    schema = T.StructType(list(rows.schema) + list(COUNTS))
    return (
        table.join(again, "block", "left").select("data", "plan", "replies")
        .mapInArrow(_remove(text_col, schema.names), schema)
    )
