"""Word-level substring dedup with prefix-partitioned suffix trees.

A window is `window` consecutive words of one document. A window is repeated if its words also start
in a document with a smaller id; every word that a repeated window covers is removed.

Suffix trees of the whole corpus do not fit anywhere, so suffixes are split into groups by
variable-length prefixes. `heavy_prefixes` counts prefixes over all documents: a prefix that more than
its share of all suffixes has is extended by a word, again and again, until it is light. Of the
prefixes that begin inside a window and end in it, the one with the smallest hash is the window's
anchor; equal windows have equal anchors, so they meet in the same group, and neighbouring windows
mostly share one. A group holds, per anchor, the words around it. Its task builds the tree of the
suffixes that begin at the anchors top-down, level by level, and drops leaves (nodes with one suffix)
as they appear. The words before the anchor are the left extension: an internal node at depth
`window - o` whose suffixes agree on `o` words to the left holds a repeated window.

A run of windows that occurs several times in one block is sent once, for its smallest document; the
other copies are removed in the block itself. A passage that a third of all documents share thus
reaches its group once per block. Words are compared by 64-bit hashes of their bytes.

Nulls and ties: a null text has no words. A null id counts as larger than all others. Rows with
the same id are no repeats of each other. Documents shorter than a window are kept whole. Empty tables
give empty results; columns other than the two named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm import blocks as B

WINDOW = 13
#: Groups per shuffle partition, at least; and as many that a group has this much of the text on average.
GROUPS = 4
GROUP_BYTES = 8 << 20
STEP = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


def deeper(path: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a path extended by one word."""
    return B.mix(path * STEP + word)


class Words:
    """The words of some texts: bounds in `data`, document number and hash."""

    def __init__(self, texts: list[bytes]):
        self.data, self.at = B.concat(texts)
        self.start, self.end = B.word_bounds(self.data)
        self.first = np.searchsorted(self.start, self.at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = B.span_hashes(self.data, self.start, self.end)


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    return ordered[np.minimum(at, len(ordered) - 1)] == values


def prefix_paths(words: Words, window: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word, hash and length of the shortest light prefix that begins there (`window` at most)."""
    path = B.mix(words.hash.copy())
    length = np.ones(len(path), np.int64)
    live = np.flatnonzero(is_in(path, heavy))
    for depth in range(1, window):
        length[live[live + depth >= len(path)]] = window + 1
        live = live[live + depth < len(path)]
        path[live] = deeper(path[live], words.hash[live + depth])
        length[live] += 1
        live = live[is_in(path[live], heavy)]
    return path, length


def _count_prefixes(window: int, share: float):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, _ in B.text_chunks(batches):
            words = Words(texts)
            least = max(2, int(share * len(words.hash) / 2))
            path, live = B.mix(words.hash.copy()), np.arange(len(words.hash))
            found, sizes = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for depth in range(1, window):
                values, inverse, n = np.unique(path, return_inverse=True, return_counts=True)
                many = n >= least
                found.append(values[many])
                sizes.append(n[many])
                keep = many[inverse] & (live + depth < len(words.hash))
                live = live[keep]
                if not len(live):
                    break
                path = deeper(path[keep], words.hash[live + depth])
            found.append(np.zeros(1, U))
            sizes.append(np.array([len(words.hash)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(sizes))],
                names=["prefix", "n"],
            )

    return count


def heavy_prefixes(docs: DataFrame, id_col: str, text_col: str, window: int, share: float) -> np.ndarray:
    """Hashes of the prefixes that start more than `share` of all suffixes, in order.

    A chunk reports the prefixes with at least half that share of its own words, so what is summed and
    what reaches the driver are both bounded by `window / share` values whatever the input's size.
    """
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    counted = rows.mapInArrow(_count_prefixes(window, share), "prefix long, n long")
    total = counted.groupBy("prefix").agg(F.sum("n").alias("n"))
    kept = total.orderBy(F.desc("n")).limit(int(2 * window / share) + 1).collect()
    everything = next((r.n for r in kept if r.prefix == 0), 0)
    return np.sort(np.array([r.prefix for r in kept if r.prefix and r.n > share * everything], np.int64).view(U))


class Runs:
    """Runs of neighbouring windows with one anchor, in document order."""

    def __init__(self, words: Words, window: int, heavy: np.ndarray):
        n = len(words.hash) - window + 1
        none = np.zeros(0, np.int64)
        self.first, self.count, self.left, self.size, self.group = none, none, none, none, none.view(U)
        if n <= 0:
            return
        path, length = prefix_paths(words, window, heavy)
        rank = B.mix(path ^ U(0x5851F42D4C957F2D)) | U(1)
        best, off = np.full(n, ~U(0), U), np.zeros(n, np.int8)
        for j in range(window):
            value = rank[j : j + n]
            better = (value < best) & (length[j : j + n] + j <= window)
            best[better] = value[better]
            off[better] = j
        valid = words.doc[:n] == words.doc[window - 1 :]
        anchor = np.arange(n) + off
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
        first = np.flatnonzero(new & valid)
        last = np.ones(n, bool)
        last[:-1] = new[1:]
        last[:-1] |= ~valid[1:]
        self.first = first
        self.count = np.flatnonzero(last & valid) - first + 1
        self.left = anchor[first] - first
        self.group = path[anchor[first]]
        self.size = window + self.count - 1


def run_values(words: Words, runs: Runs) -> np.ndarray:
    """One 64-bit value per run for its words, anchor place and length."""
    size = runs.size
    value = B.mix((runs.left * 64 + runs.count).astype(U))
    for j in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > j)
        value[live] = deeper(value[live], words.hash[runs.first[live] + j])
    return value


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each size, end to end."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(starts - before, sizes)


class Plan:
    """What a block sends to the groups: the first of equal runs; copies of it point there."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], window: int, heavy: np.ndarray, groups: int):
        self.words = Words(texts)
        self.runs = Runs(self.words, window, heavy)
        _, self.head, self.same = np.unique(
            run_values(self.words, self.runs), return_index=True, return_inverse=True
        )
        bucket = (B.mix(self.runs.group[self.head] ^ STEP) % U(groups)).astype(np.int64)
        order = np.lexsort((self.head, bucket))
        self.sent = self.head[order]
        self.bucket = bucket[order]
        self.run_id = ids[self.words.doc[self.runs.first]] if len(self.runs.first) else np.zeros(0, np.int64)

    def payloads(self) -> Iterator[tuple[int, bytes]]:
        words, runs = self.words, self.runs
        cut = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for i, j in zip(cut, np.append(cut[1:], len(self.sent))):
            sent = self.sent[i:j]
            size = runs.size[sent]
            at = words.start[runs.first[sent]]
            stop = words.end[runs.first[sent] + size - 1] + 1
            text = words.data[ragged(at, stop - at)].tobytes()
            ids = np.diff(self.run_id[sent], prepend=0)
            yield int(self.bucket[i]), B.pack(
                (runs.left[sent].astype(np.uint8), runs.count[sent].astype(np.uint8), ids, text)
            )


def _send(window: int, heavy: np.ndarray, groups: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                sent = list(Plan(*B.unpack(data.as_py()), window, heavy, groups).payloads())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([g for g, _ in sent], pa.int32()),
                        pa.array([block] * len(sent), pa.int64()),
                        pa.array([p for _, p in sent], pa.binary()),
                    ],
                    names=["group", "block", "data"],
                )

    return send


class Tree:
    """Top-down suffix tree over the anchors of one group, truncated at `window` words."""

    def __init__(self, payloads: list[bytes], window: int):
        parts = [B.unpack(p) for p in payloads]
        self.window = window
        self.sizes = [len(p[0]) for p in parts]
        self.left = np.concatenate([p[0] for p in parts]).astype(np.int64)
        self.count = np.concatenate([p[1] for p in parts]).astype(np.int64)
        self.ids = np.concatenate([np.cumsum(p[2]) for p in parts])
        data, _ = B.concat([p[3] for p in parts])
        self.word = B.span_hashes(data, *B.word_bounds(data))
        size = window + self.count - 1
        self.anchor = np.cumsum(size) - size + self.left
        self.right = size - self.left

    def left_paths(self) -> list[np.ndarray]:
        path = np.full(len(self.left), STEP, U)
        paths = [path]
        for o in range(1, self.window):
            path = path.copy()
            live = np.flatnonzero(self.left >= o)
            path[live] = deeper(path[live], self.word[self.anchor[live] - o])
            paths.append(path)
        return paths

    def repeats(self) -> np.ndarray:
        """Per anchor a bit for each of its windows: it also starts in a smaller document."""
        hit = np.zeros(len(self.left), np.uint64)
        left = self.left_paths()
        live = np.arange(len(self.left))
        path = np.full(len(live), STEP, U)
        for depth in range(1, self.window + 1):
            inside = self.right[live] >= depth
            live, path = live[inside], path[inside]
            path = deeper(path, self.word[self.anchor[live] + depth - 1])
            _, node, leaves = np.unique(path, return_inverse=True, return_counts=True)
            internal = leaves[node] > 1
            live, path = live[internal], path[internal]
            o = self.window - depth
            place = self.left[live] - o
            full = (place >= 0) & (place < self.count[live])
            rows = live[full]
            if len(rows):
                key = deeper(path[full], left[o][rows])
                order = np.lexsort((self.ids[rows], key))
                new = np.ones(len(order), bool)
                new[1:] = key[order][1:] != key[order][:-1]
                smallest = self.ids[rows][order][np.flatnonzero(new)][np.cumsum(new) - 1]
                again = rows[order][self.ids[rows][order] > smallest]
                hit[again] |= U(1) << (self.left[again] - o).astype(U)
        return hit


def _grow(window: int):
    def grow(table: pa.Table) -> pa.Table:
        payloads, names = table.column("data").to_pylist(), table.column("block").to_pylist()
        tree = Tree(payloads, window)
        hit = tree.repeats().astype(np.uint16)
        some = list(zip(names, np.split(hit, np.cumsum(tree.sizes)[:-1])))
        some = [(b, h) for b, h in some if h.any()]
        return pa.table(
            {
                "block": pa.array([b for b, _ in some], pa.int64()),
                "group": pa.array([table.column("group")[0].as_py()] * len(some), pa.int32()),
                "hits": pa.array([B.pack(h) for _, h in some], pa.binary()),
            }
        )

    return grow


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie in any [start, end)."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _remove(window: int, heavy: np.ndarray, groups: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, replies in zip(batch.column(0), batch.column(1).to_pylist()):
                ids, texts = B.unpack(data.as_py())
                plan = Plan(ids, texts, window, heavy, groups)
                words, runs = plan.words, plan.runs
                mask = np.zeros(len(runs.first), np.uint64)
                for r in replies or []:
                    mask[plan.sent[plan.bucket == r["group"]]] = B.unpack(r["hits"])
                if len(mask):
                    head = plan.head[plan.same]
                    mask = np.where(
                        plan.run_id > plan.run_id[head], (U(1) << runs.count.astype(U)) - U(1), mask[head]
                    )
                starts = [np.zeros(0, np.int64)]
                for t in range(window):
                    starts.append(runs.first[(mask >> U(t)) & U(1) > 0] + t)
                starts = np.concatenate(starts)
                gone = covered(len(words.hash), starts, starts + window)
                yield kept_rows(ids, words, gone)

    return remove


def kept_rows(ids: np.ndarray, words: Words, gone: np.ndarray) -> pa.RecordBatch:
    kept = ~gone
    edge = np.zeros(len(words.data) + 1, np.int8)
    edge[words.start[kept]] += 1
    edge[words.end[kept] + 1] -= 1
    keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
    data = words.data.copy()
    data[words.end] = 32
    out = data[keep].tobytes()
    at = np.concatenate(([0], np.cumsum(keep)))[words.at]
    n = np.diff(words.first)
    before = np.concatenate(([0], np.cumsum(gone)))
    removed = before[words.first[1:]] - before[words.first[:-1]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, mask=ids == B.NO_ID),
            pa.array(n.astype(np.int64)),
            pa.array(removed.astype(np.int64)),
            pa.array([out[i : max(i, j - 1)].decode() for i, j in zip(at[:-1], at[1:])], pa.string()),
        ],
        names=["doc_id", "n_words", "n_removed", "kept_text"],
    )


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    block_bytes: int = B.BLOCK_BYTES, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): every document without its repeated windows.

    `kept_text` joins the kept words by one blank. `window` is at most 16 words. `block_bytes`
    bounds what one task holds of the text; raise it with the executors' memory on a large input, as
    every block sends one value to each group. `group_bytes` bounds what a group holds: groups, and the
    partitions that hold `GROUPS` of them each, become more with the text.
    """
    spark = docs.sparkSession
    if not 2 <= window <= 16:
        raise ValueError("window must be 2 to 16 words")
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    groups = max(GROUPS * B.partitions(spark), -(-int(size) // group_bytes))
    heavy = heavy_prefixes(docs, id_col, text_col, window, 1 / (4 * groups))
    table = B.write_blocks(docs, id_col, text_col, block_bytes)
    sent = table.select("block", "data").mapInArrow(
        _send(window, heavy, groups), "group int, block long, data binary"
    )
    dealt = sent.repartition(-(-groups // GROUPS), "group")
    hits = dealt.groupBy("group").applyInArrow(_grow(window), "block long, group int, hits binary")
    replies = hits.groupBy("block").agg(F.collect_list(F.struct("group", "hits")).alias("replies"))
    return (
        table.select("block", "data")
        .join(replies.hint("merge"), "block", "left")
        .select("data", "replies")
        .mapInArrow(
            _remove(window, heavy, groups),
            "doc_id long, n_words long, n_removed long, kept_text string",
        )
    )
