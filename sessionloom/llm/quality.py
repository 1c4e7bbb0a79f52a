"""Quality selection by ordinal regression on graded ratings.

A rating is a grade from 0 to K - 1. The model has one weight per hashed text feature, shared by all
grades, and ordered thresholds: P(grade <= k) = sigmoid(threshold[k] - sum of weights). A document's
tail probabilities P(grade >= k) and its expected grade follow. Features are the distinct words of the
whole text, the first letters of longer words, runs of marks, and some coarse measures of its shape (share of
capitals, of marks, of repeated words, ...), each hashed to `BITS` bits.

The fit sees at most `max_fit_rows` rated documents, an equal share of each grade as far as there are
so many, chosen by the hash of their ids; this bound is the only one. It runs on the driver over the
features of those rows: proximal gradient steps on the likelihood, each grade weighing as
the root of all its rated rows, with an absolute penalty that leaves most weights at zero. Words that say nothing then add no
noise to long texts. The few weights left go to the tasks, and all documents are scored in
one pass without a shuffle.

Defined cases: a null or empty text has only its shape features. Ratings without a grade or without a
document are not used. Where ratings have fewer than two grades nothing is learnt and every document
is kept with null scores. Repeated rows and null ids are scored like others. An empty table gives no
rows. Columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm import blocks as B
from sessionloom.llm.decontaminate import MARKS, UPPER_TO_LOWER

BITS = 40
MAX_FIT_ROWS = 6_000
PREFIX = 5
#: A feature that fewer rated documents have is not given a weight.
LEAST_DOCUMENTS = 3
#: Over the root of the number of rated rows: what chance alone makes of a feature's share falls like it.
PENALTY = 0.1
STEPS = 300
#: All but ASCII marks.
NO_MARKS = ~MARKS | B.WHITE
NO_MARKS[range(65, 91)] = True
SCORES = T.StructType(
    [
        T.StructField("expected_grade", T.DoubleType()),
        T.StructField("tail", T.ArrayType(T.DoubleType())),
    ]
)


def _share(counts: np.ndarray, of: np.ndarray, steps: int) -> np.ndarray:
    return np.floor(steps * counts / np.maximum(of, 1)).astype(np.int64)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of all texts, text after text, and where each text's begin."""
    raw, at = B.concat(texts)
    lower = np.frombuffer(raw.tobytes().translate(UPPER_TO_LOWER), np.uint8)
    start, end = B.word_bounds(lower, MARKS)
    first = np.searchsorted(start, at)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), n_words)
    word = B.span_hashes(lower, start, end)
    long = end - start > PREFIX
    head = B.span_hashes(lower, start[long], start[long] + PREFIX) ^ np.uint64(0xA5A5A5A5A5A5A5A5)

    # Runs of marks count as words too.
    m_start, m_end = B.word_bounds(raw, NO_MARKS)
    m_doc = np.searchsorted(at, m_start, side="right") - 1
    mark_run = B.span_hashes(raw, m_start, np.minimum(m_end, m_start + 8)) ^ np.uint64(0x3C3C3C3C3C3C3C3C)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[at[1:]] - total[at[:-1]]

    size = np.diff(at) - 1
    letters = per_text(~MARKS[lower])
    marks = per_text(MARKS[raw] & ~B.WHITE[raw] & (raw == lower) | (raw == 0))
    capitals = per_text(raw != lower)
    lines = per_text(raw == 10)
    same = np.zeros(len(word), bool)
    if len(word):
        same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((word, doc))
    repeated = np.zeros(len(word), bool)
    repeated[order[1:]] = (word[order[1:]] == word[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    measures = [
        _share(np.bincount(doc[same], minlength=len(texts)), n_words, 20),
        _share(np.bincount(doc[repeated], minlength=len(texts)), n_words, 10),
        _share(capitals, letters, 10),
        _share(marks, size, 20),
        _share(letters, n_words, 1),
        np.log2(n_words + 1).astype(np.int64),
        _share(n_words, lines, 1) // 8,
    ]
    texts_no = np.arange(len(texts))
    shape = [B.mix(np.minimum(m, 40).astype(np.uint64) + np.uint64(1000 * (k + 1))) for k, m in enumerate(measures)]
    number = np.concatenate([word, head, mark_run, *shape]) >> np.uint64(64 - BITS)
    owner = np.concatenate([doc, doc[long], m_doc, *[texts_no] * len(shape)])
    order = np.lexsort((number, owner))
    number, owner = number[order], owner[order]
    new = np.ones(len(number), bool)
    new[1:] = (number[1:] != number[:-1]) | (owner[1:] != owner[:-1])
    number, owner = number[new], owner[new]
    return number.astype(np.int64), np.searchsorted(owner, np.arange(len(texts) + 1))


@dataclass
class OrdinalModel:
    """Ordered thresholds and the features with a weight, in order. No thresholds: nothing was learnt."""

    thresholds: np.ndarray
    numbers: np.ndarray
    weights: np.ndarray

    def tails(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K - 1, a row per text."""
        if len(self.numbers):
            place = np.minimum(np.searchsorted(self.numbers, number), len(self.numbers) - 1)
            value = np.where(self.numbers[place] == number, self.weights[place], 0.0)
        else:
            value = np.zeros(len(number))
        total = np.concatenate(([0.0], np.cumsum(value)))
        score = total[at[1:]] - total[at[:-1]]
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_ordinal(
    number: np.ndarray, at: np.ndarray, grade: np.ndarray, sizes: dict[int, int] | None = None,
    penalty: float = PENALTY,
) -> OrdinalModel:
    """Fit on texts' features (as `features` gives them) and their grades.

    `sizes` says how many rated documents of each grade there are, if the texts are a sample.
    """
    grades, y = np.unique(grade, return_inverse=True)
    if len(grades) < 2:
        return OrdinalModel(np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
    size = np.bincount(y)
    whole = size if sizes is None else np.array([sizes[int(g)] for g in grades])
    weight = (np.sqrt(whole) / size)[y]
    weight /= weight.sum()
    columns, code, n = np.unique(number, return_inverse=True, return_counts=True)
    kept = n >= LEAST_DOCUMENTS
    row = np.repeat(np.arange(len(y)), np.diff(at))[kept[code]]
    code = (np.cumsum(kept) - 1)[code[kept[code]]]
    columns = columns[kept]
    w, gw2 = np.zeros(len(columns)), np.full(len(columns), 1e-8)
    below = np.cumsum(np.bincount(y, weights=weight))[:-1]
    theta = np.log(below / (1 - below))
    gt2 = np.full(len(theta), 1e-8)
    high = np.append(np.arange(len(theta)), -1)[y]  # threshold above the grade
    low = y - 1  # threshold below it
    for _ in range(STEPS):
        score = np.bincount(row, weights=w[code], minlength=len(y))
        p = _sigmoid(theta[None, :] - score[:, None])
        up = np.where(high >= 0, p[np.arange(len(y)), high], 1.0)
        down = np.where(low >= 0, p[np.arange(len(y)), np.maximum(low, 0)], 0.0)
        inside = np.maximum(up - down, 1e-12)
        d_up, d_down = up * (1 - up) / inside * weight, down * (1 - down) / inside * weight
        g_score = d_up - d_down
        g = np.bincount(code, weights=g_score[row], minlength=len(columns))
        gt = np.bincount(np.maximum(low, 0), weights=np.where(low >= 0, d_down, 0), minlength=len(theta)) - np.bincount(
            np.maximum(high, 0), weights=np.where(high >= 0, d_up, 0), minlength=len(theta)
        )
        gw2 += g * g
        gt2 += gt * gt
        step = 0.2 / np.sqrt(gw2)
        w = w - step * g
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * penalty / np.sqrt(len(y)))
        theta = np.maximum.accumulate(theta - 0.2 / np.sqrt(gt2) * gt)
    on = w != 0
    return OrdinalModel(theta, columns[on], w[on])


def _features_of_rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
        for i in range(0, len(texts), 500):
            number, at = features(texts[i : i + 500])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).slice(i, 500),
                    pa.array([number[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
                ],
                names=["grade", "features"],
            )


def rated_features(
    docs: DataFrame, ratings: DataFrame, id_col: str, text_col: str, max_fit_rows: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, int]]:
    """Features and grades of the chosen rated documents, and all grades' sizes. `ratings`: (id, grade)."""
    rated = ratings.filter("id is not null and grade is not null").groupBy("id").agg(F.max("grade").alias("grade"))
    sizes = {r.grade: r.n for r in rated.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    each = max_fit_rows // max(1, len(sizes))
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, each / n)]) if sizes else F.lit(None)
    chosen = rated.filter(chance < F.get(F.array(F.element_at(share, F.col("grade"))), 0)) if sizes else rated
    # At most `max_fit_rows` short rows, so they may go to every task.
    few = F.broadcast(chosen.orderBy(F.xxhash64("id")).limit(max_fit_rows))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = (
        texts.join(few, "id").select("text", "grade").mapInArrow(_features_of_rated, "grade int, features binary").collect()
    )
    number = np.concatenate([np.frombuffer(r.features, np.int64) for r in found] or [np.zeros(0, np.int64)])
    at = np.cumsum([0, *(len(r.features) // 8 for r in found)])
    return number, at, np.array([r.grade for r in found], np.int64), sizes


def _score(model: OrdinalModel, text_at: int, kept: list[int]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
            tails = [np.zeros((0, len(model.thresholds)))]
            size = np.cumsum([len(t) for t in texts])
            cut = np.flatnonzero(np.diff(size // B.BLOCK_BYTES, prepend=-1)) if len(texts) else []
            for i, j in zip(cut, [*cut[1:], len(texts)]):
                tails.append(model.tails(*features(texts[i:j])))
            tail = np.concatenate(tails)
            learnt = len(model.thresholds) > 0
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in kept),
                    pa.array(tail.sum(1)) if learnt else pa.nulls(len(texts), pa.float64()),
                    pa.array(list(tail), pa.list_(pa.float64())) if learnt else pa.nulls(len(texts), pa.list_(pa.float64())),
                ],
                names=[*(batch.schema.names[k] for k in kept), *SCORES.names],
            )

    return score


def score_quality(
    docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    max_fit_rows: int = MAX_FIT_ROWS, fit_docs: DataFrame | None = None,
) -> DataFrame:
    """All rows of `docs` with expected_grade and tail[k - 1] = P(grade >= k).

    `ratings` has (id, grade), grades from 0 without a gap; their texts come from `fit_docs`, or `docs`.
    """
    model = fit_ordinal(*rated_features(docs if fit_docs is None else fit_docs, ratings, id_col, text_col, max_fit_rows))
    kept = [k for k, c in enumerate(docs.columns) if c not in SCORES.names]
    schema = T.StructType([docs.schema[k] for k in kept] + list(SCORES))
    return docs.mapInArrow(_score(model, docs.columns.index(text_col), kept), schema)


def selected(tail):
    """The best grade is at least as likely as all others together, or nothing was learnt."""
    return F.coalesce(F.element_at(tail, -1) >= 0.5, F.lit(True))


def graded(labels: DataFrame) -> DataFrame:
    """Grades of rated documents: 0 toxic, 1 of low quality, 2 good."""
    return labels.select(
        F.col("doc_id").cast("long").alias("id"),
        F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"),
    )
