"""Scalers, fitted in distributed passes and applied as column arithmetic."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.operators.partial_sums import matrix

QUARTILES = (0.25, 0.5, 0.75)
#: A sketch's ranks are off by one part in so many at most.
SKETCH = 10_000
#: Steps in which a bracket is narrowed, and the values it may hold when they are counted.
GRID = 64
BRACKET_VALUES = 1_000
#: Shares of the values to each side of a quartile that its bracket takes in.
MARGINS = (2.0 / SKETCH, 20.0 / SKETCH, 200.0 / SKETCH)


@dataclass(frozen=True)
class Scaling:
    """`(x - center) / scale` per column; a scale of 0 was replaced by 1 in fitting."""

    cols: tuple[str, ...]
    centers: tuple[float, ...]
    scales: tuple[float, ...]

    def expressions(self) -> dict[str, Column]:
        triples = zip(self.cols, self.centers, self.scales)
        return {c: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in triples}

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.expressions())


class StandardScale:
    """Mean and population standard deviation. A constant column is only centred."""

    @staticmethod
    def fit(df: DataFrame, cols: Iterable[str]) -> Scaling:
        cols = list(cols)
        vector = VectorAssembler(inputCols=cols, outputCol="_v").transform(df)
        moments = Summarizer.metrics("count", "mean", "variance").summary(F.col("_v"))
        row = vector.agg(moments.alias("m")).first()["m"]
        shrink = (row["count"] - 1) / row["count"] if row["count"] else 0.0
        deviations = [(max(v, 0.0) * shrink) ** 0.5 for v in row["variance"]]
        means = [float(m) for m in row["mean"]]
        scales = tuple(s if s > 1e-12 * max(1.0, abs(m)) else 1.0 for s, m in zip(deviations, means))
        return Scaling(tuple(cols), tuple(means), tuple(float(s) for s in scales))


class RobustScale:
    """Median and interquartile range, quartiles interpolated linearly between order statistics."""

    @staticmethod
    def fit(
        df: DataFrame, cols: Iterable[str], exact: bool = True, values: Column | None = None
    ) -> Scaling:
        """`values`, if given, is an array of the columns' values, in their order."""
        cols = list(cols)
        if values is None:
            values = F.array(*[F.col(c).cast("double") for c in cols])
        quartiles = exact_quartiles if exact else approximate_quartiles
        found = quartiles(df, values, len(cols))
        low, middle, high = zip(*[found.get(i, [0.0] * 3) for i in range(len(cols))])
        spread = [h - l for l, h in zip(low, high)]
        return Scaling(tuple(cols), tuple(middle), tuple(s if s else 1.0 for s in spread))


def _numbers(values: Column, i: int) -> Column:
    """A column's value; null for what is no number."""
    v = F.get(values, i)
    return F.when(~F.isnan(v), v)


def approximate_quartiles(df: DataFrame, values: Column, n: int) -> dict[int, list[float]]:
    """From a sketch of fixed size per column."""
    cuts = F.array(*[F.lit(p) for p in QUARTILES])
    row = df.select(values.alias("v")).agg(
        *[F.percentile_approx(_numbers(F.col("v"), i), cuts, SKETCH * 10).alias(f"q{i}") for i in range(n)]
    ).first()
    return {i: list(row[i]) for i in range(n) if row[i] is not None}


@dataclass
class _Bracket:
    """Two values between which the order statistics `rank` (from 0) and `rank + step` of a column lie."""

    column: int
    quartile: int
    rank: int
    share: float
    low: float
    high: float
    inside: float

    @property
    def step(self) -> int:
        return 1 if self.share else 0


def exact_quartiles(df: DataFrame, values: Column, n: int, most: int = BRACKET_VALUES) -> dict[int, list[float]]:
    """Quartiles interpolated between order statistics, of the `n` columns whose values are an array; nulls and
    NaN do not count.

    A sketch per column, whose ranks are known to one part in `SKETCH`, gives a bracket around each quartile. A second
    scan counts the values below the bracket and those in it, value by value, and the wanted ranks are read off. Where
    a bracket may hold more than `most` values it is narrowed first, each time to some 64ths of it, by another sketch.
    Nothing is sorted or written. The driver sees the sketches' answers and the counts inside brackets.
    """
    rows = df.select(values.alias("v"))
    brackets = _first_brackets(rows, n)
    while any(b.inside > most and b.low < b.high for b in brackets):
        _narrow(rows, [b for b in brackets if b.inside > most and b.low < b.high])
    found: dict[int, list[float]] = {}
    for b, (below, counts) in zip(brackets, _count(rows, brackets)):
        found.setdefault(b.column, [0.0] * len(QUARTILES))[b.quartile] = _interpolated(b, below, counts)
    return found


def _first_brackets(rows: DataFrame, n: int) -> list[_Bracket]:
    sides = [min(max(p + d, 0.0), 1.0) for m in MARGINS for p in QUARTILES for d in (-m, m)]
    cells = [_numbers(F.col("v"), i) for i in range(n)]
    cuts = F.array(*[F.lit(s) for s in sides])
    row = rows.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(cells)],
        *[F.percentile_approx(c, cuts, SKETCH).alias(f"q{i}") for i, c in enumerate(cells)],
    ).first()
    out = []
    for i in range(n):
        # The narrowest margin that is two places wide at least; few values are bracketed whole.
        fit = [j for j, m in enumerate(MARGINS) if m * row[i] >= 2]
        for k, p in enumerate(QUARTILES if row[i] else ()):
            place = p * (row[i] - 1)
            low, high, inside = float("-inf"), float("inf"), float(row[i])
            if fit:
                low, high = row[n + i][2 * (len(QUARTILES) * fit[0] + k) :][:2]
                inside = 3 * MARGINS[fit[0]] * row[i]
            out.append(_Bracket(i, k, int(place), place - int(place), low, high, inside))
    return out


def _narrow(rows: DataFrame, brackets: list[_Bracket]) -> None:
    grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    aggregates = []
    for b in brackets:
        v = _numbers(F.col("v"), b.column)
        aggregates += [
            F.count_if(v < b.low), F.count_if((v >= b.low) & (v <= b.high)),
            F.percentile_approx(F.when((v >= b.low) & (v <= b.high), v), grid, SKETCH),
        ]
    row = rows.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggregates)]).first()
    for k, b in enumerate(brackets):
        below, inside, points = row[3 * k : 3 * k + 3]
        # One more grid step to each side than the ranks need: far more than the sketch can be off.
        first = max(int((b.rank - below) / inside * GRID) - 1, 0)
        last = min(int((b.rank + b.step - below + 1) / inside * GRID) + 2, GRID)
        low, high = points[first] if first else b.low, points[last] if last < GRID else b.high
        if (low, high) == (b.low, b.high):
            b.inside = 0.0  # one value from here to there, or too few to narrow
        else:
            b.low, b.high, b.inside = low, high, inside * (last - first + 1) / GRID


def _count(rows: DataFrame, brackets: list[_Bracket]) -> list[tuple[int, list[tuple[float, int]]]]:
    """Per bracket the number of values below it, and each value in it with how often it occurs, ascending."""
    limits = [(b.column, b.low, b.high) for b in brackets]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros(len(limits), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0))
            which, value, times = [], [], []
            for k, (c, low, high) in enumerate(limits):
                own = x[:, c]
                below[k] += int((own < low).sum())
                v, n = np.unique(own[(own >= low) & (own <= high)], return_counts=True)
                which.append(np.full(len(v), k))
                value.append(v)
                times.append(n)
            yield _counted(*(np.concatenate(a) for a in (which, value, times)))
        yield _counted(np.arange(len(limits)), np.full(len(limits), np.nan), below)

    parts = rows.mapInArrow(partial, "bracket int, value double, n long")
    out: list[tuple[int, list]] = [(0, []) for _ in brackets]
    for r in parts.groupBy("bracket", "value").agg(F.sum("n").alias("n")).collect():
        if math.isnan(r.value):
            out[r.bracket] = (r.n, out[r.bracket][1])
        else:
            out[r.bracket][1].append((r.value, r.n))
    return [(n, sorted(own)) for n, own in out]


def _counted(which: np.ndarray, value: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(which, pa.int32()), pa.array(value, pa.float64()), pa.array(times, pa.int64())],
        names=["bracket", "value", "n"],
    )


def _interpolated(b: _Bracket, below: int, counts: list[tuple[float, int]]) -> float:
    wanted, upto = [b.rank, b.rank + b.step], below
    at = []
    for value, n in counts:
        at += [value] * sum(upto <= r < upto + n for r in wanted)
        upto += n
    if below > b.rank or len(at) != 2:
        raise RuntimeError("a bracket does not hold its quartile")
    return at[0] * (1.0 - b.share) + at[1] * b.share if b.step else at[0]


def minmax_score(df: DataFrame, col: str, name: str = "score") -> DataFrame:
    """A decision value mapped to 0..1 by its smallest and largest; 0.5 if all are equal."""
    low, high = df.agg(F.min(col), F.max(col)).first()
    if low is None or low == high:
        return df.withColumn(name, F.lit(0.5))
    return df.withColumn(name, (F.col(col) - F.lit(low)) / F.lit(high - low))
