"""Ranks and quantiles of long sliding windows at a cost that does not grow with the window.

A series is cut in pieces, each with the rows that its first windows reach back to. A piece's values are held as a wavelet matrix: one
row of counts for each binary digit of their ranks, by which the number of smaller values in any range of rows, or the range's k-th
smallest value, is found with one look-up a digit, for all rows of the piece at once.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.pieces import numbered, with_halo

SIZE = 4096


class WaveletMatrix:
    """Order statistics over any ranges [begin, end) of some numbers."""

    def __init__(self, values: np.ndarray):
        self.values, rank = np.unique(values, return_inverse=True)
        self.rank = rank
        self.digits = max(1, int(len(self.values)).bit_length())
        self.zeros = []
        for digit in reversed(range(self.digits)):
            one = (rank >> digit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            rank = np.concatenate([rank[~one], rank[one]])

    def below(self, begin: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many numbers of each range have a smaller rank."""
        count = np.zeros(len(rank), np.int64)
        for digit, zeros in zip(reversed(range(self.digits)), self.zeros, strict=True):
            a, b, one = zeros[begin], zeros[end], (rank >> digit & 1).astype(bool)
            count += np.where(one, b - a, 0)
            begin, end = np.where(one, zeros[-1] + begin - a, a), np.where(one, zeros[-1] + end - b, b)
        return count

    def kth(self, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest number (from 0) of each range, which has more than k."""
        rank = np.zeros(len(k), np.int64)
        for digit, zeros in zip(reversed(range(self.digits)), self.zeros, strict=True):
            a, b = zeros[begin], zeros[end]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            rank |= one.astype(np.int64) << digit
            begin, end = np.where(one, zeros[-1] + begin - a, a), np.where(one, zeros[-1] + end - b, b)
        return self.values[rank]


class Sliding(NamedTuple):
    """A statistic of the last `window` rows' values, of which at least `least` are not null: with a quantile that quantile
    (interpolated), without one the share of the current value's rank, ties averaged."""

    value: str
    window: int
    least: int
    quantile: float | None = None


def _statistic(values: np.ndarray, item: Sliding) -> tuple[np.ndarray, np.ndarray]:
    """(result, whether there is one) for each row; missing values are NaN."""
    given = ~np.isnan(values)
    seen = np.concatenate([[0], np.cumsum(given)])
    row = np.arange(len(values))
    begin, end = seen[np.maximum(row - item.window + 1, 0)], seen[1:]
    n = end - begin
    ok = n >= max(item.least, 1)
    if item.quantile is None:
        ok &= given
    out = np.zeros(len(values))
    if ok.any():
        tree = WaveletMatrix(values[given])
        b, e, m = begin[ok], end[ok], n[ok]
        if item.quantile is None:
            rank = tree.rank[seen[:-1][ok]]
            less = tree.below(b, e, rank)
            out[ok] = (less + (tree.below(b, e, rank + 1) - less + 1) / 2) / m
        else:
            at = item.quantile * (m - 1)
            low = np.floor(at).astype(np.int64)
            part = at - low
            lower, upper = tree.kth(b, e, low), tree.kth(b, e, np.minimum(low + 1, m - 1))
            out[ok] = np.where(part == 0, lower, (1 - part) * lower + part * upper)
    return out, ok


def sliding(rows: DataFrame, items: dict[str, Sliding], order: list[str] | None = None, size: int = SIZE, place: str | None = None) -> DataFrame:
    """rows with one column for each item over the windows of its symbol's rows by order (bar_ts), and with `place` one of their places."""
    order = order or ["bar_ts"]
    widest = max(i.window for i in items.values())
    size, given = max(size, 4 * widest), [*rows.columns, *(["__i"] if place else [])]
    values = list(dict.fromkeys(i.value for i in items.values()))
    placed = numbered(rows, ["symbol"], order, "__i").withColumns({f"__v{n}": F.col(v).cast("double") for n, v in enumerate(values)})
    pieces = with_halo(placed, "__i", size, widest - 1)
    schema = placed.select(*[F.col(f"`{c}`") for c in given], *[F.lit(None).cast("double").alias(name) for name in items]).schema

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("__i").to_numpy())))
        own = table.column("__own").to_numpy()
        columns = [table.column(c).filter(pa.array(own)) for c in given]
        for item in items.values():
            v = table.column(f"__v{values.index(item.value)}").to_numpy()
            out, ok = _statistic(v, item)
            columns.append(pa.array(out[own], mask=~ok[own]))
        return pa.Table.from_arrays(columns, schema.names)

    out = pieces.groupBy("symbol", "__piece").applyInArrow(run, schema)
    return out.withColumnRenamed("__i", place) if place else out
