"""Integer components of embeddings, shared by the clustering and the top-k search.

A component x becomes floor(256 * x) in double arithmetic. A vector is whole if it is not null and none of its components is
null or non-finite; a component whose 256-fold leaves the range of doubles counts as non-finite.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256.0
LONG = (-(1 << 63), (1 << 63) - 1)
#: Whole numbers up to here are exact in doubles, sums and products included.
EXACT = float(1 << 53)


def embedding_of(embeddings: DataFrame, column: str = "embedding") -> Column:
    """The vectors as single or double precision numbers; single ones are half the bytes to move."""
    single = embeddings.schema[column].dataType.simpleString() == "array<float>"
    return F.col(column) if single else F.col(column).cast("array<double>")


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole, offsets, values) of a list column: row i's components are values[offsets[i]:offsets[i + 1]], whole doubles."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(column.values.cast(pa.float64()).to_numpy(zero_copy_only=False) * SCALE)
    faults = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    whole = (faults[offsets[1:]] == faults[offsets[:-1]]) & ~np.asarray(column.is_null())
    return whole, offsets, values


def matrix(offsets: np.ndarray, values: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """The given rows, all of that width, as a matrix."""
    return values[offsets[rows][:, None] + np.arange(width)]


def python_integers(x: np.ndarray) -> np.ndarray:
    """Whole doubles as Python's integers, for numbers beyond the exact ones."""
    return np.frompyfunc(int, 1, 1)(x)


def to_longs(x: np.ndarray) -> np.ndarray:
    """Integers of any size as longs; what a long can't hold becomes the nearest one."""
    if x.dtype == object:
        return np.array([min(max(v, LONG[0]), LONG[1]) for v in x.ravel()], np.int64).reshape(x.shape)
    return x.astype(np.int64)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The exact inner products of the rows of x with those of y, as longs."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    if np.abs(x).max() * np.abs(y).max() * x.shape[1] < EXACT:
        return (x @ y.T).astype(np.int64)
    return to_longs(python_integers(x) @ python_integers(y).T)
