"""Array expressions over marker vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from marrowgrid.functions.numeric import col


def vector(markers: Sequence[str]) -> Column:
    return F.array(*[F.col(m).cast("double") for m in markers])


def _fold(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)


def dot(a: "str | Column", b: "str | Column") -> Column:
    return _fold(F.zip_with(col(a), col(b), lambda x, y: x * y))


def euclidean(a, b) -> Column:
    return F.sqrt(_fold(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a, b) -> Column:
    return _fold(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y)))


def chebyshev(a, b) -> Column:
    return F.array_max(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y)))


def cosine(a, b) -> Column:
    """1 - cosine similarity, 1 when a vector is zero."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return 1 - F.coalesce(F.try_divide(dot(a, b), size), F.lit(0.0))


DISTANCES = {"euclidean": euclidean, "manhattan": manhattan, "chebyshev": chebyshev, "cosine": cosine}


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix, inside a task."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1) if rows else np.empty((0, 0))


def squared_distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Block of squared euclidean distances (one matrix product)."""
    d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ codes.T) + (codes * codes).sum(axis=1)[None, :]
    return np.maximum(d, 0.0)


def nearest(x: np.ndarray, codes: np.ndarray, piece: int = 2048) -> np.ndarray:
    """Number of the nearest code of each row; half the squared distance but for a term of the row itself decides.

    Pieces keep the products in the processor's cache.
    """
    sides = np.vstack([-codes.T, 0.5 * (codes * codes).sum(axis=1)])
    rows = np.column_stack([x, np.ones(len(x))])
    best = np.empty(len(x), dtype="int64")
    for i in range(0, len(rows), piece):
        best[i:i + piece] = (rows[i:i + piece] @ sides).argmin(axis=1)
    return best
