"""Spectral unmixing of detector readings into abundances."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_autofluorescence(reference: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Reference spectra (rows) and one more of unit norm for the background."""
    norm = float(np.linalg.norm(background))
    return np.vstack([reference, background / norm if norm > 0 else background])


def least_squares(events: DataFrame, detectors: Sequence[str], reference: np.ndarray, names: Sequence[str]) -> DataFrame:
    """Unconstrained abundances: each one a linear expression of the detectors."""
    inverse = np.linalg.pinv(np.asarray(reference, dtype=float).T)
    return events.withColumns({
        n: reduce(lambda a, b: a + b, [F.lit(float(inverse[i][j])) * F.col(d) for j, d in enumerate(detectors)])
        for i, n in enumerate(names)})


def _non_negative(y: np.ndarray, spectra: np.ndarray) -> np.ndarray:
    """Exact non-negative least squares of all rows of a batch, by exchanging their sets of positive sources.

    Rows with equal sets are solved together.  All violated sources of a row are exchanged at once while that leaves
    fewer violations than the best so far; after three rounds without progress only the last violated source is, which
    cannot cycle.  Ends when every row satisfies the conditions of optimality.
    """
    gram, target = spectra @ spectra.T, y @ spectra.T
    n, k = target.shape
    tol = 1e-10 * max(1.0, float(np.abs(target).max(initial=0.0)))
    used = np.ones((n, k), bool)
    patience, best = np.full(n, 3), np.full(n, k + 1)
    x, slope = np.zeros((n, k)), np.zeros((n, k))
    open_ = np.arange(n)
    while len(open_):
        patterns, of = np.unique(used[open_], axis=0, return_inverse=True)
        for number, pattern in enumerate(patterns):
            rows = open_[of.ravel() == number]
            on = np.nonzero(pattern)[0]
            x[rows] = 0.0
            if len(on):
                x[np.ix_(rows, on)] = np.linalg.lstsq(gram[np.ix_(on, on)], target[np.ix_(rows, on)].T, rcond=None)[0].T
            slope[rows] = x[rows] @ gram - target[rows]
        wrong = np.where(used[open_], x[open_] < -tol, slope[open_] < -tol)
        count = wrong.sum(1)
        open_, wrong, count = open_[count > 0], wrong[count > 0], count[count > 0]
        better = count < best[open_]
        best[open_] = np.where(better, count, best[open_])
        patience[open_] = np.where(better, 3, patience[open_] - 1)
        single = patience[open_] < 0
        last = k - 1 - wrong[:, ::-1].argmax(1)
        wrong[single] = False
        wrong[single, last[single]] = True
        used[open_] ^= wrong
    return np.maximum(x, 0.0)


def non_negative(
    events: DataFrame, detectors: Sequence[str], reference: np.ndarray, names: Sequence[str], residual: str = "residual"
) -> DataFrame:
    """Non-negative abundances and the residual norm of every event, per Arrow batch."""
    keep = [c for c in events.columns if c not in detectors]
    schema = T.StructType([events.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in (*names, residual)])
    sent = events.sparkSession.sparkContext.broadcast(np.asarray(reference, dtype=float))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectra = sent.value
        for batch in batches:
            y = np.column_stack([batch.column(len(keep) + i).to_numpy(zero_copy_only=False) for i in range(len(detectors))])
            x = _non_negative(np.nan_to_num(y.astype(float)), spectra)
            left = np.sqrt(((y - x @ spectra) ** 2).sum(axis=1))
            made = [pa.array(x[:, j]) for j in range(len(names))] + [pa.array(left)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + made, names=schema.names)

    return events.select(*keep, *detectors).mapInArrow(solve, schema)
