"""Statistics of the normal-marrow reference."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrowgrid.functions.blast import mahalanobis
from marrowgrid.functions.numeric import all_of, is_finite
from marrowgrid.operators.quantiles import quantile_row

MAX_CONDITION = 1e12


def reference_stats(reference: DataFrame, markers: Sequence[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Median and IQR/1.35 (floored at 0.01) per marker over all rows."""
    row = quantile_row(reference, {f"{m}|{q}": (m, q) for m in markers for q in (0.25, 0.5, 0.75)})
    center = {m: row[f"{m}|0.5"] for m in markers}
    spread = {m: max((row[f"{m}|0.75"] - row[f"{m}|0.25"]) / 1.35, 0.01) for m in markers}
    return center, spread


def covariance(reference: DataFrame, markers: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean vector, sample covariance and row count in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(markers) for b in markers[i:]]
    complete = reference.where(all_of(is_finite(m) for m in markers))
    row = complete.agg(
        F.count("*").alias("n"),
        *[F.avg(m).alias(f"m|{m}") for m in markers],
        *[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs],
    ).first()
    index = {m: i for i, m in enumerate(markers)}
    matrix = np.zeros((len(markers), len(markers)))
    for a, b in pairs:
        matrix[index[a], index[b]] = matrix[index[b], index[a]] = row[f"{a}|{b}"]
    return np.array([row[f"m|{m}"] for m in markers]), matrix, row["n"]


def reference_covariance(
    reference: DataFrame, markers: Sequence[str], ridge: float = 1e-4
) -> tuple[np.ndarray, np.ndarray]:
    """Regularised covariance and its pseudo-inverse (d x d, model-sized)."""
    _, matrix, _ = covariance(reference, markers)
    matrix = matrix + ridge * np.eye(len(markers))
    if np.linalg.cond(matrix) > MAX_CONDITION:
        raise ValueError("reference covariance is close to singular")
    return matrix, np.linalg.pinv(matrix)


def robust_covariance(
    reference: DataFrame, markers: Sequence[str], support: float = 0.75, steps: int = 10, ridge: float = 1e-4
) -> tuple[np.ndarray, np.ndarray]:
    """Location and covariance of the densest share of the reference.

    Concentration steps: distances under the current estimate, keep the
    closest ``support`` share, estimate again, until the determinant settles.
    Each step is one quantile and one aggregation over all rows.
    """
    eye = ridge * np.eye(len(markers))
    center, matrix, _ = covariance(reference, markers)
    last = np.inf
    for _ in range(steps):
        inverse = np.linalg.pinv(matrix + eye)
        ranged = reference.withColumn("_d2", mahalanobis(list(markers), center, inverse))
        cut = quantile_row(ranged, {"cut": ("_d2", support)})["cut"]
        center, matrix, _ = covariance(ranged.where(F.col("_d2") <= cut), markers)
        volume = float(np.linalg.slogdet(matrix + eye)[1])
        if last - volume < 1e-6:
            break
        last = volume
    return center, matrix + eye
