"""Gate geometry as boolean expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marrowgrid.functions.numeric import col, total


def in_range(value: "str | Column", low: float | None, high: float | None) -> Column:
    """Lower bound inclusive, upper bound exclusive; a missing bound is open."""
    value = col(value)
    inside = F.lit(True)
    if low is not None:
        inside = inside & (value >= F.lit(float(low)))
    if high is not None:
        inside = inside & (value < F.lit(float(high)))
    return inside


def in_rectangle(x, y, x_range: tuple, y_range: tuple) -> Column:
    return in_range(x, *x_range) & in_range(y, *y_range)


def in_polygon(x: "str | Column", y: "str | Column", vertices: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule: an odd number of edges lies to the right of the point."""
    x, y = col(x), col(y)
    crossings = []
    for (x1, y1), (x2, y2) in zip(vertices, [*vertices[1:], vertices[0]]):
        if y1 == y2:
            continue
        spans = (F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)
        edge_x = F.lit(float(x1)) + (y - float(y1)) * float((x2 - x1) / (y2 - y1))
        crossings.append(F.when(spans & (x < edge_x), 1).otherwise(0))
    return total(crossings) % 2 == 1


def in_ellipse(
    columns: Sequence["str | Column"], mean: Sequence[float], inverse: Sequence[Sequence[float]], d2: float
) -> Column:
    """Mahalanobis distance at most ``d2`` (squared)."""
    diff = [col(c) - float(m) for c, m in zip(columns, mean)]
    form = total([diff[i] * diff[j] * float(inverse[i][j]) for i in range(len(diff)) for j in range(len(diff))])
    return form <= F.lit(float(d2))


def quadrants(x: "str | Column", y: "str | Column", x_cut: float, y_cut: float) -> dict[str, Column]:
    """Four regions around a point, by name suffix."""
    right, top = col(x) >= F.lit(float(x_cut)), col(y) >= F.lit(float(y_cut))
    return {
        "Q1_PosPos": right & top,
        "Q2_NegPos": ~right & top,
        "Q3_NegNeg": ~right & ~top,
        "Q4_PosNeg": right & ~top,
    }
