"""Small numeric expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: "str | Column") -> Column:
    return F.col(value) if isinstance(value, str) else value


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def total(terms: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def clip(value: Column, low: float | None, high: float | None) -> Column:
    if low is not None:
        value = F.greatest(value, F.lit(float(low)))
    if high is not None:
        value = F.least(value, F.lit(float(high)))
    return value


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, with an empty whole counted as one."""
    return F.lit(100.0) * part / F.greatest(whole, F.lit(1))


def is_finite(value: "str | Column") -> Column:
    value = col(value)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite_or(value: "str | Column", nan: float, pos: float, neg: float) -> Column:
    """Replace NULL/NaN and the two infinities by plain numbers."""
    value = col(value).cast("double")
    return (
        F.when(value.isNull() | F.isnan(value), F.lit(float(nan)))
        .when(value == F.lit(float("inf")), F.lit(float(pos)))
        .when(value == F.lit(float("-inf")), F.lit(float(neg)))
        .otherwise(value)
    )
