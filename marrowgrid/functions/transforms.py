"""Marker transforms: built-in expressions where a closed form exists."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrowgrid.functions.numeric import col

# Scale parameters and channel patterns never transformed.
COFACTOR = 5.0
TOP, DECADES, LINEAR_WIDTH, EXTRA = 262144.0, 4.5, 0.5, 0.0
SCATTER_PATTERNS = ("FSC", "SSC", "TIME", "EVENT", "WIDTH", "HEIGHT")


def _asinh(value: Column) -> Column:
    """Odd form: the built-in loses digits on large negative numbers."""
    return F.signum(value) * F.asinh(F.abs(value))


def arcsinh(value: "str | Column", cofactor: float = COFACTOR) -> Column:
    return _asinh(col(value) / cofactor)


def arcsinh_inverse(value: "str | Column", cofactor: float = COFACTOR) -> Column:
    return F.sinh(col(value)) * cofactor


def floored_log(value: "str | Column", base: float = 10.0, floor: float = 1.0) -> Column:
    return F.log(F.greatest(col(value), F.lit(floor))) / math.log(base)


def logicle_closed(value: "str | Column", top: float = TOP, decades: float = DECADES) -> Column:
    """Closed form used where the exact scale is not needed."""
    return _asinh(col(value) / (top / 10**decades)) * (decades / math.log(10))


def linear_scale(value: "str | Column", top: float, extra: float = 0.0) -> Column:
    return (col(value) + extra) / (top + extra)


def arcsinh_scale(value: "str | Column", top: float, decades: float, extra: float) -> Column:
    """Asinh display scale with explicit top, decades and negative decades."""
    ln10 = math.log(10)
    lead = _asinh(col(value) * math.sinh(decades * ln10) / top)
    return (lead + extra * ln10) / ((decades + extra) * ln10)


def _root(low: float, high: float, f: Callable[[float], float]) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        if f(mid) > 0:
            high = mid
        else:
            low = mid
    return (low + high) / 2


def logicle_parameters(top: float, decades: float, width: float, extra: float) -> dict[str, float]:
    """Constants of the biexponential S(y) = a e^(by) - c e^(-dy) + f."""
    b = (decades + extra) * math.log(10)
    w = width / (decades + extra)
    x2 = extra / (decades + extra)
    x1, x0 = x2 + w, x2 + 2 * w
    d = b if w == 0 else _root(1e-12, b, lambda v: 2 * (math.log(v) - math.log(b)) + w * (b + v))
    ca = math.exp(x0 * (b + d))
    fa = math.exp(b * x1) - ca / math.exp(d * x1)
    a = top / (math.exp(b) - fa - ca / math.exp(d))
    return {"a": a, "b": b, "c": ca * a, "d": d, "f": -fa * a, "x1": x1}


def logicle_inverse(y: "str | Column", top=TOP, decades=DECADES, width=LINEAR_WIDTH, extra=EXTRA) -> Column:
    """Display value back to intensity; odd around the zero point."""
    p = logicle_parameters(top, decades, width, extra)
    y = col(y)
    up = F.greatest(y, F.lit(2 * p["x1"]) - y)
    value = F.lit(p["a"]) * F.exp(up * p["b"]) - F.lit(p["c"]) * F.exp(up * -p["d"]) + p["f"]
    return F.when(y >= p["x1"], value).otherwise(-value)


def hyperlog_parameters(top: float, decades: float, width: float, extra: float) -> dict[str, float]:
    """Constants of S(y) = a e^(by) + c y - f."""
    b = (decades + extra) * math.log(10)
    w = width / (decades + extra)
    x2 = extra / (decades + extra)
    x1, x0 = x2 + w, x2 + 2 * w
    e0 = math.exp(b * x0)
    ca = e0 / w
    fa = math.exp(b * x1) + ca * x1
    a = top / (math.exp(b) + ca - fa)
    return {"a": a, "b": b, "c": ca * a, "f": fa * a, "x1": x1}


def hyperlog_inverse(y: "str | Column", top=TOP, decades=DECADES, width=LINEAR_WIDTH, extra=EXTRA) -> Column:
    p = hyperlog_parameters(top, decades, width, extra)
    y = col(y)
    up = F.greatest(y, F.lit(2 * p["x1"]) - y)
    value = F.lit(p["a"]) * F.exp(up * p["b"]) + up * p["c"] - p["f"]
    return F.when(y >= p["x1"], value).otherwise(-value)


def _solved(value: "str | Column", x1: float, s, ds) -> Column:
    """Invert an increasing convex S on a column batch.

    Newton steps from above converge monotonically; a log-spaced table gives
    the start, values beyond the table start at its end.
    """
    grid = np.linspace(x1, x1 + 1.5, 4096)
    table = s(grid)

    @F.pandas_udf("double")
    def solve(batch: pd.Series) -> pd.Series:
        raw = batch.to_numpy(dtype=float, na_value=np.nan)
        size = np.abs(raw)
        y = np.interp(size, table, grid)
        for _ in range(12):
            y = y - (s(y) - size) / ds(y)
        # odd around the zero point
        return pd.Series(np.where(np.isnan(raw), np.nan, np.where(raw < 0, 2 * x1 - y, y)))

    return solve(col(value).cast("double"))


def logicle(value: "str | Column", top=TOP, decades=DECADES, width=LINEAR_WIDTH, extra=EXTRA) -> Column:
    """Exact logicle scale, solved per Arrow batch."""
    p = logicle_parameters(top, decades, width, extra)
    a, b, c, d, f = (p[k] for k in "abcdf")
    return _solved(
        value, p["x1"],
        lambda y: a * np.exp(b * y) - c * np.exp(-d * y) + f,
        lambda y: a * b * np.exp(b * y) + c * d * np.exp(-d * y))


def hyperlog(value: "str | Column", top=TOP, decades=DECADES, width=LINEAR_WIDTH, extra=EXTRA) -> Column:
    p = hyperlog_parameters(top, decades, width, extra)
    a, b, c, f = (p[k] for k in "abcf")
    return _solved(value, p["x1"], lambda y: a * np.exp(b * y) + c * y - f, lambda y: a * b * np.exp(b * y) + c)


_METHODS: dict[str, Callable[..., Column]] = {
    "arcsinh": arcsinh,
    "log": floored_log,
    "log10": floored_log,
    "logicle": logicle,
    "logicle_closed": logicle_closed,
    "hyperlog": hyperlog,
    "linear": linear_scale,
    "asinh": arcsinh_scale,
    "none": col,
}


def is_scatter(name: str) -> bool:
    return any(p in name.upper() for p in SCATTER_PATTERNS)


def transform_markers(
    events: DataFrame, markers: Sequence[str], method: str, *, apply_to_scatter: bool = False, **params: float
) -> DataFrame:
    """One method on every fluorescence marker; scatter and time stay as they are."""
    chosen = [m for m in markers if apply_to_scatter or not is_scatter(m)]
    return events.withColumns({m: _METHODS[method](m, **params) for m in chosen})


def transform_columns(events: DataFrame, specs: Mapping[str, Mapping]) -> DataFrame:
    """A method per column; names that do not exist are ignored."""
    made = {}
    for name, spec in specs.items():
        if name in events.columns:
            options = {k: v for k, v in spec.items() if k != "method"}
            made[name] = _METHODS[spec["method"]](name, **options)
    return events.withColumns(made) if made else events
