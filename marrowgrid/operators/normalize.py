"""Column scaling: statistics over a scope, then a projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrowgrid.operators.quantiles import quantiles
from marrowgrid.operators.sizing import as_model


def _scaled(events: DataFrame, stats: DataFrame, by: Sequence[str], markers: Sequence[str]) -> DataFrame:
    """Apply (x - shift) / scale from columns ``shift|m`` and ``scale|m``.

    Without keys the single statistics row becomes literals.
    """
    if not by:
        row = stats.first()
        return events.withColumns({
            m: (F.col(m) - F.lit(row[f"shift|{m}"])) / F.lit(row[f"scale|{m}"]) for m in markers})
    joined = events.join(as_model(stats), list(by), "left")
    return joined.withColumns({
        m: (F.col(m) - F.col(f"shift|{m}")) / F.col(f"scale|{m}") for m in markers}).select(*events.columns)


def _nonzero(value: Column) -> Column:
    return F.when(value == 0, 1.0).otherwise(value)


def zscore(events: DataFrame, markers: Sequence[str], by: Sequence[str] = (), ddof: int = 0) -> DataFrame:
    deviation = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = events.groupBy(*by).agg(
        *[F.avg(m).alias(f"shift|{m}") for m in markers],
        *[_nonzero(deviation(m)).alias(f"scale|{m}") for m in markers])
    return _scaled(events, stats, by, markers)


def minmax(events: DataFrame, markers: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    stats = events.groupBy(*by).agg(
        *[F.min(m).alias(f"shift|{m}") for m in markers],
        *[_nonzero(F.max(m) - F.min(m)).alias(f"scale|{m}") for m in markers])
    return _scaled(events, stats, by, markers)


def robust(
    events: DataFrame, markers: Sequence[str], by: Sequence[str] = (), low: float = 0.10, high: float = 0.90,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Scale by the range between two quantiles, learnt on ``fit_on``."""
    base = fit_on if fit_on is not None else events
    ends = {f"{end}|{m}": (m, q) for m in markers for end, q in (("low", low), ("high", high))}
    stats = quantiles(base, list(by), ends).select(
        *by, *[F.col(f"low|{m}").alias(f"shift|{m}") for m in markers],
        *[_nonzero(F.col(f"high|{m}") - F.col(f"low|{m}")).alias(f"scale|{m}") for m in markers])
    return _scaled(events, stats, by, markers)


def against_reference(events: DataFrame, markers: Sequence[str], reference: DataFrame) -> DataFrame:
    """(x - median) / max(IQR / 1.35, 0.01) of the reference rows."""
    from marrowgrid.operators.reference import reference_stats

    center, spread = reference_stats(reference, markers)
    return events.withColumns({m: (F.col(m) - center[m]) / spread[m] for m in markers})


def normalize(events: DataFrame, markers: Sequence[str], method: str, scope: str = "global", sample: str = "sample_id") -> DataFrame:
    """Scale over all stacked events or within each sample."""
    by = [sample] if scope == "sample" else []
    if method == "none":
        return events
    return {"zscore": zscore, "minmax": minmax, "range": minmax, "robust": robust}[method](events, markers, by)
