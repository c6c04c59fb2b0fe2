"""Constraint checks as rows of one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrowgrid.functions.names import is_scatter_name
from marrowgrid.functions.numeric import all_of
from marrowgrid.operators.sizing import as_model


def missing_values(events: DataFrame, markers: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """NULL/NaN count per marker and rows with any."""
    void = {m: F.col(m).isNull() | F.isnan(m) for m in markers}
    anywhere = ~all_of(~c for c in void.values())
    return events.groupBy(*by).agg(
        *[F.count_if(c).alias(f"nan_{m}") for m, c in void.items()], F.count_if(anywhere).alias("rows_with_nan"))


def drop_or_fill(events: DataFrame, markers: Sequence[str], how: str = "drop") -> DataFrame:
    """Drop rows with a missing marker, or fill the markers with zero."""
    return events.na.drop(subset=list(markers)) if how == "drop" else events.na.fill(0.0, subset=list(markers))


def large_samples(events: DataFrame, sample: str, minimum: int = 1000) -> DataFrame:
    """Events of the samples that reach the minimum size."""
    sizes = events.groupBy(sample).count().where(F.col("count") >= minimum).select(sample)
    return events.join(as_model(sizes), sample, "left_semi")


def missing_markers(channels: DataFrame, required: Sequence[str], sample: str = "sample_id", name: str = "name") -> DataFrame:
    """(sample, marker) pairs for which no channel name contains the marker."""
    held = channels.groupBy(sample).agg(*[
        F.max(F.upper(name).contains(m.upper())).alias(m) for m in required])
    absent = F.array_compact(F.array(*[F.when(~F.col(m), F.lit(m)) for m in required]))
    return held.select(sample, F.explode(absent).alias("marker"))


def untransformed(events: DataFrame, markers: Sequence[str], limit: float = -500.0, share: float = 0.05) -> DataFrame:
    """Share of values far below zero per marker; above the limit the data look raw."""
    low = events.agg(*[F.avg((F.col(m) < limit).cast("double")).alias(m) for m in markers])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("marker"), F.col(m).alias("share")) for m in markers]))
    return low.select(rows.alias("_r")).select("_r.*").withColumn("needs_transform", F.col("share") > share)


def compensation_present(samples: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Whether the file metadata name a spillover matrix."""
    keys = F.transform(F.map_keys(metadata), lambda k: F.upper(k))
    known = F.array(*[F.lit(k) for k in ("SPILL", "$SPILLOVER", "SPILLOVER", "$COMP")])
    return samples.withColumn("compensated", F.arrays_overlap(keys, known))


def scatter_among(channels: DataFrame, chosen: DataFrame, name: str = "name") -> DataFrame:
    """Scatter or time channels that were chosen as clustering markers."""
    return channels.where(is_scatter_name(name)).join(chosen, name, "left_semi")


def condition_balance(events: DataFrame, condition: str = "condition", limit: float = 10.0) -> DataFrame:
    counts = events.groupBy(condition).count()
    ratio = F.max("count") / F.min("count")
    return counts.agg(ratio.alias("ratio"), (ratio <= limit).alias("balanced"))


def run_checks(
    events: DataFrame, markers: Sequence[str], fluorescence: Sequence[str], *, minimum: int = 1000,
    condition: str = "condition", balance: float = 10.0,
) -> DataFrame:
    """All event-level checks in one scan: (check, value, passed)."""
    per = events.groupBy(condition).agg(
        F.count("*").alias("n"),
        F.sum(F.when(~all_of(F.col(m).isNotNull() & ~F.isnan(m) for m in markers), 1).otherwise(0)).alias("nan"),
        *[F.sum(F.when(F.col(m) < -500.0, 1).otherwise(0)).alias(f"low|{m}") for m in fluorescence])
    one = per.agg(
        F.sum("n").alias("n"), F.sum("nan").alias("nan"), (F.max("n") / F.min("n")).alias("ratio"),
        F.greatest(*[F.sum(f"low|{m}") / F.sum("n") for m in fluorescence], F.lit(0.0)).alias("low"))
    scatter = sum(1 for m in fluorescence if any(p in m.upper() for p in ("FSC", "SSC", "TIME")))
    rows = [
        ("nan_rows", F.col("nan").cast("double"), F.col("nan") == 0),
        ("min_cells", F.col("n").cast("double"), F.col("n") >= minimum),
        ("transformation", F.col("low"), F.col("low") <= 0.05),
        ("no_scatter", F.lit(float(scatter)), F.lit(scatter == 0)),
        ("balance", F.col("ratio"), F.col("ratio") <= balance),
    ]
    made = [F.struct(F.lit(n).alias("check"), v.alias("value"), p.alias("passed")) for n, v, p in rows]
    return one.select(F.explode(F.array(*made)).alias("_r")).select("_r.*")
