"""Acquisition quality: dispersion and stability over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marrowgrid.functions.numeric import all_of
from marrowgrid.operators.quantiles import medians
from marrowgrid.operators.sizing import GROUP_ROWS, as_model, groups_fit, ordered_pieces

# Robust deviation scale and default limits.
MAD_SCALE, Z_LIMIT, TIME_BINS, MIN_BIN_ROWS, TINY = 1.4826, 5.0, 200, 10, 1e-9


def robust_center(events: DataFrame, sample: str, channels: Sequence[str]) -> DataFrame:
    """Median and scaled MAD of each channel per sample."""
    middle = as_model(medians(events, [sample], {f"med|{c}": c for c in channels}))
    off = events.join(middle, sample)
    spread = medians(off, [sample], {f"mad|{c}": F.abs(F.col(c) - F.col(f"med|{c}")) for c in channels})
    return as_model(middle.join(spread, sample).withColumns({
        f"sig|{c}": F.col(f"mad|{c}") * MAD_SCALE for c in channels}).drop(*[f"mad|{c}" for c in channels]))


def robust_z(events: DataFrame, sample: str, channels: Sequence[str], center: DataFrame | None = None) -> DataFrame:
    """Adds ``z_<channel>``: distance to the median in robust deviations, 0 without spread."""
    center = robust_center(events, sample, channels) if center is None else center
    made = {
        f"z_{c}": F.when(F.col(f"sig|{c}") > 0, F.abs(F.col(c) - F.col(f"med|{c}")) / F.col(f"sig|{c}")).otherwise(0.0)
        for c in channels}
    return events.join(center, sample).withColumns(made).select(*events.columns, *made)


def dispersion_mask(events: DataFrame, sample: str, channels: Sequence[str], limit: float = Z_LIMIT,
                    center: DataFrame | None = None) -> DataFrame:
    """Adds ``qc_dispersion``: every channel within ``limit`` robust deviations."""
    scored = robust_z(events, sample, channels, center)
    return scored.withColumn("qc_dispersion", all_of(F.col(f"z_{c}") <= limit for c in channels)).select(
        *events.columns, "qc_dispersion")


def equal_count_bins(
    events: DataFrame, sample: str, order: Sequence[str], bins: int, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Adds ``bin``: equal-count bins of each sample in the given order.

    The first rows-modulo-bins bins hold one row more.  Samples too large for
    one task are cut into ranges of the whole sort key; ranges are counted, and
    only the rows of one range are ranked together.
    """
    def bin_of(rank):
        # rank is 0-based; _n rows in all
        small, extra = F.floor(F.col("_n") / bins), F.col("_n") % bins
        head = extra * (small + 1)
        return F.when(rank < head, F.floor(rank / (small + 1))).otherwise(
            extra + F.floor((rank - head) / F.greatest(small, F.lit(1))))

    if groups_fit(events, [sample], group_rows):
        return events.withColumn("bin", F.ntile(bins).over(Window.partitionBy(sample).orderBy(*order)) - 1)
    cut = ordered_pieces(events, [sample, *order], max(group_rows // 2, 1))
    running = Window.partitionBy(sample).orderBy("_piece")
    offsets = as_model(
        cut.groupBy(sample, "_piece").agg(F.count("*").alias("_c"))
        .withColumn("_before", F.sum("_c").over(running) - F.col("_c"))
        .withColumn("_n", F.sum("_c").over(Window.partitionBy(sample))).drop("_c"))
    placed = cut.join(offsets, [sample, "_piece"])
    rank = F.row_number().over(Window.partitionBy(sample, "_piece").orderBy(*order)) - 1 + F.col("_before")
    return placed.withColumn("_rank", rank).withColumn("bin", bin_of(F.col("_rank")).cast("int")).select(
        *events.columns, "bin")


def temporal_mask(
    events: DataFrame, sample: str, order: Sequence[str], channels: Sequence[str], *, bins: int = TIME_BINS,
    limit: float = Z_LIMIT, min_rows: int = MIN_BIN_ROWS, center: DataFrame | None = None,
) -> DataFrame:
    """Adds ``qc_time``: the event's time bin has no drifting channel median.

    Bins below ``min_rows`` rows fail; samples with fewer than twice that pass
    as a whole.
    """
    center = robust_center(events, sample, channels) if center is None else center
    binned = equal_count_bins(events, sample, order, bins)
    size = binned.groupBy(sample, "bin").agg(F.count("*").alias("_rows"))
    middle = medians(binned, [sample, "bin"], {f"bm|{c}": c for c in channels})
    total = F.sum("_rows").over(Window.partitionBy(sample))
    stats = middle.join(size, [sample, "bin"]).withColumn("_total", total).join(center, sample)
    drift = ~all_of(
        F.abs(F.col(f"bm|{c}") - F.col(f"med|{c}")) <= limit * F.greatest(F.col(f"sig|{c}"), F.lit(TINY * MAD_SCALE))
        for c in channels)
    bad = (drift | (F.col("_rows") < min_rows)) & (F.col("_total") >= 2 * min_rows)
    verdict = as_model(stats.select(sample, "bin", (~bad).alias("qc_time")))
    return binned.join(verdict, [sample, "bin"]).select(*events.columns, "qc_time")


def quality_masks(events: DataFrame, sample: str, order: Sequence[str], channels: Sequence[str], **kw) -> DataFrame:
    """Both masks and their conjunction ``qc_pass``."""
    center = robust_center(events, sample, channels)
    timed = temporal_mask(events, sample, order, channels, center=center, **kw)
    both = dispersion_mask(timed, sample, channels, center=center)
    return both.withColumn("qc_pass", F.col("qc_time") & F.col("qc_dispersion"))


def quality_report(masked: DataFrame, sample: str, warn_below: float = 0.5) -> DataFrame:
    """Pass fractions per sample with a warning flag."""
    out = masked.groupBy(sample).agg(
        F.count("*").alias("n_events"), F.count_if("qc_pass").alias("n_pass"),
        F.avg(F.col("qc_time").cast("double")).alias("frac_time"),
        F.avg(F.col("qc_dispersion").cast("double")).alias("frac_dispersion"),
        F.avg(F.col("qc_pass").cast("double")).alias("frac_pass"))
    return out.withColumn("warn", F.col("frac_pass") < warn_below)
