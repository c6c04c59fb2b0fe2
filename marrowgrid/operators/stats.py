"""Two-sample tests and multiple-testing correction on grouped data.

Ranks come from the counts of distinct values: rows are first reduced to
(group, value) counts, then running sums over the values give mid-ranks and
cumulative distributions.  A group with many distinct values is cut into value
ranges so that no task holds it whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrowgrid.functions.numeric import col
from marrowgrid.operators.sizing import GROUP_ROWS, as_model, groups_fit, ordered_pieces
from marrowgrid.session import staged

# Detection and quantification limits, normal ceiling, fold change.
LOD, LOQ, NBM_MAX, FOLD_CHANGE = 9e-5, 5e-5, 0.011, 1.9


def fold_change(patient: "str | Column", normal: "str | Column") -> Column:
    return col(patient) / F.greatest(col(normal), F.lit(1e-6))


def mrd_status(
    frequency: "str | Column", fold: Column, *, lod: float = LOD, loq: float = LOQ, nbm_max: float = NBM_MAX,
    threshold: float = FOLD_CHANGE,
) -> Column:
    """Status of a follow-up frequency; parameters are explicit because the
    default LOD lies above the LOQ."""
    f = col(frequency)
    return (
        F.when(f < lod, "MRD_NEGATIVE").when(f < loq, "MRD_DETECTABLE_BELOW_LOQ")
        .when(fold >= threshold, "MRD_POSITIVE").when(f > nbm_max, "MRD_INDETERMINATE").otherwise("MRD_NEGATIVE"))


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided tail of the standard normal."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v is not None and not np.isnan(v) else np.nan)


@F.pandas_udf(T.DoubleType())
def kolmogorov_tail(t: pd.Series) -> pd.Series:
    """Asymptotic tail of the Kolmogorov distribution."""
    k = np.arange(1, 101)[None, :]
    v = t.to_numpy(dtype=float, na_value=np.nan)[:, None]
    alternating = 2 * ((-1.0) ** (k - 1) * np.exp(-2 * (k * v) ** 2)).sum(axis=1)
    # the dual series converges for small arguments
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        odd = np.exp(-((2 * k - 1) ** 2) * np.pi**2 / (8 * v**2)).sum(axis=1)
        dual = 1 - np.sqrt(2 * np.pi) / v[:, 0] * odd
    out = np.where(v[:, 0] < 1.0, dual, alternating)
    out = np.where(v[:, 0] <= 0, 1.0, out)
    return pd.Series(np.clip(out, 0.0, 1.0)).where(~np.isnan(v[:, 0]))


@F.pandas_udf(T.DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t, by quadrature over the angle atan(t / sqrt(df))."""
    at, w = np.polynomial.legendre.leggauss(400)
    v, n = (s.to_numpy(dtype=float, na_value=np.nan) for s in (t, df))
    with np.errstate(invalid="ignore", divide="ignore"):
        low = np.arctan(np.abs(v) / np.sqrt(n))
        half = (np.pi / 2 - low) / 2
        angle = low[:, None] + half[:, None] * (at[None, :] + 1)
        tail = half * (w * np.cos(angle) ** (n[:, None] - 1)).sum(axis=1)
    known = ~np.isnan(v) & (n > 0)
    # the whole integral is a ratio of gamma functions
    whole = [math.sqrt(math.pi) / 2 * math.exp(math.lgamma(k / 2) - math.lgamma((k + 1) / 2)) if ok else 1.0 for k, ok in zip(n, known)]
    return pd.Series(np.clip(tail / whole, 0.0, 1.0)).where(known)


def to_long(events: DataFrame, keys: Sequence[str], markers: Sequence[str]) -> DataFrame:
    """(keys, marker, value) rows; missing values are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("marker"), F.col(m).cast("double").alias("value")) for m in markers]))
    return events.select(*keys, pairs.alias("_p")).select(*keys, "_p.marker", "_p.value").where(
        "value IS NOT NULL AND NOT isnan(value)")


def value_counts(long: DataFrame, by: Sequence[str], first: Column, second: Column, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Distinct values per group with both counts and both counts below.

    Adds ``a``, ``b`` (rows of each side at the value), ``ca``, ``cb`` (rows
    of each side below the value).
    """
    by = list(by)
    counts = long.groupBy(*by, "value").agg(F.count_if(first).alias("a"), F.count_if(second).alias("b"))
    if groups_fit(long, by, group_rows):
        order = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counts.withColumn("ca", F.sum("a").over(order) - F.col("a")).withColumn("cb", F.sum("b").over(order) - F.col("b"))
    placed = ordered_pieces(counts, [*by, "value"], max(group_rows // 2, 1))
    running = Window.partitionBy(*by).orderBy("_piece")
    offsets = as_model(
        placed.groupBy(*by, "_piece").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
        .withColumn("_ba", F.sum("_a").over(running) - F.col("_a"))
        .withColumn("_bb", F.sum("_b").over(running) - F.col("_b")).drop("_a", "_b"))
    order = Window.partitionBy(*by, "_piece").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        placed.join(offsets, [*by, "_piece"])
        .withColumn("ca", F.sum("a").over(order) - F.col("a") + F.col("_ba"))
        .withColumn("cb", F.sum("b").over(order) - F.col("b") + F.col("_bb"))
        .drop("_piece", "_ba", "_bb"))


def mann_whitney(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two-sided U test per group from :func:`value_counts`.

    Normal approximation with tie and continuity correction; NULL when a side
    has fewer than two rows.
    """
    t = (F.col("a") + F.col("b")).cast("double")
    # mid-rank of a value: rows below it plus half its own rows plus a half
    mid = F.col("ca") + F.col("cb") + (t + 1) / 2
    sums = counted.groupBy(*by).agg(
        F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum(F.col("a") * mid).alias("_r1"),
        F.sum(t * t * t - t).alias("_ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    # one row, or ties throughout, leave no spread and no z
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, sd)
    enough = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    p = F.when(sd == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.when(z < 0, 2 - normal_two_sided(z)).otherwise(normal_two_sided(z))))
    return sums.select(
        *by, "n1", "n2", F.when(enough, u).alias("u"), F.when(enough & (sd > 0), z).alias("z"), F.when(enough, p).alias("p"))


def kolmogorov_smirnov(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Largest distance of the two cumulative distributions and its p-value."""
    totals = Window.partitionBy(*by)
    size = counted.groupBy(*by).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    gap = F.abs(F.try_divide(F.col("ca") + F.col("a"), F.col("n1")) - F.try_divide(F.col("cb") + F.col("b"), F.col("n2")))
    found = counted.join(as_model(size), list(by)).where("n1 >= 2 AND n2 >= 2").groupBy(*by, "n1", "n2").agg(F.max(gap).alias("d"))
    scale = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    return found.withColumn("p", kolmogorov_tail(F.col("d") * scale))


def compare_conditions(
    events: DataFrame, cluster: str, markers: Sequence[str], condition: str = "condition",
    sain: str = "Sain", patho: str = "Pathologique", min_cells: int = 5,
) -> DataFrame:
    """Per (cluster, marker): medians, fold change, U test; small sides skipped."""
    long = to_long(events, [cluster, condition], markers)
    keys = [cluster, "marker"]
    # the counts serve the test and the medians, so they are written once
    counted = staged(value_counts(long, keys, F.col(condition) == patho, F.col(condition) == sain), "counts")
    tested = as_model(mann_whitney(counted, keys).where((F.col("n1") >= min_cells) & (F.col("n2") >= min_cells)))
    middle = counted.join(tested.select(*keys, "n1", "n2"), keys).groupBy(*keys).agg(
        _median_of("a", "ca", "n1").alias("median_patho"), _median_of("b", "cb", "n2").alias("median_sain"))
    out = tested.join(middle, keys)
    return out.withColumn("fold_change", fold_change("median_patho", "median_sain")).withColumn("significant", F.col("p") < 0.05)


def _median_of(count: str, below: str, total: str) -> Column:
    """Median of one side from its counts at and below each distinct value."""
    holds = lambda rank: (F.col(below) < rank) & (F.col(below) + F.col(count) >= rank)
    low, high = F.floor((F.col(total) + 1) / 2), F.ceil((F.col(total) + 1) / 2)
    return (F.max(F.when(holds(low), F.col("value"))) + F.max(F.when(holds(high), F.col("value")))) / 2


def benjamini_hochberg(tests: DataFrame, p: str, by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Adds ``q`` (step-up adjusted p) and ``neg_log10_p``; one row per test."""
    frame = list(by) or [F.lit(0)]
    ranked = tests.withColumn("_m", F.count(p).over(Window.partitionBy(*frame))).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*frame).orderBy(F.asc_nulls_last(p), *order)))
    raw = F.col(p) * F.col("_m") / F.col("_rank")
    right = Window.partitionBy(*frame).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(raw).over(right))).withColumn(
        "neg_log10_p", -F.log10(F.greatest(F.col(p), F.lit(1e-300)))).drop("_m", "_rank")


def spearman(features: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation per feature (mid-ranks), its t-statistic and two-sided p.

    Below three rows, or without spread, t and p are NULL; a perfect
    correlation has p = 0.
    """
    def mid(name: str) -> Column:
        frame = Window.partitionBy(*by)
        return F.rank().over(frame.orderBy(name)) + (F.count("*").over(Window.partitionBy(*by, name)) - 1) / 2

    ranked = features.withColumn("_rx", mid(x)).withColumn("_ry", mid(y))
    # without spread the quotient is NULL, where corr would stop the job
    rho = F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry"))
    bounded = F.when(F.abs(rho) > 1, F.signum(rho)).otherwise(rho)
    found = ranked.groupBy(*by).agg(bounded.alias("rho"), F.count("*").alias("n"))
    free = F.col("n") - 2
    rest = F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(0.0))
    known = (free > 0) & F.col("rho").isNotNull()
    t = F.when(known, F.try_divide(F.col("rho") * F.sqrt(free.cast("double")), F.sqrt(rest)))
    p = F.when(known, F.when(rest == 0, F.lit(0.0)).otherwise(student_two_sided(t, free.cast("double"))))
    return found.withColumn("t", t).withColumn("p", p)
