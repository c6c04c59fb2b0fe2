"""Reproducible sampling without replacement.

Rows are ordered by a hash of their key, so a sample does not depend on the
partitioning and can be repeated by any engine that has MD5.  Taking the n
smallest hashes of a group needs no sort of the group: a histogram over hash
prefixes finds the prefix at which the quota is reached, all rows below it are
taken by a filter and only the rows of that one prefix are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrowgrid.operators.sizing import GROUP_ROWS, as_model, groups_fit
from marrowgrid.session import staged

_PREFIX = 4  # hex digits: 65 536 prefixes
_TOP = 1_000  # rows each task may send to one sorted merge
_FEW = 100  # quotas up to which the rows of a group are cut by a bound on their hash first


def hash_order(*keys: "str | Column", seed: int = 42) -> Column:
    """Hex string whose order is a seeded random order of the keys."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def _same(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return reduce(and_, [x.eqNullSafe(y) for x, y in zip(a, b)])


def _few(marked: DataFrame, by: list[str], quota: int) -> DataFrame:
    """The rows of which the ``quota`` first by hash are among, of every group.

    Of a group much larger than its quota only rows below a bound are kept that leaves some hundred rows too many; they
    are counted, and where a group lacks rows (its hashes are not spread evenly) every row is kept.
    """
    margin = quota + 8 * math.ceil(math.sqrt(quota)) + 40
    sizes = as_model(marked.groupBy(*by).agg(F.count("*").alias("_c")).select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], "_c"))
    if (sizes.agg(F.max("_c")).first()[0] or 0) <= 4 * margin:
        return marked
    bound = F.when(F.col("_c") > 4 * margin, F.lower(F.lpad(F.hex(F.floor(F.lit(float(margin << 32)) / F.col("_c"))), 8, "0"))).otherwise("g")
    limits = sizes.withColumn("_bound", bound)
    match = _same([F.col(b) for b in by], [F.col(f"_by{i}") for i in range(len(by))])
    near = staged(marked.join(limits, match).where(F.col("_h") < F.col("_bound")).select(*marked.columns), "near")
    held = near.groupBy(*by).agg(F.count("*").alias("_held"))
    lacking = limits.join(held, match, "left").where(F.coalesce("_held", F.lit(0)) < F.least("_c", F.lit(quota)))
    return near if lacking.isEmpty() else marked


def smallest(
    df: DataFrame,
    by: Sequence[str],
    quota: "int | Column",
    order: Column,
    *,
    ties: Sequence[str] = (),
    group_rows: int = GROUP_ROWS,
    rank: str | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """The ``quota`` rows of each group with the smallest ``order`` (a hex hash).

    ``quota`` may be a column that is constant within a group.  ``ties`` are
    further columns that make the order total.  ``rank`` names a column for the
    position (from 1) of each row in its group.  ``sizes`` are the groups' rows
    in a column ``_size``, where they are known.
    """
    by = list(by)
    wanted = F.lit(quota) if isinstance(quota, int) else quota
    marked = df.withColumn("_h", order).withColumn("_quota", wanted)
    total_order = ["_h", *ties]
    if by and rank is None and isinstance(quota, int) and sizes is not None:
        # groups within their quota need no order; worth a second scan where they have most of the rows
        large = sizes.where(F.col("_size") > quota)
        rows, ranked = sizes.agg(F.sum("_size"), F.sum(F.when(F.col("_size") > quota, F.col("_size")))).first()
        if 2 * (ranked or 0) < (rows or 0):
            if not ranked:
                return df
            match = _same([F.col(b) for b in by], [F.col(f"_by{i}") for i in range(len(by))])
            large = large.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)])
            part = smallest(df.join(large, match, "left_semi"), by, quota, order, ties=ties, group_rows=group_rows)
            return df.join(large, match, "left_anti").unionByName(part)
    if by and rank is None and isinstance(quota, int) and sizes is None and quota <= _FEW:
        marked = _few(marked, by, quota)
        df = marked.select(*df.columns)
    if by and (sizes.where(F.col("_size") > group_rows).isEmpty() if sizes is not None else groups_fit(df, by, group_rows)):
        ranked = marked.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*total_order)))
        # a literal quota lets Spark cut each group before the shuffle
        limit = F.lit(quota) if isinstance(quota, int) else F.col("_quota")
        chosen = ranked.where(F.col("_rank") <= limit).drop("_h", "_quota")
        return chosen.drop("_rank") if rank is None else chosen.withColumn(rank, F.col("_rank").cast("long")).select(*df.columns, rank)
    if not by and rank is None and isinstance(quota, int) and (quota <= _TOP or groups_fit(df, by, group_rows)):
        # every task keeps at most ``quota`` rows before they meet
        return marked.orderBy(*total_order).limit(quota).drop("_h", "_quota")
    keyed = marked.withColumn("_pre", F.substring("_h", 1, _PREFIX))
    frame = by or ["_all"]
    keyed = keyed if by else keyed.withColumn("_all", F.lit(1))
    running = Window.partitionBy(*frame).orderBy("_pre")
    sizes = (
        keyed.groupBy(*frame, "_pre")
        .agg(F.count("*").alias("_c"), F.max("_quota").alias("_q"))
        .withColumn("_cum", F.sum("_c").over(running)))
    edge = as_model(
        sizes.where("_cum >= _q AND _cum - _c < _q")
        .select(*frame, F.col("_pre").alias("_edge"), (F.col("_q") - F.col("_cum") + F.col("_c")).alias("_rest"))
    )
    placed = keyed.join(edge, frame, "left")
    # no edge: the group is smaller than its quota (or the quota is zero)
    whole = placed.where("_quota > 0 AND (_edge IS NULL OR _pre < _edge)")
    last = (
        placed.where("_pre = _edge")
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*frame, "_pre").orderBy(*total_order)))
        .where("_rank <= _rest")
        .drop("_rank")
    )
    chosen = whole.unionByName(last)
    if rank is None:
        return chosen.select(*df.columns)
    # the rows below a prefix are known, so a rank is needed within it only
    below = as_model(sizes.select(*frame, "_pre", (F.col("_cum") - F.col("_c")).alias("_below")))
    place = F.row_number().over(Window.partitionBy(*frame, "_pre").orderBy(*total_order))
    return chosen.join(below, [*frame, "_pre"]).withColumn(rank, (F.col("_below") + place).cast("long")).select(*df.columns, rank)


def take(df: DataFrame, n: int, order: Column, **kw) -> DataFrame:
    """Exactly ``n`` random rows of the frame (all when it has fewer)."""
    return smallest(df, [], n, order, **kw)


def weighted_take(df: DataFrame, n: int, weight: Column, order: Column, **kw) -> DataFrame:
    """``n`` rows without replacement, inclusion growing with ``weight``.

    Each row draws an exponential arrival time with rate ``weight`` from its
    hash; the earliest ``n`` arrivals are kept.
    """
    from marrowgrid.operators.quantiles import quantile_row

    unit = (F.conv(F.substring(order, 1, 12), 16, 10).cast("double") + 1) / F.lit(float(16**12 + 1))
    timed = df.withColumn("_t", -F.log(unit) / F.greatest(weight, F.lit(1e-300)))
    total = timed.count()
    if total <= n:
        return timed.drop("_t")
    cut = quantile_row(timed, {"cut": ("_t", (n - 1) / (total - 1))})["cut"]
    early, late = F.lit(cut) * (1 - 1e-12), F.lit(cut) * (1 + 1e-12)
    before = timed.where(F.col("_t") < early)
    # arrivals equal to the cut are dealt by their order until n rows are met
    tied = take(timed.where((F.col("_t") >= early) & (F.col("_t") <= late)), n - before.count(), order, **kw)
    return before.unionByName(tied).drop("_t")
