"""Size checks that choose between a model-sized and a distributed path."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrowgrid.session import staged

#: rows a fitted model (thresholds, codebook, node table) may have to be
#: shipped with the plan instead of being shuffled
MODEL_ROWS = 100_000

#: rows of one group that a single task may sort or hold
GROUP_ROWS = 4_000_000

#: rows of one persisted partition, which a task of an iterative job reads
CACHED_ROWS = 500_000


def as_model(df: DataFrame, limit: int = MODEL_ROWS) -> DataFrame:
    """Evaluate a small result once.

    Up to ``limit`` rows become a local relation, whose exact size lets
    Catalyst broadcast it; a larger result is written to the shared folder and
    joins with it shuffle.
    """
    head = df.limit(limit + 1).toArrow()
    if head.num_rows <= limit:
        return df.sparkSession.createDataFrame(head, schema=df.schema)
    return staged(df, "model")


def model_rows(df: DataFrame, limit: int = MODEL_ROWS) -> list:
    """Rows of a model that must be small; an error when it is not."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"model has more than {limit} rows")
    return rows


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    """Row count of the largest group (of the whole frame without keys)."""
    if not by:
        return df.count()
    return df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def groups_fit(df: DataFrame, by: Sequence[str], bound: int) -> bool:
    """True when no group exceeds ``bound`` rows."""
    if df.count() <= bound:
        return True
    return bool(by) and largest_group(df, by) <= bound


def ordered_pieces(df: DataFrame, order: Sequence[str], piece_rows: int) -> DataFrame:
    """The rows cut into contiguous ranges of ``order``, numbered in ``_piece``.

    Range partitioning splits by the whole sort key, so a crowded group or a
    crowded value of the first column is cut as well.  The result is written
    to the shared folder: piece numbers must not change when a task is retried.
    """
    n = max(1, math.ceil(df.count() / piece_rows))
    ranged = df.repartitionByRange(n, *order)
    return staged(ranged.withColumn("_piece", F.spark_partition_id()), "pieces")


def cached(df: DataFrame, rows: int = CACHED_ROWS) -> DataFrame:
    """Persist the input of an iterative job.

    An input of fewer partitions than the cluster has slots (a small table in
    one file), or of partitions of more than ``rows`` rows (large files), is
    spread evenly; another is left as it lies.
    """
    held = df.persist()
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(held.count() / rows))
    if held.rdd.getNumPartitions() >= wanted:
        return held
    even = df.repartition(wanted).persist()
    even.count()
    held.unpersist()
    return even


def folded(df: DataFrame, count: str = "_n") -> DataFrame:
    """The rows of an iterative job, persisted: equal rows once with their number.

    Instruments record few distinct values, so copies are common; where fewer
    than half of the rows are copies every row stays, with the number 1.
    """
    return cached(counted(df, count))


def counted(df: DataFrame, count: str = "_n") -> DataFrame:
    """The rows that :func:`folded` persists."""
    seen = df.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(*df.columns)).alias("kinds")).first()
    if 2 * seen["kinds"] > seen["n"]:
        return df.withColumn(count, F.lit(1).cast("long"))
    return df.groupBy(*df.columns).agg(F.count("*").alias(count))
