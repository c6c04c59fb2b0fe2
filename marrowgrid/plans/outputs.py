"""Columns added to events for export."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrowgrid.operators.sizing import as_model


def flow_columns(
    events: DataFrame, xdim: int, *, node: str = "node_id", metacluster: str = "metacluster", condition: str = "condition", sain: str = "Sain",
    key: str = "event_id", radius: float = 0.45, seed: int = 42,
) -> DataFrame:
    """1-based node and metacluster, condition code, node size and jittered grid place.

    The jitter fills a disc whose radius grows with the square root of the
    node size; it is drawn from a hash of the event key, so it repeats.
    """
    sizes = events.groupBy(node).agg(F.count("*").alias("size"))
    top = sizes.agg(F.max("size")).first()[0]
    unit = lambda salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), key), F.lit(1 << 30)) / float(1 << 30))
    reach = F.lit(radius) * F.sqrt(F.col("size") / float(top)) * F.sqrt(unit(1))
    angle = unit(2) * (2 * math.pi)
    return events.join(as_model(sizes), node).select(
        *[c for c in events.columns if c not in (node, metacluster)],
        (F.col(node) + 1).alias("node"), (F.col(metacluster) + 1).alias("metacluster"),
        F.when(F.col(condition) == sain, 1).otherwise(2).alias("condition_code"), "size",
        (F.col(node) % xdim + 1.0).alias("x_center"), (F.floor(F.col(node) / xdim) + 1.0).alias("y_center"),
        (F.col(node) % xdim + 1.0 + reach * F.cos(angle)).alias("x_grid"),
        (F.floor(F.col(node) / xdim) + 1.0 + reach * F.sin(angle)).alias("y_grid"))
