"""Export tables assembled from several operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrowgrid.operators.gating import status_flags
from marrowgrid.operators.sizing import as_model


def effective_method(nodes: DataFrame, method: str, other: str) -> str:
    """``other`` when the chosen method flags no node and the other flags some."""
    hit = nodes.agg(*[F.max(f"is_mrd_{m}").alias(m) for m in (method, other)]).first()
    return other if not hit[method] and hit[other] else method


def patient_table(
    events: DataFrame, nodes: DataFrame, method: str, other: str = "jf", keys: Sequence[str] = ("patient_id", "node_id"),
    condition: str = "condition", patho: str = "Pathologique",
) -> DataFrame:
    """Patient events with the disease flag of their node and status flags."""
    nodes = as_model(nodes.select(*keys, f"is_mrd_{method}", *([f"is_mrd_{other}"] if other != method else [])))
    used = effective_method(nodes, method, other)
    patient = status_flags(events.where(F.col(condition) == patho))
    flags = nodes.select(*keys, F.when(F.col(f"is_mrd_{used}"), 1.0).otherwise(0.0).alias("is_mrd"))
    return patient.join(flags, list(keys), "left").na.fill({"is_mrd": 0.0})
