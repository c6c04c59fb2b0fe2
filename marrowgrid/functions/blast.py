"""Phenotype scores of a node as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marrowgrid.functions.numeric import clip, col, total

# Default marker weights, matched as substrings in this order.
DEFAULT_WEIGHTS = (
    ("CD34", 3.0),
    ("CD117", 2.5),
    ("CKIT", 2.5),
    ("CD45", -1.0),
    ("HLAD", 1.5),
    ("HLA-DR", 1.5),
    ("CD33", 1.0),
    ("CD13", 0.5),
    ("CD19", -1.5),
    ("CD3", -1.5),
    ("SSC", -1.0),
)
# Category limits of a 0..10 score.
HIGH, MODERATE, WEAK = 6.0, 2.0, 0.0


def marker_weights(
    markers: Sequence[str],
    custom: Mapping[str, float] | None = None,
    panel: Mapping[str, float] | None = None,
) -> dict[str, float]:
    """Weight of each marker: custom before panel before default, else 0."""

    def first_hit(name: str, table) -> float | None:
        return next((float(w) for pattern, w in table if pattern.upper() in name.upper()), None)

    chosen = {}
    for name in markers:
        hits = (first_hit(name, (source or {}).items()) for source in (custom, panel))
        hit = next((h for h in hits if h is not None), None)
        if hit is None:
            hit = first_hit(name.replace("HLA_DR", "HLA-DR"), DEFAULT_WEIGHTS)
        chosen[name] = 0.0 if hit is None else hit
    return chosen


def marker_weight(
    marker: str, custom: Mapping[str, float] | None = None, panel: Mapping[str, float] | None = None,
) -> Column:
    """``marker_weights`` for a column of names, however many there are."""
    plain = F.upper(marker)
    hits = [F.when(plain.contains(p.upper()), F.lit(float(w))) for source in (custom, panel) for p, w in (source or {}).items()]
    dashed = F.replace(plain, F.lit("HLA_DR"), F.lit("HLA-DR"))
    hits += [F.when(dashed.contains(p.upper()), F.lit(float(w))) for p, w in DEFAULT_WEIGHTS]
    return F.coalesce(*hits, F.lit(0.0))


def linear_score(z: Mapping[str, "str | Column"], weights: Mapping[str, float]) -> Column:
    """Directional score 0..10 of z-values against the normal reference.

    A positive weight rewards z above 0.5.  A negative weight rewards z below
    -0.5 and punishes any z above 0.
    """
    zero = F.lit(0.0)
    terms = [zero]
    for name, weight in weights.items():
        value = col(z[name])
        if weight > 0:
            terms.append(F.lit(weight) * F.greatest(zero, value - 0.5))
        elif weight < 0:
            low = F.greatest(zero, -value - 0.5)
            terms.append(F.lit(-weight) * (low - F.greatest(zero, value)))
    scale = max(sum(abs(w) for w in weights.values()), 1e-6)
    return clip(F.greatest(zero, total(terms)) / scale * 10, 0, 10)


def category(score: Column, high: float = HIGH, moderate: float = MODERATE, weak: float = WEAK) -> Column:
    return (
        F.when(score >= high, "BLAST_HIGH")
        .when(score >= moderate, "BLAST_MODERATE")
        .when(score > weak, "BLAST_WEAK")
        .otherwise("NON_BLAST_UNK")
    )


def mahalanobis(
    values: Sequence["str | Column"], center: Sequence[float], inverse: Sequence[Sequence[float]]
) -> Column:
    """Squared distance to ``center`` under a model-sized inverse covariance."""
    diff = [col(v) - F.lit(float(m)) for v, m in zip(values, center)]
    rows = []
    for i, left in enumerate(diff):
        rows.append(left * total([F.lit(float(inverse[i][j])) * right for j, right in enumerate(diff)]))
    return F.greatest(F.lit(0.0), total(rows))


def purity_modulated(d2: Column, purity: Column, power: float) -> Column:
    return d2 * F.pow(clip(purity, 0, 1), F.lit(float(power))) if power > 0 else d2


def mahalanobis_score(d2_modulated: Column, norm: float) -> Column:
    return clip(d2_modulated / max(norm, 1e-6) * 10, 0, 10)


def hybrid_score(
    d2: Column, d2_modulated: Column, linear: Column, *,
    mahal_weight: float = 0.56, linear_weight: float = 0.17, norm: float = 109.28, boost: float = 1.03,
) -> Column:
    boosted = clip(F.when(d2 > norm, linear * boost).otherwise(linear), 0, 10)
    return clip(mahal_weight * mahalanobis_score(d2_modulated, norm) + linear_weight * boosted, 0, 10)


def node_score(
    method: str, *, z: "Mapping[str, str | Column] | None" = None, weights: Mapping[str, float] | None = None,
    values: "Sequence[str | Column] | None" = None, center: Sequence[float] | None = None,
    inverse: Sequence[Sequence[float]] | None = None, purity: Column | None = None, power: float = 0.98, norm: float = 109.28, **hybrid,
) -> tuple[Column, Column | None]:
    """Score 0..10 of a node by ``none``, ``linear``, ``mahalanobis`` or ``hybrid``, and its raw squared distance.

    ``none`` gives every node 10, so each passes the gate.  What a method needs
    must be there: z-values for linear and hybrid, node values with centre and
    inverse covariance for mahalanobis and hybrid; nothing is replaced silently.
    """
    if method == "none":
        return F.lit(10.0), None
    if method not in ("linear", "mahalanobis", "hybrid"):
        raise ValueError(f"unknown score {method}")
    if method != "mahalanobis" and z is None:
        raise ValueError(f"{method} score needs z-values against the normal reference")
    linear = None if z is None else linear_score(z, marker_weights(list(z)) if weights is None else weights)
    if method == "linear":
        return linear, None
    if values is None or center is None or inverse is None:
        raise ValueError(f"{method} score needs node values, centre and inverse covariance of the normal reference")
    d2 = mahalanobis(values, center, inverse)
    modulated = d2 if purity is None else purity_modulated(d2, purity, power)
    if method == "mahalanobis":
        return mahalanobis_score(modulated, norm), d2
    return hybrid_score(d2, modulated, linear, norm=norm, **hybrid), d2


def gate_threshold(
    purity: Column, *, high: float = 2.60, moderate: float = 2.20, strict: float = 0.93, relax: float = 0.13,
) -> Column:
    """Score a node needs; pure nodes need less, never below ``moderate``."""
    excess = clip((purity - strict) / max(1.0 - strict, 1e-6), None, 1)
    relaxed = F.greatest(F.lit(high) * (1 - relax * excess), F.lit(moderate))
    return F.when(purity >= strict, relaxed).otherwise(F.lit(high))
