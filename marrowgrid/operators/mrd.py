"""Minimal residual disease: node counts, three flagging rules, patient totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrowgrid.functions import blast
from marrowgrid.functions.numeric import col, percent

METHODS = ("jf", "flo", "eln")


@dataclass(frozen=True)
class MrdRules:
    """Limits of the three rules and the condition labels."""

    max_normal_marrow_pct: float = 2.0
    min_patho_cells_pct: float = 10.0
    normal_marrow_multiplier: float = 2.0
    min_cluster_events: int = 50
    clinical_positivity_pct: float = 0.1
    sain: str = "Sain"
    patho: str = "Pathologique"


def node_counts(
    events: DataFrame,
    by: Sequence[str] = ("patient_id",),
    node: str = "node_id",
    condition: str = "condition",
    rules: MrdRules = MrdRules(),
    cd45_mask: "str | Column | None" = None,
) -> DataFrame:
    """Events per node, in all and per condition: one partial aggregation."""
    patho = F.col(condition) == rules.patho
    aggs = [
        F.count("*").alias("n_total"),
        F.count_if(F.col(condition) == rules.sain).alias("n_sain"),
        F.count_if(patho).alias("n_patho"),
    ]
    if cd45_mask is not None:
        aggs.append(F.count_if(patho & col(cd45_mask)).alias("n_patho_cd45"))
    return events.groupBy(*by, node).agg(*aggs)


def node_shares(counts: DataFrame, by: Sequence[str] = ("patient_id",)) -> DataFrame:
    """Percentages of each node and the patient totals beside them."""
    patient = Window.partitionBy(*by)
    return (
        counts.withColumn("total_sain", F.sum("n_sain").over(patient))
        .withColumn("total_patho", F.sum("n_patho").over(patient))
        .withColumn("pct_sain", 100.0 * F.col("n_sain") / F.col("n_total"))
        .withColumn("pct_patho", 100.0 * F.col("n_patho") / F.col("n_total"))
        .withColumn("pct_sain_global", percent(F.col("n_sain"), F.col("total_sain")))
        .withColumn("node_purity", F.col("n_patho") / F.col("n_total"))
    )


def flag_nodes(
    shares: DataFrame, rules: MrdRules = MrdRules(), gates: Mapping[str, Column] | None = None
) -> DataFrame:
    """Flags of the three rules; ``gates`` adds a phenotype condition per rule."""
    gates = gates or {}
    imbalance = F.greatest(F.col("total_sain") / F.greatest(F.col("total_patho"), F.lit(1)), F.lit(1.0))
    flo = F.when(
        F.col("pct_sain") > 0,
        F.col("pct_patho") > F.col("pct_sain") * rules.normal_marrow_multiplier * imbalance,
    ).otherwise(F.col("n_patho") >= rules.min_cluster_events)
    flags = {
        "jf": (F.col("pct_patho") > rules.min_patho_cells_pct)
        & (F.col("pct_sain_global") < rules.max_normal_marrow_pct),
        "flo": flo,
        "eln": (F.col("n_total") >= rules.min_cluster_events) & (F.col("pct_patho") > F.col("pct_sain")),
    }
    return shares.withColumns({
        f"is_mrd_{m}": flags[m] & gates[m] if m in gates else flags[m] for m in METHODS
    })


def summarize(
    nodes: DataFrame, by: Sequence[str] = ("patient_id",), rules: MrdRules = MrdRules()
) -> DataFrame:
    """One row per patient with the residual disease by each rule."""
    aggs = [
        F.sum("n_patho").alias("total_patho"),
        F.sum("n_sain").alias("total_sain"),
    ]
    if "n_patho_cd45" in nodes.columns:
        aggs.append(F.sum("n_patho_cd45").alias("_cd45"))
    for m in METHODS:
        aggs.append(F.sum(F.when(F.col(f"is_mrd_{m}"), F.col("n_patho")).otherwise(0)).alias(f"mrd_cells_{m}"))
        aggs.append(F.count_if(F.col(f"is_mrd_{m}")).alias(f"n_nodes_{m}"))
    out = nodes.groupBy(*by).agg(*aggs)
    patho = F.col("total_patho")
    denominator = F.when(F.col("_cd45") > 0, F.col("_cd45")).otherwise(patho) if "_cd45" in out.columns else patho
    out = out.withColumn("denominator", denominator).drop("_cd45")
    for m in METHODS:
        out = out.withColumn(
            f"mrd_pct_{m}",
            F.when(F.col("denominator") > 0, 100.0 * F.col(f"mrd_cells_{m}") / F.col("denominator")).otherwise(0.0),
        )
    return out.withColumn("eln_positive", F.col("mrd_pct_eln") >= rules.clinical_positivity_pct).withColumn(
        "eln_low_level", (F.col("mrd_cells_eln") > 0) & ~F.col("eln_positive")
    )


def mrd_nodes(events: DataFrame, rules: MrdRules = MrdRules(), by: Sequence[str] = ("patient_id",), **kw) -> DataFrame:
    return flag_nodes(node_shares(node_counts(events, by, rules=rules, **kw), by), rules)


def mrd_summary(events: DataFrame, rules: MrdRules = MrdRules(), by: Sequence[str] = ("patient_id",), **kw) -> DataFrame:
    return summarize(mrd_nodes(events, rules, by, **kw), by, rules)


def counted_summary(counts: DataFrame, rules: MrdRules = MrdRules(), by: Sequence[str] = ("patient_id",)) -> DataFrame:
    """:func:`mrd_summary` from node counts."""
    return summarize(flag_nodes(node_shares(counts, by), rules), by, rules)


def flagged_view(nodes: DataFrame, method: str, by: Sequence[str] = ("patient_id",)) -> DataFrame:
    """Flagged nodes of one method, ranked by their patient share."""
    order = Window.partitionBy(*by).orderBy(F.desc("pct_patho"), "node_id")
    return (
        nodes.where(F.col(f"is_mrd_{method}"))
        .withColumn("rank", F.row_number().over(order))
        .select(*by, "node_id", "n_total", "n_patho", "pct_patho", "rank")
    )


def initial_review(nodes: DataFrame, method: str) -> DataFrame:
    """Approve the nodes the chosen method flags, reject the others."""
    flags = {
        "jf": F.col("is_mrd_jf"),
        "flo": F.col("is_mrd_flo"),
        "eln": F.col("is_mrd_eln"),
        "both": F.col("is_mrd_jf") | F.col("is_mrd_flo"),
        "all": F.col("is_mrd_jf") | F.col("is_mrd_flo") | F.col("is_mrd_eln"),
    }
    return nodes.withColumn("review", F.when(flags[method], "KEEP").otherwise("DISCARD"))


def curated(nodes: DataFrame, decisions: DataFrame, by: Sequence[str] = ("patient_id",)) -> DataFrame:
    """Residual disease over the nodes an expert keeps; unseen nodes are kept."""
    keys = [*by, "node_id"]
    decided = nodes.join(decisions.select(*keys, "decision"), keys, "left")
    kept = F.coalesce(F.col("decision"), F.lit("KEEP")) == "KEEP"
    return decided.groupBy(*by).agg(
        F.sum(F.when(kept, F.col("n_patho")).otherwise(0)).alias("curated_cells"),
        F.max("total_patho").alias("total_patho"),
        F.count_if(kept).alias("n_kept"),
    ).withColumn("curated_pct", F.round(percent(F.col("curated_cells"), F.col("total_patho")), 6))


def phenotype_gate(
    method: str, score: Column, purity: Column, *, allowed: Sequence[str] = ("BLAST_HIGH", "BLAST_MODERATE"),
    high: float = 2.60, moderate: float = 2.20, weak: float = 2.25, override: bool = True, **threshold,
) -> Column:
    """Condition a node must meet beside its counts."""
    if method == "none":
        return F.lit(True)
    if method == "linear":
        return blast.category(score, high, moderate, weak).isin(*allowed)
    if not override:
        return score >= high
    return score >= blast.gate_threshold(purity, high=high, moderate=moderate, **threshold)


def synthesis(summary: DataFrame, samples: DataFrame, by: Sequence[str] = ("patient_id",)) -> DataFrame:
    """Cohort table: one row per patient with its metadata."""
    return samples.join(summary, list(by), "left")


def dashboard(summary: DataFrame, curated_rows: DataFrame, by: Sequence[str] = ("patient_id",)) -> DataFrame:
    """Best percentage over the rules, its rule, and the curated percentage."""
    best = F.greatest(*[F.col(f"mrd_pct_{m}") for m in METHODS])
    name = F.coalesce(*[F.when(F.col(f"mrd_pct_{m}") == best, m) for m in METHODS])
    return (
        summary.join(curated_rows.select(*by, "curated_pct"), list(by), "left")
        .withColumn("best_pct", best)
        .withColumn("best_method", name)
    )
