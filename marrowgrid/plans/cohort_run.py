"""End-to-end jobs: preprocessing, per-patient maps, population mapping."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrowgrid.functions import blast
from marrowgrid.functions.transforms import transform_markers
from marrowgrid.functions.vectors import vector
from marrowgrid.operators import mapping, metacluster, mrd, normalize, som, validate
from marrowgrid.operators.cohort import balanced_pool, dealt, ranked_pool
from marrowgrid.operators.gating import gating_log, standard_masks
from marrowgrid.operators.quantiles import medians
from marrowgrid.operators.selection import hash_order, smallest
from marrowgrid.operators.sizing import as_model, cached, counted, folded
from marrowgrid.session import staged


@dataclass(frozen=True)
class Settings:
    """Parameters of a run."""

    markers: tuple[str, ...]
    transform: str = "arcsinh"
    normalization: str = "zscore"
    min_cells: int = 100
    balance_ratio: float = 1.0
    xdim: int = 10
    ydim: int = 10
    epochs: int | None = None
    metaclusters: int = 8
    gates: tuple[str, ...] = ("viable", "singlets", "cd45")
    cd34_of: str | None = "Pathologique"  # condition the CD34 gate applies to, None for all events


def preprocess(events: DataFrame, settings: Settings, sample: str = "file_origin") -> tuple[DataFrame, DataFrame]:
    """Gate, drop small samples, transform and scale: (events, gating log)."""
    masks = standard_masks(events, cd34_of=settings.cd34_of)
    chosen = {n: masks[n] for n in settings.gates}
    log = gating_log(events, chosen)
    kept = events
    for condition in chosen.values():
        kept = kept.where(condition)
    kept = validate.drop_or_fill(kept, settings.markers)
    kept = validate.large_samples(kept, sample, settings.min_cells)
    moved = transform_markers(kept, settings.markers, settings.transform)
    return normalize.normalize(moved, settings.markers, settings.normalization), log


def cluster(
    events: DataFrame, settings: Settings, key: Sequence[str] = ("event_id",), model: str | None = None, ks: Sequence[int] | None = None,
) -> tuple[DataFrame, som.SomModel]:
    """Train the map(s), metacluster the codebooks, label the events.

    ``ks`` chooses the number of metaclusters for a single map.
    """
    data = staged(events.withColumn("x", vector(settings.markers)), "vectors")
    fitted = fit(data, settings, key, model, ks)
    return fitted.transform(data), fitted


def fit(
    data: DataFrame, settings: Settings, key: Sequence[str] = ("event_id",), model: str | None = None, ks: Sequence[int] | None = None,
    rows: DataFrame | None = None,
) -> som.SomModel:
    """Trained and metaclustered map(s) of vectors ``x``; ``rows`` are the events with their number as ``fit_som`` takes them."""
    fitted = som.fit_som(data, key=key, model=model, xdim=settings.xdim, ydim=settings.ydim, epochs=settings.epochs, rows=rows)
    k = settings.metaclusters
    if ks is not None and model is None:
        k, _ = metacluster.choose_k(data, fitted.codes[None], ks, key=key, xdim=settings.xdim, ydim=settings.ydim, epochs=settings.epochs)
    names = {str(m): m for m in fitted.codes}
    for row in metacluster.metacluster(fitted.codebook(data.sparkSession), k).collect():
        labels = fitted.metaclusters.setdefault(names[row["model_id"]], [0] * (settings.xdim * settings.ydim))
        labels[row["node_id"]] = row["metacluster"]
    return fitted


def patient_runs(
    events: DataFrame, settings: Settings, order: Column, *, patient: str = "patient_id", condition: str = "condition",
    rules: mrd.MrdRules = mrd.MrdRules(), ratio: float = 2.0,
) -> tuple[DataFrame, DataFrame]:
    """Every patient against the normal pool: (labelled events, summary).

    Each patient gets its own share of the pool and its own map; all maps
    train in the same jobs.  A patient is scaled by its own rows and the pool
    once by the whole pool, so no result depends on the other patients.

    Maps and summary come from equal rows with their number; pool rows are
    folded before they are dealt, by the patients that get them.  The labelled
    events are made when they are asked for.
    """
    moved = transform_markers(events, settings.markers, settings.transform)
    ill = normalize.normalize(
        moved.where(F.col(condition) == rules.patho), settings.markers, settings.normalization, "sample", patient)
    pool = normalize.normalize(moved.where(F.col(condition) == rules.sain), settings.markers, settings.normalization)
    ranked, wanted = ranked_pool(ill, pool, order, patient=patient, ratio=ratio)
    ranked, by_quota = staged(ranked.drop(patient), "pool"), Window.orderBy("quota")
    # a step is a range of ranks that the same patients get
    steps = wanted.select("quota").distinct().select(
        "quota", F.row_number().over(by_quota).cast("long").alias("_step"), (F.lag("quota", 1, 0).over(by_quota) + 1).alias("_first"))
    reached = as_model(steps.select("_step", F.explode(F.sequence("_first", "quota")).alias("_rank")))
    pooled, takers = ranked.join(reached, "_rank"), as_model(wanted.join(steps, "quota").select(patient, "_step"))
    shares = dealt(counted(pooled.select("_step", condition, *settings.markers)), takers, "_step")
    # codes start at the first rows in hash order; those of a patient's steps are among the first of each step
    first = smallest(pooled.select("event_id", "_step", *settings.markers), ["_step"], settings.xdim * settings.ydim, hash_order("event_id"), ties=["event_id"])
    start = ill.select("event_id", patient, *settings.markers).unionByName(
        dealt(first, takers, "_step").select("event_id", patient, *settings.markers)).withColumn("x", vector(settings.markers))
    own = counted(ill.select(patient, condition, *settings.markers))
    kinds = cached(own.unionByName(shares.select(*own.columns)).select(patient, condition, "_n", vector(settings.markers).alias("x")))
    try:
        fitted = fit(start, settings, model=patient, rows=kinds)
        placed = fitted.transform(kinds)
        number = lambda c: F.sum(F.when(F.col(condition) == c, F.col("_n")).otherwise(0))
        counts = as_model(placed.groupBy(patient, "node_id").agg(
            F.sum("_n").alias("n_total"), number(rules.sain).alias("n_sain"), number(rules.patho).alias("n_patho")))
    finally:
        kinds.unpersist()
    events = ill.unionByName(dealt(ranked, wanted.withColumnRenamed("quota", "_rank")).select(*ill.columns))
    return fitted.transform(events.withColumn("x", vector(settings.markers))), mrd.counted_summary(counts, rules, [patient])


TABLES = ("cells", "log", "codebook", "mfi", "counts", "conditions")


def combined_run(events: DataFrame, settings: Settings, order: Column, tables: Sequence[str] = TABLES) -> dict[str, DataFrame]:
    """Gate, scale, balance, cluster and summarise one cohort; ``tables`` are the results to return.

    The map and the counts come from equal rows with their number; the labelled cells are made when they are asked for.
    """
    ready, log = preprocess(events, settings)
    pool = balanced_pool(ready, order, ratio=settings.balance_ratio).drop("node_id", "metacluster")
    data = staged(pool.select("event_id", "condition", *settings.markers), "vectors").withColumn("x", vector(settings.markers))
    kinds = folded(data.select("condition", "x"))
    try:
        fitted = fit(data, settings, rows=kinds)
        counts = as_model(fitted.transform(kinds).groupBy("node_id", "metacluster", "condition").agg(F.sum("_n").alias("n")))
    finally:
        kinds.unpersist()
    labelled = fitted.transform(data.drop("event_id", "condition"))
    made = {
        "cells": lambda: fitted.transform(pool.withColumn("x", vector(settings.markers))),
        "log": lambda: log,
        "codebook": lambda: fitted.codebook(events.sparkSession),
        "mfi": lambda: medians(labelled, ["metacluster"], {m: m for m in settings.markers}),
        "counts": lambda: counts.groupBy("node_id").agg(F.sum("n").alias("n")),
        "conditions": lambda: counts.groupBy("metacluster", "condition").agg(F.sum("n").alias("n")),
    }
    return {name: made[name]() for name in tables}


def map_and_score(
    node_profiles: DataFrame, populations: DataFrame, sizes: DataFrame, z: dict[str, Column], wide: DataFrame, method: str = "M12",
    node: str = "node_id", keys: Sequence[str] = (),
) -> DataFrame:
    """Population of each scored node by one metric, with its phenotype score.

    ``wide`` has the columns behind ``z`` and one row per node, or several
    with further columns ``keys`` (patients that share a map).  A node without
    distances stays Unknown.
    """
    distances = mapping.all_metrics(node_profiles, populations, sizes, node=node).where(F.col("method") == method)
    mapped = mapping.assign_populations(distances, ["method"], node)
    score = blast.linear_score(z, blast.marker_weights(list(z)))
    scored = wide.select(*keys, node, score.alias("blast_score"), blast.category(score).alias("blast_category"))
    joined = scored.join(as_model(mapped.drop("method")), node, "left")
    return joined.withColumn("assigned_pop", F.coalesce("assigned_pop", F.lit(mapping.UNKNOWN)))
