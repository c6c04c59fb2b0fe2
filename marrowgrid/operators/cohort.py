"""Cohort tables: channels, samples, metadata, sampling per patient."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrowgrid.operators.selection import smallest
from marrowgrid.operators.sizing import as_model, model_rows


def common_channels(channels: DataFrame, sample: str = "sample_id", name: str = "name") -> DataFrame:
    """Channel names that every sample has."""
    samples = channels.select(sample).distinct().count()
    held = channels.select(sample, name).distinct().groupBy(name).count()
    return held.where(F.col("count") == samples).select(name)


def missing_channels(channels: DataFrame, sample: str = "sample_id", name: str = "name") -> DataFrame:
    """(sample, channel) pairs of the cohort panel a sample lacks.

    The panel (distinct names) is model-sized; each sample subtracts what it
    holds from it.
    """
    panel = sorted(r[0] for r in model_rows(channels.select(name).distinct()))
    held = channels.groupBy(sample).agg(F.collect_set(name).alias("_held"))
    absent = F.array_except(F.array(*[F.lit(n) for n in panel]), F.col("_held"))
    return held.select(sample, F.explode(absent).alias(name))


def stack(samples: Sequence[DataFrame], fill: float | None = 0.0, strict: bool = False) -> DataFrame:
    """Union by name; missing markers are filled, or an error when strict."""
    names = [set(s.columns) for s in samples]
    if strict and any(n != names[0] for n in names):
        raise ValueError("samples differ in their columns")
    out = samples[0]
    for other in samples[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out if fill is None else out.na.fill(fill)


def common_columns(samples: Sequence[DataFrame]) -> DataFrame:
    """Union over the columns all samples share."""
    shared = [c for c in samples[0].columns if all(c in s.columns for s in samples)]
    out = samples[0].select(*shared)
    for other in samples[1:]:
        out = out.unionByName(other.select(*shared))
    return out


def stack_cohort(events: DataFrame, sample: str, columns: Sequence[str], label: str = "__sample__") -> DataFrame:
    """One long table of many samples over the columns that every sample has, with the sample in ``label``.

    ``events`` is a table in which a column that a sample lacks is NULL throughout (as the readers give it).  One
    aggregation counts the values of all columns per sample, whatever the number of samples.
    """
    held = events.groupBy(sample).agg(*[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(columns)])
    least = held.agg(*[F.min(f"_n{i}").alias(f"_n{i}") for i in range(len(columns))]).first()
    shared = [c for i, c in enumerate(columns) if least[f"_n{i}"]]
    return events.select(F.col(sample).alias(label), *[F.col(f"`{c}`") for c in shared])


def with_metadata(events: DataFrame, metadata: DataFrame, key: str, batch: Sequence[str], label: str = "batch") -> DataFrame:
    """Cohort metadata onto events; batch = first non-null of ``batch``, else the key."""
    joined = events.join(as_model(metadata), key, "left")
    return joined.withColumn(label, F.coalesce(*[F.col(b).cast("string") for b in batch], F.col(key).cast("string")))


def reattach(events: DataFrame, results: DataFrame, keys: Sequence[str], fill: dict | None = None) -> DataFrame:
    """Bring labels or embeddings back by event key; absent rows stay NULL or take ``fill``."""
    joined = events.join(results, list(keys), "left")
    return joined.na.fill(fill) if fill else joined


def summarize_samples(events: DataFrame, sample: str, masks: Sequence[str], channels: Sequence[str]) -> DataFrame:
    return events.groupBy(sample).agg(
        F.count("*").alias("n_events"), F.lit(len(channels)).alias("n_channels"),
        *[F.count_if(m).alias(f"n_{m}") for m in masks])


def balanced_pool(
    events: DataFrame, order: Column, *, file: str = "file_origin", condition: str = "condition",
    patho: str = "Pathologique", ratio: float = 1.0, replace: bool = False,
) -> DataFrame:
    """All patient events and an equal quota of every normal file.

    The quota is ceil(round(n_patient * ratio) / n_files).  With replacement a
    file smaller than its quota repeats its rows until the quota is met.
    """
    is_patho = F.col(condition) == patho
    patient, normal = events.where(is_patho), events.where(~is_patho)
    # one scan counts both sides
    sides = as_model(events.groupBy(file).agg(F.count_if(is_patho).alias("_patients"), F.count_if(~is_patho).alias("_size")))
    sizes = sides.where("_size > 0").drop("_patients")
    n_files = sizes.count()
    wanted = round((sides.agg(F.sum("_patients")).first()[0] or 0) * ratio)
    quota = -(-wanted // max(n_files, 1))
    if not replace:
        return patient.unionByName(smallest(normal, [file], quota, order, sizes=sizes))
    # copy i of a row is row number rank + i * size of an endless deck; cards
    # up to the quota are dealt, so only the last, partial deal needs ranks
    full = F.floor(F.lit(quota) / F.col("_size"))
    deck = normal.join(sizes, file)
    whole = deck.where(full > 0).withColumn("_i", F.explode(F.sequence(F.lit(1), full))).select(*events.columns)
    rest = smallest(deck.withColumn("_rest", F.lit(quota) % F.col("_size")), [file], F.col("_rest"), order)
    return patient.unionByName(whole).unionByName(rest.select(*events.columns))


def pool_per_patient(
    patients: DataFrame, pool: DataFrame, order: Column, *, patient: str = "patient_id", file: str = "file_origin",
    ratio: float = 2.0, n_files: int | None = None,
) -> DataFrame:
    """Normal rows for every patient: max(1, int(ratio * n) // files) per file.

    A patient whose target int(ratio * n) reaches the size of the pool gets
    all of it.  The pool is ranked once per file up to the largest quota; a
    row goes to each patient whose quota reaches its rank.
    """
    chosen, wanted = ranked_pool(patients, pool, order, patient=patient, file=file, ratio=ratio, n_files=n_files)
    return dealt(chosen.drop(patient), wanted.withColumnRenamed("quota", "_rank"))


def ranked_pool(
    patients: DataFrame, pool: DataFrame, order: Column, *, patient: str = "patient_id", file: str = "file_origin",
    ratio: float = 2.0, n_files: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The pool up to the largest quota with ``_rank`` in the file, and the ``quota`` of every patient."""
    files = as_model(pool.groupBy(file).agg(F.count("*").alias("_size")))
    sizes = files.agg(F.sum("_size").alias("rows"), F.max("_size").alias("top"), F.count("*").alias("files")).first()
    n_files = n_files or sizes["files"]
    target = F.floor(F.count("*") * ratio)
    wanted = patients.groupBy(patient).agg(
        F.when(target >= F.lit(sizes["rows"] or 0), F.lit(sizes["top"] or 0))
        .otherwise(F.greatest(F.lit(1), F.floor(target / max(n_files, 1)))).cast("long").alias("quota")).where("quota > 0")
    wanted = as_model(wanted)
    top = wanted.agg(F.max("quota")).first()[0] or 0
    return smallest(pool, [file], top, order, rank="_rank", sizes=files), wanted


def dealt(rows: DataFrame, wanted: DataFrame, rank: str = "_rank") -> DataFrame:
    """Every row to each patient of ``wanted`` whose ``rank`` is not below the row's."""
    # patients ask for ranks 1.., an equality join deals the rows
    asked = wanted.withColumn(rank, F.explode(F.sequence(F.lit(1).cast("long"), F.col(rank))))
    return rows.join(asked, rank).drop(rank)
