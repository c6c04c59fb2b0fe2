"""Structured Streaming: acquisition drift, scoring of arriving files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marrowgrid.operators import mrd
from marrowgrid.operators.neighbors import nearest_code


def drift(stream: DataFrame, time: str, sample: str, signal: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Event rate and central signal per tumbling window and sample.

    The median is a bounded sketch per open window: exact for a few thousand
    events, within 1e-4 of the rank beyond.
    """
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, window), sample)
        .agg(F.count("*").alias("n"), F.avg(signal).alias("mean"),
             F.percentile_approx(signal, 0.5, 10_000).alias("median"), F.min(signal).alias("low"), F.max(signal).alias("high"),
             F.stddev_samp(signal).alias("spread"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), sample, "n", "mean", "median", "low", "high", "spread"))


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available now and append closed windows.

    Windows still open wait for the next run; see :func:`run_updates` for a
    table that holds them too.
    """
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available now and store each changed window under its batch number.

    A repeated batch overwrites itself.  :func:`latest` reads the last state
    of every window, those still open included.
    """
    _by_batch(stream, lambda batch: batch, path, checkpoint, "update")


def latest(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Last stored state per key of :func:`run_updates`."""
    rest = [c for c in stored.columns if c not in keys]
    newest = F.max(F.struct("batch_id", *[c for c in rest if c != "batch_id"])).alias("_s")
    return stored.groupBy(*keys).agg(newest).select(*keys, "_s.*").drop("batch_id")


def open_files(spark: SparkSession, folder: str, schema: StructType, glob: str, per_trigger: int | None = None) -> DataFrame:
    """Stream of Parquet files arriving in a folder; ``per_trigger`` bounds the files of one micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return (reader if per_trigger is None else reader.option("maxFilesPerTrigger", per_trigger)).parquet(folder)


def _by_batch(stream: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, mode: str) -> None:
    def store(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def score_arrivals(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Score each micro-batch and store it under its batch number.

    A repeated batch overwrites itself, so a restart does not count twice.
    """
    _by_batch(stream, score, path, checkpoint, "append")


def merge_counts(stored: DataFrame, by: list[str], rules: mrd.MrdRules = mrd.MrdRules()) -> DataFrame:
    """Residual disease from node counts appended by several batches."""
    counts = stored.groupBy(*by, "node_id").agg(*[F.sum(c).alias(c) for c in ("n_total", "n_sain", "n_patho")])
    return mrd.summarize(mrd.flag_nodes(mrd.node_shares(counts, by), rules), by, rules)


#: batches after which the running counts are written out whole, so that a batch reads no more than that many increments
SNAPSHOT_EVERY = 50


def _running(spark: SparkSession, root: str, number: int, keys: list[str]) -> DataFrame:
    """Counts per key after batch ``number``: the last snapshot before it and the changes since."""
    changed = spark.read.parquet(f"{root}/counts").where(F.col("batch_id") <= number)
    taken = ((number - 1) // SNAPSHOT_EVERY) * SNAPSHOT_EVERY
    if taken > 0:
        base = spark.read.parquet(f"{root}/snapshots").where(F.col("snapshot") == taken)
        changed = changed.where(F.col("batch_id") > taken).unionByName(base.withColumn("batch_id", F.lit(taken)).select(*changed.columns))
    return latest(changed, keys)


def score_on_map(
    stream: DataFrame, codes: np.ndarray, path: str, checkpoint: str, *, by: str = "patient_id", x: str = "x", condition: str = "condition",
    labels: Sequence[int] | None = None, rules: mrd.MrdRules = mrd.MrdRules(),
) -> None:
    """Score arriving event vectors on a frozen map: nodes with running counts and flags, per patient and batch.

    Events are projected inside the stream.  Their counts per patient and node are keyed state of the stream, summed in
    each task before the shuffle, so a patient with most of the events is spread like any other.  A batch stores the
    counts that changed and the flags of every node of the patients concerned, since shares depend on all their nodes.
    A repeated batch finds the state it started from and overwrites its own rows, so nothing counts twice.
    :func:`scored_nodes` reads the last state.
    """
    spark, root = stream.sparkSession, path.rstrip("/")
    placed = nearest_code(stream, codes, labels, x=x, distance=None, keep=[by, condition])
    counts = mrd.node_counts(placed, by=[by])

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/counts/batch_id={number}")
        known = _running(spark, root, number, [by, "node_id"])
        if number and number % SNAPSHOT_EVERY == 0:
            known.write.mode("overwrite").parquet(f"{root}/snapshots/snapshot={number}")
        concerned = spark.read.parquet(f"{root}/counts/batch_id={number}").select(by).distinct()
        flagged = mrd.flag_nodes(mrd.node_shares(known.join(concerned, by, "left_semi"), [by]), rules)
        flagged.write.mode("overwrite").parquet(f"{root}/nodes/batch_id={number}")

    writer = counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def scored_nodes(spark: SparkSession, path: str, by: str = "patient_id") -> DataFrame:
    """Last flags and counts of every node of every patient, as stored by :func:`score_on_map`."""
    stored = spark.read.parquet(f"{path.rstrip('/')}/nodes")
    # a patient's nodes are stored together, so all come from the patient's last batch
    last = stored.groupBy(by).agg(F.max("batch_id").alias("batch_id"))
    return stored.join(last, [by, "batch_id"]).drop("batch_id")
