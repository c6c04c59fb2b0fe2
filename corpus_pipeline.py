"""From raw documents to packed training sequences, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's input.  All stages but the last return the columns of ``documents``.  A stage leaves the session with Arrow batches
of ``BATCH_ROWS`` rows, since what it returns is computed after it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marrowgrid.llm import divergence_rules, near_copies, packing, quality_cotraining
from marrowgrid.llm.common import table
from marrowgrid.session import shuffles_released, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: rows that a task hands to Python at once; texts of 10 000 rows, Spark's default, take up to 64 MB there and more in the JVM
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the co-trained classifier rejects; every labelled document at hand is learnt from."""
    _small_batches(spark)
    features = quality_cotraining.with_labels(docs, table(spark, sf_dir, "labels"))
    model = quality_cotraining.fit(features)
    return docs.where(quality_cotraining.keeps(docs, model)).select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the counting and divergence rules reject, against references of the documents at hand."""
    _small_batches(spark)
    known = divergence_rules.references(docs)
    return docs.where(divergence_rules.passes(docs, known)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates (five words, Jaccard 0.8 or more).

    Repeated rows of one id are one document; of different rows the first by text and then by the other columns stays.
    Rows without id cannot be told apart and stay.
    """
    _small_batches(spark)
    docs = docs.select(*COLUMNS)
    with shuffles_released(spark):
        found = near_copies.similar_documents(docs)
        dropped = staged(found.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
        kept = near_copies.without(docs, dropped)
        repeated = staged(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
        if repeated.isEmpty():
            return kept
    first = kept.join(repeated, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
    return kept.join(repeated, "doc_id", "left_anti").unionByName(first.select("doc_id", "row.*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of the remaining documents into sequences."""
    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("quality rules", rules), ("near duplicates", near_duplicates), ("packing", pack)]

#: a trained classifier decides in the first stage, so no SQL statement gives these rows
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = staged(docs, "stage")
    return docs
