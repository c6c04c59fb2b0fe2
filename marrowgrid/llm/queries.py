"""Registered queries of the corpus operators: production parameters, whole tables, full results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from marrowgrid.llm import (
    bpe_cuts, divergence_rules, grace_dedup, html_main_text, imatch, language_ppm, packing, quality_cotraining, simhash,
    source_divergence, spelling_variants, toxicity, unigram_counts)
from marrowgrid.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of rows whose id leaves 0 of five are not learnt from."""
    labels = table(spark, sf_dir, "labels").where(~quality_cotraining.held_out())
    features = quality_cotraining.with_labels(table(spark, sf_dir, "documents"), labels)
    return quality_cotraining.score(features, quality_cotraining.fit(features)) \
        .withColumn("held_out", quality_cotraining.held_out())


def op2_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ppm.identify(table(spark, sf_dir, "documents"))


def op3_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.token_counts(
        table(spark, sf_dir, "documents"), unigram_counts.sentencepiece_pieces(PIECES))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main_text.main_text(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_cuts.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_and_next(table(spark, sf_dir, "documents"))


def op9_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return divergence_rules.apply_rules(docs, divergence_rules.references(docs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_quality_cotraining, op2_language_ppm, op3_unigram_counts, op4_packing, op5_html_main_text, op6_simhash,
    op7_bpe_round_trip, op8_imatch, op9_divergence_rules, op10_toxicity, op11_grace_dedup, op12_spelling_variants, op13_source_divergence, pipeline)}

#: the others have no statement: models are trained, hashes (XXH64) and merges are not in SQL
SQL: dict[str, str] = {
    "op11_grace_dedup": grace_dedup.SQL, "op12_spelling_variants": spelling_variants.SQL,
    "op13_source_divergence": source_divergence.SQL}
