"""Cytometry views over the star-schema tables, one row per acquired event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKERS = ["FSC_A", "FSC_H", "SSC_A", "CD45", "CD34", "HLA_DR"]
FLUORESCENCE = ["CD45", "CD34", "HLA_DR"]

HEALTHY = "Sain"
PATIENT = "Pathologique"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all files with markers, condition and node labels."""
    item = table(spark, sf_dir, "lineitem")
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    node = F.col("l_partkey") % 110
    return item.select(
        F.md5(F.concat_ws(
            "|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            F.round(price * 100).cast("long"), F.date_format("l_shipdate", "yyyyMMdd"),
        )).alias("event_id"),
        F.concat(F.lit("F"), F.col("l_suppkey")).alias("file_origin"),
        (F.col("l_suppkey") % 10).alias("patient_id"),
        F.when(F.round(discount * 100).cast("int") >= F.col("l_partkey") % 11, PATIENT)
        .otherwise(HEALTHY).alias("condition"),
        node.alias("node_id"),
        (node % 10).alias("metacluster"),
        price.alias("FSC_A"),
        (price * (1 - discount)).alias("FSC_H"),
        F.col("l_quantity").alias("SSC_A"),
        (discount * 100).alias("CD45"),
        (F.col("l_tax") * 100).alias("CD34"),
        (price / F.col("l_quantity")).alias("HLA_DR"),
    )


def acquisition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an acquisition time: sample, time (seconds), one channel."""
    raw = table(spark, sf_dir, "events")
    return raw.select(
        "event_id",
        F.col("event_type").alias("sample_id"),
        "user_id",
        "ts",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"),
        F.col("value").alias("signal"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker vectors with a known population label."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").alias("population")
    )
