"""Writers: tables, per-file and per-cluster exports, logs."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marrowgrid.functions.numeric import finite_or
from marrowgrid.operators.sizing import as_model

# Replacements in exported numbers.
NAN_VALUE, POS_INF_VALUE, NEG_INF_VALUE = 0.0, 1e6, 0.0

#: rows of one exported file
ROWS_PER_FILE = 5_000_000


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "errorifexists", **options) -> None:
    """All or chosen columns as CSV files with a header."""
    (df.select(*columns) if columns else df).write.mode(mode).options(**options).csv(path, header=True)


def sliced(df: DataFrame, key: str, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Shuffle by key for writing; a key of many rows is cut into hash slices."""
    sizes = as_model(df.groupBy(key).agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("_slices")))
    others = [c for c in df.columns if c != key]
    slice_ = F.pmod(F.xxhash64(*others), F.col("_slices"))
    return df.join(sizes, key).repartition(F.col(key), slice_).select(*df.columns)


def write_per_key(df: DataFrame, path: str, key: str, fmt: str = "csv", rows_per_file: int = ROWS_PER_FILE) -> None:
    """One folder per key, with as many files as its rows need."""
    placed = sliced(df, key, rows_per_file)
    options = {"maxRecordsPerFile": str(rows_per_file)} | ({"header": "true"} if fmt == "csv" else {})
    placed.write.partitionBy(key).format(fmt).options(**options).save(path)


def write_tables(tables: Mapping[str, DataFrame], root: str) -> dict[str, str]:
    """Named tables as Parquet and CSV below one folder."""
    paths = {}
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}.parquet")
        df.write.csv(f"{root}/{name}.csv", header=True)
        paths[name] = f"{root}/{name}.parquet"
    return paths


def append_log(log: DataFrame, path: str, run_id: str) -> None:
    """Log or metadata rows of one run as JSON lines, in a folder of the run; a repeated run replaces its own rows."""
    log.write.mode("overwrite").json(f"{path}/run_id={run_id}")


def write_payload(spark: SparkSession, payload: Mapping, path: str) -> None:
    """A small document as one JSON file in a folder; values that JSON lacks become text."""
    text = json.dumps(dict(payload), default=str, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def analysis_metadata(
    events: DataFrame, *, sample: str, condition: str, metacluster: str, n_metaclusters: int, markers: Sequence[str], used: Sequence[str],
    config: Mapping | None = None, export_files: Mapping[str, str] | None = None, version: str = "1",
) -> DataFrame:
    """One row that describes an analysis: inputs, settings, cells per condition, file and metacluster.

    One pass counts the combinations, everything else follows from these counts; a metacluster without cells counts 0.
    Write it with ``df.write.json``.
    """
    counts = events.groupBy(condition, sample, metacluster).agg(F.count("*").alias("n"))
    parts = [counts.groupBy(F.col(c).cast("string").alias("name")).agg(F.sum("n").alias("n")).withColumn("section", F.lit(kind))
             for kind, c in (("condition", condition), ("file", sample), ("metacluster", metacluster))]
    empty = events.sparkSession.range(n_metaclusters).select(F.col("id").cast("string").alias("name"), F.lit(0).cast("long").alias("n"), F.lit("metacluster").alias("section"))
    told = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(empty).groupBy("section", "name").agg(F.sum("n").alias("n")).where("name IS NOT NULL")

    def entries(kind: str, value: Column) -> Column:
        # nulls are left out of a list
        return F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("section") == kind, F.struct("name", value.alias("n"))))))

    total = F.sum(F.when(F.col("section") == "metacluster", F.col("n")))
    text = lambda m: F.create_map(*[F.lit(str(x)) for kv in m.items() for x in kv]) if m else F.create_map().cast("map<string,string>")
    names = lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    one = told.agg(entries("condition", F.col("n")).alias("c"), entries("file", F.col("n")).alias("f"), entries("metacluster", F.col("n")).alias("m"), total.alias("t"))
    share = F.transform_values("m", lambda _, n: F.struct(n.alias("n_cells"), F.round(100.0 * n / F.greatest("t", F.lit(1)), 3).alias("pct_total")))
    return one.select(
        F.struct(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("date"), F.lit(version).alias("pipeline_version")).alias("analysis_info"),
        F.struct(F.size("f").alias("total_files"), F.map_keys("f").alias("files")).alias("input_files"), text(config or {}).alias("configuration"),
        F.struct(F.coalesce("t", F.lit(0)).alias("total_cells"), names(markers).alias("all_markers"), names(used).alias("markers_used_for_clustering"),
                 F.lit(len(used)).alias("n_markers_used"), F.col("c").alias("cells_per_condition"), F.col("f").alias("cells_per_file")).alias("data_summary"),
        share.alias("metacluster_summary"), text(export_files or {}).alias("export_files"))


def sanitized(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns as finite floats; others only when named in ``keep``."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in
               ("double", "float", "integer", "long", "short", "byte") and f.name not in keep]
    made = [finite_or(n, NAN_VALUE, POS_INF_VALUE, NEG_INF_VALUE).cast("float").alias(n) for n in numeric]
    return df.select(*keep, *made)


def cluster_export(df: DataFrame, path: str, cluster: str, min_cells: int = 10, noise: int = -1) -> DataFrame:
    """One folder per cluster large enough; the report says what was written."""
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n_cells"))
    status = (
        F.when(F.col(cluster) == noise, "noise")
        .when(F.col("n_cells") < min_cells, "too_small").otherwise("exported"))
    report = as_model(sizes.withColumn("status", status))
    chosen = df.join(report.where("status = 'exported'").select(cluster), cluster, "left_semi")
    write_per_key(chosen, path, cluster, "parquet")
    return report
