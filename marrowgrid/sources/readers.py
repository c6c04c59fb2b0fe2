"""CSV readers and the normal-marrow pool."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marrowgrid.operators.sizing import model_rows
from marrowgrid.sources.sinks import ROWS_PER_FILE


def read_events_csv(spark: SparkSession, path: str, schema: "StructType | str") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_spillover_csv(spark: SparkSession, path: str) -> tuple[list[str], list[list[float]]]:
    """Detector names and the (model-sized) matrix of a spillover file."""
    rows = spark.read.csv(path, header=True).toArrow()
    names = [n for n in rows.column_names if n not in ("", "_c0")]
    return names, [[float(rows.column(n)[i].as_py()) for n in names] for i in range(rows.num_rows)]


def read_reference_csv(
    spark: SparkSession, path: str, markers: Sequence[str], transform: Callable[[Column], Column] | None = None, encoding: str | None = None,
) -> DataFrame:
    """Cells of reference populations: ``;`` separated, decimal comma.

    Rows with a missing marker are dropped; ``population`` is the file name.  Without an ``encoding`` each file is
    UTF-8 if all of it is, else Latin-1.
    """
    if encoding is None:
        lines = spark.read.text(path).select(F.input_file_name().alias("file"), (~F.is_valid_utf8("value")).alias("odd"))
        found = lines.groupBy("file").agg(F.max("odd").alias("odd"))
        kinds: dict[str, list[str]] = {}
        for r in model_rows(found):
            kinds.setdefault("ISO-8859-1" if r["odd"] else "UTF-8", []).append(r["file"])
        if len(kinds) > 1:
            parts = [_reference_cells(spark, files, markers, kind) for kind, files in sorted(kinds.items())]
            out = parts[0].unionByName(parts[1])
        else:
            out = _reference_cells(spark, path, markers, next(iter(kinds), "UTF-8"))
    else:
        out = _reference_cells(spark, path, markers, encoding)
    return out if transform is None else out.withColumns({m: transform(F.col(m)) for m in markers})


def _reference_cells(spark: SparkSession, path: str | list[str], markers: Sequence[str], encoding: str) -> DataFrame:
    raw = spark.read.option("encoding", encoding).csv(path, header=True, sep=";")
    clean = {c: c.lstrip("\ufeff").strip() for c in raw.columns}
    raw = raw.withColumnsRenamed({k: v for k, v in clean.items() if k != v})
    numbers = [F.regexp_replace(F.col(f"`{m}`"), ",", ".").try_cast("double").alias(m) for m in markers]
    name = F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1), r"\.csv$", "")
    has = ["population"] if "population" in raw.columns else []
    return raw.select(*([F.col("population")] if has else [name.alias("population")]), *numbers).na.drop(subset=list(markers))


def reference_means(cells: DataFrame, markers: Sequence[str]) -> DataFrame:
    return cells.groupBy("population").agg(F.count("*").alias("n_cells"), *[F.avg(m).alias(m) for m in markers])


def file_listing(spark: SparkSession, folder: str, glob: str = "*.[fF][cC][sS]") -> DataFrame:
    """(path, length, modificationTime) of files, without their content."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return found.select("path", "length", "modificationTime")


def code_version() -> str:
    """Hash of the modules that decide what a preprocessed pool holds."""
    from marrowgrid.functions import gates, transforms
    from marrowgrid.operators import gating, normalize
    from marrowgrid.sources import fcs

    text = "".join(inspect.getsource(m) for m in (fcs, gates, transforms, gating, normalize))
    return hashlib.sha256(text.encode()).hexdigest()


def pool_version(
    files: DataFrame, config: Mapping, keys: Sequence[str] = ("path", "length", "modificationTime"), code: str | None = None,
) -> str:
    """Hash of the files (see :func:`file_listing`), the settings and the code a pool was built with.

    A file that was acquired again changes its size or time, hence the version.
    """
    listing = files.select(F.sha2(F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys])), 256).alias("h")).distinct()
    # a sum of hash prefixes does not depend on the order of the files
    row = listing.agg(F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
    spark = files.sparkSession
    text = f"{code or code_version()}|{row['s']}|{row['n']}|{json.dumps(dict(config), sort_keys=True)}"
    return spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0]


def save_pool(pool: DataFrame, path: str, version: str, sample: str = "file_origin", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write the pool below its version, in the order of its samples.

    A file holds a range of samples, or a part of a large one, so there are as many files as the rows need; the
    statistics of the files tell a reader of one sample which of them to open.
    """
    target = f"{path.rstrip('/')}/pool_version={version}"
    others = [c for c in pool.columns if c != sample]
    files = max(pool.sparkSession.sparkContext.defaultParallelism, -(-pool.count() // rows_per_file))
    placed = pool.repartitionByRange(files, F.col(sample), F.xxhash64(*others)).sortWithinPartitions(sample)
    placed.write.mode("overwrite").parquet(target)


def load_pool(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    """The pool of a version, None when it was not built."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{path.rstrip('/')}/pool_version={version}")
    except AnalysisException:
        return None
