"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marrowgrid.session import staged

#: bytes of text that a task works on at once
SLICE_BYTES = 4_000_000

#: character classes: lower, upper, digit, blank, line end, sentence mark, bracket or quote, hyphen or slash,
#: symbol, control, non-ASCII; 11 marks the later bytes of a character, which are not counted
CLASSES = 11
_CLASS = bytearray([9] * 128 + [11] * 64 + [10] * 64)
for _code, _chars in enumerate((
        "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\v\f", ".,;:!?",
        "()[]{}\"'`", "-_/\\", "#*$%&|<>=+~^@")):
    for _char in _chars:
        _CLASS[ord(_char)] = _code
CLASS_TABLE = bytes(_CLASS)

_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """``crc32(doc_id as text) mod divisor``, the contract's split of rows."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


def sample_share(key: str | Column, salt: int) -> Column:
    """A number in [0, 1) that depends on the key alone, for samples that repeat."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that the texts of a slice have about ``limit`` bytes (one text at least)."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0)).astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def byte_blocks(data: bytes, limit: int = 1 << 20) -> Iterator[bytes]:
    """Cut at ASCII white space, so that no word is cut and no block is much longer than ``limit``."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + limit)
        if end < n:
            found = _BLANK.search(data, end)
            end = found.end() if found else n
        yield data[at:end]
        at = end


def class_counts(data: bytes) -> np.ndarray:
    """Code points of each character class in UTF-8 text."""
    return np.bincount(np.frombuffer(data.translate(CLASS_TABLE), np.uint8), minlength=CLASSES + 1)[:CLASSES]


def scanned(df: DataFrame, columns: Iterable[str], fn, schema: str) -> DataFrame:
    """Run ``fn(batches)`` on Arrow batches of the given columns."""
    return df.select(*columns).mapInArrow(fn, schema)


# ---------------------------------------------------------------------------------------------------------------------
# components of a graph of links
# ---------------------------------------------------------------------------------------------------------------------

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of the links ``(a, b)``: columns ``node``, ``root``.

    Alternates the large-star and small-star rewrites, in which every node tells its neighbours its smallest
    neighbour; the rounds grow with the logarithm of the longest chain.  Minima are aggregated map-side and staged,
    so the join with a hub's links has two plain exchanges that skew handling can split.  Raises if the links still
    change after ``MAX_ROUNDS``.  Isolated nodes are not listed.
    """
    edges = staged(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "low")
        large = staged(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                       .where("a <> b").distinct(), "large")
        low = staged(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"links still change after {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
