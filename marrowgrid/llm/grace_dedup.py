"""Exact duplicates by Grace hashing: records are dealt to buckets until each fits one open-addressing table.

Every task first folds its own rows: an open-addressing table over a few megabytes of whole texts leaves one record
per distinct text, which carries the ids of its rows.  The records are then dealt by the hash of their text.  Which
buckets are too large is known before any text moves, from the sizes of the records alone: a bucket beyond
``BUCKET_BYTES`` is split by further digits of the hash, and what is still too large is split again.  So texts go once
into Spark's shuffle files, straight to the bucket they end in.  There the complete contents are compared; equal
hashes alone never make two texts equal.

A text whose records alone are too large (copies by the million) cannot be split by its hash.  Its records are cut
into several buckets, each of which leaves one representative, and the representatives go through the same steps
again.  Ids wait in a table until their representative is settled, so no task ever holds all ids of a group.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrowgrid.llm.common import slices
from marrowgrid.operators.sizing import as_model
from marrowgrid.session import staged

#: bytes of records (texts and ids) that one table takes
BUCKET_BYTES = 16_000_000
#: bytes of text and number of rows that a task folds at once
FOLD_BYTES, FOLD_ROWS = 32_000_000, 200_000
#: buckets of a bucket that is split
FAN = 16
#: splits after which a bucket that is still too large is an error; two hashes meet in all of them by chance of 16^-20
MAX_SPLITS = 20
_EDGE = re.compile(rb"[\x20\x09-\x0D]")


def normalised(data: bytes) -> bytes:
    """Each run of ASCII white space becomes one space; runs at the ends stay (as one space)."""
    words = data.split()
    if not words:
        return b" " if data else b""
    before = b" " if _EDGE.match(data[:1]) else b""
    after = b" " if _EDGE.match(data[-1:]) else b""
    return before + b" ".join(words) + after


def classes(hashes: np.ndarray, data: list[bytes]) -> np.ndarray:
    """Position of the first row with the same complete content, for each row.

    An open-addressing table with linear probing, filled for all rows at once: in a round each waiting row looks at one
    slot; the first of those that meet an empty slot takes it, a row that meets equal content is done, and the others
    go on to the next slot.  Equal hashes and lengths are a reason to compare the contents, never the answer.
    """
    n = len(data)
    size = 1 << max(4, (2 * n).bit_length())
    table = np.full(size, -1, np.int64)
    lengths = np.fromiter(map(len, data), np.int64, n)
    first = np.arange(n)
    waiting = np.arange(n)
    slot = (hashes & np.uint64(size - 1)).astype(np.int64)
    while len(waiting):
        empty = table[slot] < 0
        # of the rows at one empty slot the lowest is written last
        table[slot[empty][::-1]] = waiting[empty][::-1]
        owner = table[slot]
        done = owner == waiting
        alike = np.nonzero(~done & (hashes[owner] == hashes[waiting]) & (lengths[owner] == lengths[waiting]))[0]
        for k in alike:
            if data[waiting[k]] == data[owner[k]]:
                first[waiting[k]] = owner[k]
                done[k] = True
        waiting, slot = waiting[~done], (slot[~done] + 1) & (size - 1)
    return first


def _hashes(data: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(d) for d in data), np.uint64, len(data))


_RECORD = "h long, part long, tag long, least long, n long, ids array<long>, size long"


def _folded(batches, whole: bool):
    """Records of a task's rows; without ``whole`` their sizes only."""
    part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

    def flush(ids: list, data: list[bytes], number: int) -> pa.RecordBatch:
        hashes = _hashes(data)
        first = classes(hashes, data)
        order = np.argsort(first, kind="stable")
        owners, starts = np.unique(first[order], return_index=True)
        groups = [[ids[i] for i in g] for g in np.split(order, starts[1:])]
        named = [[i for i in g if i is not None] for g in groups]
        lengths = np.array([len(data[i]) for i in owners]) + 8 * np.array([len(g) for g in groups])
        out = {
            "h": hashes[owners].view(np.int64), "part": part + number + np.arange(len(owners)),
            "tag": pa.nulls(len(owners), pa.int64()), "least": pa.array([min(g, default=None) for g in named], pa.int64()),
            "n": np.array([len(g) for g in groups], np.int64), "ids": pa.array(groups, pa.list_(pa.int64())),
            "size": lengths}
        if whole:
            out["data"] = pa.array([data[i] for i in owners], pa.binary())
        else:
            out["ids"] = pa.nulls(len(owners), pa.list_(pa.int64()))
        return pa.RecordBatch.from_pydict(out)

    ids, data, held, number = [], [], 0, 0
    for batch in batches:
        for piece in slices(batch):
            texts = [normalised(t) if t else b"" for t in piece["text"].to_pylist()]
            ids += piece["doc_id"].to_pylist()
            data += texts
            held += sum(map(len, texts))
            if held > FOLD_BYTES or len(data) > FOLD_ROWS:
                made = flush(ids, data, number)
                number += made.num_rows
                yield made
                ids, data, held = [], [], 0
    if data:
        yield flush(ids, data, number)


def fold(docs: DataFrame, whole: bool = True) -> DataFrame:
    """One record per distinct text of a few megabytes of rows."""
    given = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(lambda b: _folded(b, whole), _RECORD + (", data binary" if whole else ""))


def _placed(sizes: DataFrame, bucket_bytes: int, slots: int) -> list[DataFrame]:
    """How to deal: hashes that are cut (``h, cuts``), then for each level the buckets that are split (``path``).

    ``sizes`` holds hash and size of each record.
    """
    heavy = as_model(
        sizes.groupBy("h").agg(F.sum("size").alias("size"), F.count("*").alias("records"))
        .select("h", F.least(F.ceil(F.col("size") / bucket_bytes), F.floor(F.col("records") / 2)).alias("cuts")).where("cuts > 1"))
    light = sizes.join(heavy, "h", "left_anti")
    total = light.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(slots, 2 * total // bucket_bytes)
    light = light.withColumn("path", F.pmod("h", F.lit(buckets)))
    levels = []
    for level in range(1, MAX_SPLITS + 1):
        # one hash is never split here: copies beyond the bound are cut above, the rest is one very long text or two
        over = as_model(light.groupBy("path").agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high"))
                        .where((F.col("size") > bucket_bytes) & (F.col("low") < F.col("high"))).select("path"))
        if over.isEmpty():
            return [heavy, F.pmod("h", F.lit(buckets)), levels]
        levels.append(over)
        light = light.join(over, "path", "left_semi").withColumn("path", _below(level))
    raise RuntimeError(f"buckets still too large after {MAX_SPLITS} splits")


def _below(level: int):
    """Path of a bucket's part at the next level; levels have ranges of their own."""
    return F.xxhash64("path", F.lit(level), F.pmod(F.xxhash64("h", F.lit(level)), F.lit(FAN)))


def _dealt(records: DataFrame, plan: list, slots: int) -> DataFrame:
    """Records with ``path``, ``level`` and ``cut`` of their bucket; ``cut`` is null where a hash is not cut."""
    heavy, first, levels = plan
    rows = records.join(heavy, "h", "left") \
        .withColumn("cut", F.when(F.col("cuts") > 1, F.pmod(F.xxhash64("part"), F.col("cuts")))) \
        .withColumn("level", F.lit(0)).withColumn("path", F.when(F.col("cut").isNull(), first).otherwise(F.col("h")))
    for number, over in enumerate(levels, 1):
        rows = rows.join(over.select("path", F.lit(number - 1).alias("level"), F.lit(True).alias("split")), ["path", "level"], "left") \
            .withColumn("path", F.when(F.col("split") & F.col("cut").isNull(), _below(number)).otherwise(F.col("path"))) \
            .withColumn("level", F.when(F.col("split") & F.col("cut").isNull(), F.lit(number)).otherwise(F.col("level"))).drop("split")
    return rows


def _table(table: pa.Table) -> pa.Table:
    """One bucket: settles its records or, where a hash is cut, puts them under a representative."""
    data = table["data"].to_pylist()
    hashes = table["h"].to_numpy().view(np.uint64)
    cut = table["cut"][0].as_py()
    first = classes(hashes, data)
    owners, member = np.unique(first, return_inverse=True)
    least = np.full(len(owners), np.iinfo(np.int64).max)
    given = table["least"].to_pylist()
    known = np.array([x is not None for x in given], bool)
    np.minimum.at(least, member[known], np.array([x for x in given if x is not None], np.int64))
    some = np.isin(np.arange(len(owners)), member[known])
    count = np.zeros(len(owners), np.int64)
    np.add.at(count, member, table["n"].to_numpy())
    keep = pa.array(least[member], pa.int64(), mask=~some[member])
    out = {"h": table["h"], "ids": table["ids"], "tag": table["tag"], "keep_id": keep, "group_size": pa.array(count[member])}
    n = table.num_rows
    if cut is None:
        digest = [hashlib.sha256(data[i]).hexdigest() for i in owners]
        out |= {"under": pa.nulls(n, pa.int64()), "sha": pa.array([digest[m] for m in member], pa.string()),
                "data": pa.nulls(n, pa.binary())}
    else:
        # distinct contents of one 64-bit hash: one but for collisions
        under = (cut << 16) + np.arange(len(owners))
        stands = np.zeros(n, bool)
        stands[owners] = True
        out |= {"under": pa.array(under[member]), "sha": pa.nulls(n, pa.string()),
                "data": pa.array([d if s else None for d, s in zip(data, stands)], pa.binary())}
    return pa.table(out)


_SETTLED = "h long, ids array<long>, tag long, keep_id long, group_size long, under long, sha string, data binary"


def _settled(records: DataFrame, sizes: DataFrame, bucket_bytes: int, slots: int) -> DataFrame:
    """``h, tag, ids, keep_id, group_size, sha`` of every record."""
    plan = _placed(sizes, bucket_bytes, slots)
    found = _dealt(records, plan, slots).select("h", "tag", "least", "n", "ids", "data", "path", "level", "cut") \
        .groupBy("path", "level", "cut").applyInArrow(_table, _SETTLED)
    columns = ["h", "tag", "ids", "keep_id", "group_size", "sha"]
    if plan[0].isEmpty():
        return found.select(*columns)
    found = staged(found, "buckets")
    done = found.where("under IS NULL").select(*columns)
    left = found.where("data IS NOT NULL").select(
        "h", F.col("under").alias("part"), F.col("under").alias("tag"), F.col("keep_id").alias("least"),
        F.col("group_size").alias("n"), F.lit(None).cast("array<long>").alias("ids"), F.length("data").cast("long").alias("size"), "data")
    above = _settled(left, left.select("h", "size"), bucket_bytes, slots).select(
        "h", F.col("tag").alias("under"), "keep_id", "group_size", "sha")
    held = found.where("under IS NOT NULL").select("h", "tag", "ids", "under").join(above, ["h", "under"])
    return done.unionByName(held.select(*columns))


def deduplicate(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row.

    Texts are equal if they are identical once each run of ASCII white space is one space; null is empty.  ``keep_id``
    is the smallest id of equal texts and ``kept`` tells whether the row has it.  Repeated rows count as rows of their
    group and share one verdict.  A row without id is kept only if its whole group has no id (``keep_id`` null, nothing
    tells its rows apart).  Extra columns are ignored, an empty table gives no rows, and texts of any length are
    compared whole (one that exceeds ``bucket_bytes`` has a bucket of its own).
    """
    slots = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = staged(fold(docs, False).select("h", "size"), "sizes")
    found = _settled(fold(docs), sizes, bucket_bytes, slots)
    return found.select(F.explode("ids").alias("doc_id"), "keep_id", "group_size", "sha").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"))


#: The contract's rows in SQL.
SQL = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents),
told AS (
  SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, sha256(text) AS text_sha256
  FROM texts WINDOW w AS (PARTITION BY text))
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id IS NULL) AS kept, text_sha256 FROM told
"""
