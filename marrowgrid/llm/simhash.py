"""Near duplicates by SimHash: fingerprints of shingles, exact radius search in tiles, classes of linked documents.

The radius search compares distinct fingerprints tile against tile with numpy exclusive-or and bit counts.  A tile
holds fingerprints that agree on two of six groups of bits: fingerprints at most four bits apart agree on at least
two whole groups, so looking at all fifteen pairs of groups misses no link (for another radius r, groups = r + 2).
A crowded tile key is cut by population count and hash into tiles of bounded size; pairs of its tiles whose population
counts differ beyond the radius are skipped, all others are compared.  A task emits no pairs, but for every
fingerprint the smallest one it is joined to inside the tiles at hand, which keeps the components.

Scale: equal fingerprints are merged first, so a group of copies is one row.  Fifteen rows of 16 bytes are shuffled
per distinct fingerprint, not texts.  Components are found by rewriting links in Spark.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrowgrid.llm.common import byte_blocks, components, slices, utf8
from marrowgrid.session import staged

WIDTH = 4
RADIUS = 4
#: fingerprints of one tile
TILE = 2048


def shingle_hashes(data: bytes, width: int = WIDTH):
    """Blocks of XXH64 (seed 42) of the word shingles of lower-cased text, repeats included."""
    digest, carry, any_ = xxhash.xxh64_intdigest, [], False
    for block in byte_blocks(data.lower()):
        words = carry + block.split()
        if len(words) < width:
            carry = words
            continue
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        yield np.array([digest(joined[a:b - 1], 42) for a, b in zip(starts, ends[width - 1:])], np.uint64)
        any_, carry = True, words[len(words) - width + 1:]
    if not any_ and carry:
        yield np.array([digest(b" ".join(carry), 42)], np.uint64)


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set, bit 0 last."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def fingerprint(data: bytes, width: int = WIDTH) -> int:
    """A bit is 1 where more than half of the shingle hashes have it; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(data, width):
        ones += _bit_sums(hashes).sum(0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id`` and the 64-bit fingerprint ``fp`` (as a signed long) of every whole text; null is like empty."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = np.array([fingerprint(utf8(t), width) for t in part["text"].to_pylist()], np.uint64)
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "fp": found.view(np.int64)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _groups(radius: int) -> list[tuple[int, int]]:
    """Start and width of ``radius + 2`` groups of bits."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _band_keys(fp: Column, radius: int) -> Column:
    """One key for every pair of bit groups."""
    groups, keys = _groups(radius), []
    for number, (first, second) in enumerate(combinations(groups, 2)):
        key = F.lit(number).cast("long")
        for start, width in (first, second):
            key = F.shiftleft(key, width).bitwiseOR(
                F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return F.array(*keys)


def local_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star-shaped links with the components that the links between (and not within) ``a`` and ``b`` have.

    With ``a is b``: the links within ``a``.
    """
    same = a is b
    rows, cols = [], []
    step = max(1, (1 << 21) // max(1, len(b)))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at:at + step, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        rows.append(i + at)
        cols.append(j)
    i, j = np.concatenate(rows), np.concatenate(cols)
    if same:
        i, j = i[i < j], j[i < j]
    values, owner = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = owner[:len(a)][i], owner[len(a):][j]
    label = np.arange(len(values))
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.nonzero(label != np.arange(len(values)))[0]
    return values[moved], values[label[moved]]


def _small_groups(sets: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within many short lists at once, by comparing each member with the next, the one after it and so on."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    a, b = [], []
    for shift in range(1, sizes.max()):
        near = (owner[shift:] == owner[:-shift]) & (np.bitwise_count(flat[shift:] ^ flat[:-shift]) <= radius)
        a.append(flat[shift:][near])
        b.append(flat[:-shift][near])
    return np.concatenate(a), np.concatenate(b)


def _link_batch(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": a.view(np.int64), "b": b.view(np.int64)})


def _within(radius: int):
    def run(batches):
        for batch in batches:
            sets = [np.asarray(x, np.int64).view(np.uint64) for x in batch["members"].to_numpy(zero_copy_only=False)]
            few = [s for s in sets if 2 <= len(s) <= 32]
            if few:
                yield _link_batch(*_small_groups(few, radius))
            for s in sets:
                if len(s) > 32:
                    yield _link_batch(*local_links(s, s, radius))

    return run


def _between(radius: int):
    def run(batches):
        for batch in batches:
            for a, b in zip(batch["members"].to_numpy(zero_copy_only=False), batch["others"].to_numpy(zero_copy_only=False)):
                yield _link_batch(*local_links(np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64), radius))

    return run


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that give the components of all fingerprints ``fp`` at most ``radius`` bits apart."""
    rows = distinct.select("fp", F.explode(_band_keys(F.col("fp"), radius)).alias("key"))
    counts = staged(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "band_counts")
    # staged, so that rows of a crowded key are dealt by tile below and not by key
    met = staged(rows.join(counts, "key"), "bands")
    small = met.where(F.col("n") <= tile).groupBy("key").agg(F.collect_list("fp").alias("members"))
    found = small.select("members").mapInArrow(_within(radius), "a long, b long")
    hot = met.where(F.col("n") > tile)
    if hot.isEmpty():
        return found
    # a crowded key: tiles by population count, and by hash where one count has too many
    crowded = hot.select("key", "fp", F.bit_count("fp").alias("ones"))
    levels = staged(crowded.groupBy("key", "ones").agg(F.ceil(F.count("*") / tile).alias("cuts")), "hot_levels")
    dealt = staged(crowded.join(levels, ["key", "ones"]).withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts"))), "dealt")
    tiles = staged(dealt.groupBy("key", "ones", "cut").agg(F.collect_list("fp").alias("members")), "tiles")
    # the second side is dealt over salts, so one key's pairs are compared in many tasks
    spread = levels.groupBy("key").agg(F.ceil(F.sum("cuts") / 8).alias("salts"))
    marked = tiles.join(spread, "key")
    left = marked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    right = marked.select(
        "key", F.col("ones").alias("ones2"), F.col("cut").alias("cut2"), F.col("members").alias("others"),
        F.pmod(F.xxhash64("ones", "cut"), F.col("salts")).alias("salt"))
    pairs = left.join(right, ["key", "salt"]).where(
        (F.col("ones2") - F.col("ones") <= radius)
        & ((F.col("ones2") > F.col("ones")) | ((F.col("ones2") == F.col("ones")) & (F.col("cut2") > F.col("cut")))))
    return found.unionByName(
        tiles.select("members").mapInArrow(_within(radius), "a long, b long")).unionByName(
        pairs.select("members", "others").mapInArrow(_between(radius), "a long, b long"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` bits.  Documents without words (or
    with null text) have fingerprint zero and are linked like any other; equal texts always share a component.
    Repeated rows come back as often as given; an empty table gives no rows.
    """
    marked = staged(fingerprints(docs), "fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    found = components(links(distinct.select("fp"), radius, tile))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    classes = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n")), "classes")
    # only classes of several documents need to meet the documents again
    merged = staged(
        rooted.select("fp", "root").join(classes.where("n > 1"), "root").select("fp", "component_id"), "merged")
    return marked.join(merged, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"))


# ---------------------------------------------------------------------------------------------------------------------
# wide fingerprints, for near copies that are confirmed by the shingles themselves
# ---------------------------------------------------------------------------------------------------------------------

#: sets with likeness 0.8 differ in a bit with probability 0.15 (0.19 for sets of four and five): in 12 of 64 bits and
#: 48 of 256 at most on average; both radii lie three deviations or more beyond, unlike sets are 128 of 256 apart
SIMILAR_RADIUS = 22
WIDE_RADIUS = 72
#: odd factors that make further words of a hash
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

def sketch(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, and a fingerprint of four words whose first is that of ``fingerprint``.

    A text shorter than a shingle has one hash, an empty one none.
    """
    found, ones, n = [], np.zeros((4, 64), np.int64), 0
    for hashes in shingle_hashes(data, width):
        ones[0] += _bit_sums(hashes).sum(0, dtype=np.int64)
        for word, factor in enumerate(_FACTORS, 1):
            mixed = (hashes ^ (hashes >> np.uint64(31))) * factor
            ones[word] += _bit_sums(mixed ^ (mixed >> np.uint64(29))).sum(0, dtype=np.int64)
        found.append(np.unique(hashes))
        n += len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(4, np.uint64)
    return np.unique(np.concatenate(found)), np.packbits(2 * ones > n, axis=1).view(">u8").ravel().astype(np.uint64)


def close_pairs(a: np.ndarray, b: np.ndarray, same: bool):
    """Positions of rows of ``a`` and ``b`` (four words each) near in the first word and in all four, strip by strip.

    Both sides are ordered by population count, and a strip of ``a`` is compared only with the part of ``b`` whose
    counts are within the radius.  With ``same`` both are one tile, and each pair is given once.
    """
    count_a, count_b = np.bitwise_count(a[:, 0]), np.bitwise_count(b[:, 0])
    order_a, order_b = np.argsort(count_a, kind="stable"), np.argsort(count_b, kind="stable")
    sorted_b = count_b[order_b].astype(np.int64)
    step = max(1, (1 << 18) // max(1, len(b)))
    for at in range(0, len(a), step):
        strip = order_a[at:at + step]
        low = np.searchsorted(sorted_b, int(count_a[strip[0]]) - SIMILAR_RADIUS, "left")
        high = np.searchsorted(sorted_b, int(count_a[strip[-1]]) + SIMILAR_RADIUS, "right")
        part = order_b[low:high]
        i, j = np.nonzero(np.bitwise_count(a[strip, None, 0] ^ b[None, part, 0]) <= SIMILAR_RADIUS)
        i, j = strip[i], part[j]
        if same:
            i, j = i[i < j], j[i < j]
        near = np.bitwise_count(a[i] ^ b[j]).sum(1, dtype=np.int64) <= WIDE_RADIUS
        yield i[near], j[near]
