"""Near copies: texts whose five-word shingle sets have a Jaccard likeness of 0.8 or more, found by SimHash tiles.

Two sets that alike share a shingle among the first fifth of each, whatever the order of all shingles, as long as it
is the same for every text.  So texts meet in cells, one per shingle of these prefixes, and unlike texts mostly meet
nowhere.  The order is by hash, but shingles of passages that many texts share come last; a cell of such a shingle
remains only for texts that hardly hold anything else.

Within a cell fingerprints of 256 bits are compared tile against tile by exclusive-or and bit counts, tile pairs are
skipped by population count.  Cells hand on links, at most one less than they have texts, never pairs; first each text
takes part in one cell only, then only cells that hold texts of several groups are looked at.  The groups found so are
candidates: their shingle sets meet in one place, at most a block of texts against another, and links are those pairs
whose likeness is confirmed.  A pair already in one group is not compared, so large groups of copies take one
comparison a text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrowgrid.llm.common import components, slices, utf8
from marrowgrid.llm.simhash import WIDE_RADIUS, close_pairs, sketch
from marrowgrid.session import staged, unstaged

WIDTH, SIMILAR = 5, 0.8
#: texts of a tile, texts and shingles of a block that is confirmed at once
TILE, BLOCK, BLOCK_SHINGLES = 2048, 4096, 500_000
#: links that one task joins to groups
LOCAL_LINKS = 1_000_000
#: pairs that a task holds before it reduces them to links
HELD_PAIRS = 1 << 19
#: bytes of text whose shingles are made at once, and times that a task must see a shingle to count it
PIECE, SEEN = 1_000_000, 3
#: shingles that a task holds before it deals them out, and of a bucket
HELD_TOKENS = 1 << 19
#: texts with a shingle in their prefix from which on it is counted as that of a common passage
CROWDED = 256
#: shingles of common passages that are told apart (2 MB); beyond these, cells are larger but nothing is missed
FREQUENT = 1 << 18
#: bits of the set of ids that chosen texts are looked up in (8 MB); rows that meet there by chance are dropped by a join
ID_BITS = 1 << 26


def prefix_length(n: int, least: float) -> int:
    """How many of ``n`` shingles, first in order, must share one with the like number of any set that is alike."""
    return n - math.ceil(least * n - 1e-9) + 1 if n else 0


def _node(sets) -> np.ndarray:
    """Hash of each sorted shingle set."""
    return np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)


def _marked(docs: DataFrame, width: int, least: float) -> DataFrame:
    """``doc_id, node, n, fp, prefix``: hash and size of the shingle set, wide fingerprint, first shingles by hash."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, limit=PIECE):
                sets, prints = zip(*(sketch(utf8(t), width) for t in part["text"].to_pylist()))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part["doc_id"], "node": _node(sets), "n": np.array([len(s) for s in sets], np.int64),
                    "fp": pa.array([p.view(np.int64) for p in prints], pa.list_(pa.int64())),
                    "prefix": pa.array([s[:prefix_length(len(s), least)].view(np.int64) for s in sets], pa.list_(pa.int64()))})
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, "doc_id long, node long, n long, fp array<long>, prefix array<long>")


def _slot(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(ID_BITS))


def _place(*columns: str) -> tuple[Column, Column]:
    """Word of the set that has a row's slot, and its bit there."""
    slot = _slot(*map(F.col, columns))
    return F.floor(slot / 64), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))


def _words(wanted: DataFrame, *columns: str) -> DataFrame:
    """``at, bits``: the words of the set of the rows' slots, at most ``ID_BITS / 64``."""
    at, bit = _place(*columns)
    return wanted.select(at.alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))


def _bitmap(wanted: DataFrame, *columns: str) -> np.ndarray:
    """Set of the rows' slots, in 8 MB whatever their number; merged in Spark."""
    words = _words(wanted, *columns).toArrow()
    held = np.zeros(ID_BITS // 64, np.int64)
    held[words["at"].to_numpy()] = words["bits"].to_numpy()
    return held.view(np.uint64)


def _marked_in(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((bits[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of other ids than the given ``doc_id``, and rows without id; whole rows are not shuffled for the many of them.

    Rows whose id is not in the set of bits stay.  Of the others only ids meet the given ones, and those that were there by
    chance, one in a thousand or so, are joined to their rows.  The set has a bounded number of words, so it is broadcast.
    """
    at, bit = _place("doc_id")
    words = F.broadcast(staged(_words(ids, "doc_id"), "words"))
    looked_up = docs.withColumn("_at", at).join(words.withColumnsRenamed({"at": "_at", "bits": "_bits"}), "_at", "left")
    hit = F.col("doc_id").isNotNull() & (F.coalesce("_bits", F.lit(0).cast("long")).bitwiseAND(bit) != 0)
    rest, hits = (looked_up.where(w).select(*docs.columns) for w in (~hit, hit))
    chance = staged(hits.select("doc_id").distinct().join(ids, "doc_id", "left_anti"), "chance")
    return rest if chance.isEmpty() else rest.unionByName(hits.join(chance, "doc_id", "left_semi"))


def _text_sets(docs: DataFrame, wanted: DataFrame, width: int, then, schema: str) -> DataFrame:
    """``then(batches)`` over ``(nodes, sets)`` of the texts of the wanted ``node, id``, in one pass without a shuffle.

    Texts are looked up in two sets of bits, by id before any shingle is made and by shingle set and id after; one text
    in a thousand or so that is not wanted comes through, and one of several equal rows is as good as the others.
    """
    sent = docs.sparkSession.sparkContext.broadcast((_bitmap(wanted, "id"), _bitmap(wanted, "node", "id")))

    def chosen(batches):
        by_id, by_both = sent.value
        for batch in batches:
            rows = batch.filter(pa.array(_marked_in(by_id, batch["slot"].to_numpy())))
            for part in slices(rows, limit=PIECE):
                sets = [sketch(utf8(t), width)[0] for t in part["text"].to_pylist()]
                nodes = _node(sets)
                both = [xxhash.xxh64_intdigest(i, xxhash.xxh64_intdigest(n, 42)) for n, i in zip(
                    np.split(nodes.view(np.uint8), len(nodes)), np.split(part["doc_id"].to_numpy().view(np.uint8), len(nodes)))]
                keep = np.nonzero(_marked_in(by_both, (np.array(both, np.uint64).view(np.int64) % ID_BITS)))[0]
                if len(keep):
                    yield nodes[keep], [sets[k].view(np.int64) for k in keep]
            pa.default_memory_pool().release_unused()

    given = docs.select("doc_id", "text", _slot(F.col("doc_id")).alias("slot"))
    return given.mapInArrow(lambda batches: then(chosen(batches)), schema)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``node, shingles`` of the wanted ``node, id`` (and of hardly any other)."""
    def then(found):
        for nodes, sets in found:
            yield pa.RecordBatch.from_pydict({"node": nodes, "shingles": pa.array(sets, pa.list_(pa.int64()))})

    return _text_sets(docs, wanted, width, then, "node long, shingles array<long>")


def _dealt(prefixes: DataFrame, buckets: int, without: np.ndarray, counted: bool) -> DataFrame:
    """Shingles of prefixes dealt to buckets in packed lists: ``bucket, tokens, of``, with the nodes or with counts.

    Only shingles that a task holds twice are counted.  The counts choose an order and what is compared in tiles, never
    what is compared.
    """
    sent = prefixes.sparkSession.sparkContext.broadcast(without)

    def pack(tokens: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
        if counted:
            tokens, of = np.unique(tokens, return_counts=True)
            tokens, of = tokens[of > 1], of[of > 1]
        bucket = (tokens.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        own, first = np.unique(bucket[order], return_index=True)
        offsets = pa.array(np.append(first, len(order)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (tokens, of)]
        return pa.RecordBatch.from_arrays([pa.array(own), *lists], names=["bucket", "tokens", "of"])

    def run(batches):
        tokens, nodes, held = [], [], 0
        for batch in batches:
            lists = batch["prefix"]
            flat = lists.flatten().to_numpy()
            of = np.repeat(batch["node"].to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False))
            if len(sent.value):
                keep = ~_among(sent.value, flat)
                flat, of = flat[keep], of[keep]
            tokens.append(flat)
            nodes.append(of)
            held += len(flat)
            if held > HELD_TOKENS:
                yield pack(np.concatenate(tokens), np.concatenate(nodes))
                tokens, nodes, held = [], [], 0
        if held:
            yield pack(np.concatenate(tokens), np.concatenate(nodes))

    return prefixes.select("node", "prefix").mapInArrow(run, "bucket long, tokens array<long>, of array<long>")


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a bucket in order, what they are of, start and length of each run of equal ones."""
    tokens, of = (table[c].combine_chunks().flatten().to_numpy() for c in ("tokens", "of"))
    order = np.argsort(tokens, kind="stable")
    tokens, of = tokens[order], of[order]
    first = np.nonzero(np.append(True, tokens[1:] != tokens[:-1]))[0] if len(tokens) else np.zeros(0, np.int64)
    return tokens, of, first, np.diff(np.append(first, len(tokens)))


def _buckets(prefixes: DataFrame) -> int:
    total = prefixes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    return max(8 * int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // HELD_TOKENS)


def _crowded(prefixes: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in the prefixes of more than ``CROWDED`` texts with that number, at most the ``FREQUENT`` commonest."""
    def count(table: pa.Table) -> pa.Table:
        tokens, of, first, _ = _flat(table)
        total = np.add.reduceat(of, first) if len(first) else of
        many = total > CROWDED
        return pa.table({"token": tokens[first][many], "size": total[many]})

    found = _dealt(prefixes, buckets, np.zeros(0, np.int64), True).groupBy("bucket").applyInArrow(count, "token long, size long")
    top = found.orderBy(F.col("size").desc(), "token").limit(FREQUENT).toArrow().sort_by("token")
    return top["token"].to_numpy(), top["size"].to_numpy()


def _prefixes(marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, id, prefix`` of one text of each node, without a shuffle of the prefixes of texts that have no copy."""
    context = marked.sparkSession.sparkContext
    sent = context.broadcast((_bitmap(nodes.where("copies > 1"), "node"), _bitmap(nodes, "row")))

    def run(batches, alone: bool):
        several, chosen = sent.value
        for batch in batches:
            copied = _marked_in(several, batch["of"].to_numpy())
            keep = ~copied if alone else copied & _marked_in(chosen, batch["at"].to_numpy())
            yield batch.filter(pa.array(keep)).drop_columns(["of", "at"])

    given = marked.select("node", F.col("doc_id").alias("id"), "prefix", "row", _slot(F.col("node")).alias("of"), _slot(F.col("row")).alias("at"))
    schema = "node long, id long, prefix array<long>, row long"
    copied = given.mapInArrow(lambda b: run(b, False), schema).join(nodes.select("row"), "row", "left_semi").drop("row")
    return given.mapInArrow(lambda b: run(b, True), schema).drop("row").unionByName(copied)


def _holding(nodes: DataFrame, tokens: np.ndarray, hold: bool = True) -> DataFrame:
    """``node, id`` of the texts with one of these shingles in their prefix; without ``hold`` ``node, prefix`` of the others."""
    sent = nodes.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        for batch in batches:
            lists = batch["prefix"]
            hit = _among(sent.value, lists.flatten().to_numpy())
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            found = np.unique(row[hit])
            if hold:
                yield batch.select(["node", "id"]).take(pa.array(found))
            else:
                yield batch.select(["node", "prefix"]).take(pa.array(np.setdiff1d(np.arange(batch.num_rows), found)))

    return nodes.select("node", "id", "prefix").mapInArrow(run, "node long, id long" if hold else "node long, prefix array<long>")


def _common_last(docs: DataFrame, nodes: DataFrame, crowded: np.ndarray, width: int, least: float) -> DataFrame:
    """``node, prefix`` in an order that has the shingles of common passages last, the commonest at the end.

    Any order will do as long as it is one for all texts.  Shingles are counted in the texts that hold a crowded one;
    a task counts those that it sees ``SEEN`` times, so the many that occur once do not travel.
    """
    def count(found):
        sets, held = [], 0

        def flush():
            tokens, n = np.unique(np.concatenate(sets), return_counts=True)
            return pa.RecordBatch.from_pydict({"token": tokens[n >= SEEN], "df": n[n >= SEEN].astype(np.int64)})

        for _, some in found:
            sets += some
            held += sum(map(len, some))
            if held > 4 * HELD_TOKENS:
                yield flush()
                sets, held = [], 0
        if sets:
            yield flush()

    affected = staged(_holding(nodes, crowded), "affected")
    late = _text_sets(docs, affected, width, count, "token long, df long").groupBy("token").agg(F.sum("df").alias("df")) \
        .where(F.col("df") > CROWDED // 2).orderBy(F.col("df").desc(), "token").limit(FREQUENT).toArrow().sort_by("token")
    known, df = late["token"].to_numpy(), late["df"].to_numpy()
    # what is crowded goes last too, also where no task sees it often
    more = np.setdiff1d(crowded, known)
    known, df = np.concatenate([known, more]), np.concatenate([df, np.full(len(more), CROWDED)])
    order = np.argsort(known)
    known, df = known[order], df[order]
    sent = docs.sparkSession.sparkContext.broadcast((known, df))

    def prefixes(found):
        known, df = sent.value
        for nodes, sets in found:
            firsts = []
            for s in sets:
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                order = np.lexsort((s.view(np.uint64), np.where(known[at] == s, df[at], 0)))
                firsts.append(s[order[:prefix_length(len(s), least)]])
            yield pa.RecordBatch.from_pydict({"node": nodes, "prefix": pa.array(firsts, pa.list_(pa.int64()))})

    # the prefix of any other text has none of these shingles, so it is the same in the new order
    moved = staged(_holding(nodes, known), "moved")
    fresh = _text_sets(docs, moved, width, prefixes, "node long, prefix array<long>")
    return _holding(nodes, known, False).unionByName(fresh)


def _meetings(prefixes: DataFrame) -> DataFrame:
    """``token, node, size`` of every shingle that the prefixes of several texts hold."""
    buckets = _buckets(prefixes)
    crowded, sizes = _crowded(prefixes, buckets)
    sent = prefixes.sparkSession.sparkContext.broadcast((crowded, sizes))

    def several(table: pa.Table) -> pa.Table:
        tokens, of, first, size = _flat(table)
        size = np.repeat(size, size)
        met = size > 1
        return pa.table({"token": tokens[met], "node": of[met], "size": size[met].astype(np.int64)})

    def large(batches):
        crowded, sizes = sent.value
        for batch in batches:
            flat = batch["prefix"].flatten().to_numpy()
            of = np.repeat(batch["node"].to_numpy(), batch["prefix"].value_lengths().to_numpy(zero_copy_only=False))
            hit = _among(crowded, flat)
            yield pa.RecordBatch.from_pydict({"token": flat[hit], "node": of[hit], "size": sizes[np.searchsorted(crowded, flat[hit])]})

    schema = "token long, node long, size long"
    few = _dealt(prefixes, buckets, crowded, False).groupBy("bucket").applyInArrow(several, schema)
    return few if not len(crowded) else few.unionByName(prefixes.select("node", "prefix").mapInArrow(large, schema))


def _links(batches, two_sided: bool):
    """Links between texts of unlike label that are near in bits and in size of set, per row's list(s) of texts."""
    for batch in batches:
        a, b, held = [], [], 0
        for row in range(batch.num_rows):
            sides = [batch[c][row].values for c in (("members", "others") if two_sided else ("members",))]
            label, n = ([x.field(c).to_numpy(zero_copy_only=False) for x in sides] for c in ("label", "n"))
            wide = [x.field("fp").flatten().to_numpy().view(np.uint64).reshape(-1, 4) for x in sides]
            for i, j in close_pairs(wide[0], wide[-1], not two_sided):
                ok = (label[0][i] != label[-1][j]) & (
                    np.minimum(n[0][i], n[-1][j]) >= SIMILAR * np.maximum(n[0][i], n[-1][j]) - 1e-6)
                a.append(label[0][i[ok]])
                b.append(label[-1][j[ok]])
                held += int(ok.sum())
                if held > HELD_PAIRS:
                    # what a few links can say is not held as pairs
                    x, y = _tree(np.concatenate(a), np.concatenate(b))
                    a, b, held = [x], [y], len(x)
                    if held > HELD_PAIRS // 2:
                        yield pa.RecordBatch.from_pydict({"a": x, "b": y})
                        a, b, held = [], [], 0
        if held:
            x, y = _tree(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_pydict({"a": x, "b": y})


def _tree(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the links (a, b) join, each node to the least one of its group."""
    values, owner = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = owner[:len(a)], owner[len(a):]
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
    return values[label[moved]].astype(np.int64), values[moved].astype(np.int64)


def _groups(links: DataFrame) -> DataFrame:
    """``node, root`` of the links: the least node reachable, as by ``components``.

    Up to ``LOCAL_LINKS`` links (16 MB) are joined in one task instead of rounds of jobs.
    """
    held = staged(links, "links")
    if held.count() > LOCAL_LINKS:
        return components(held)

    def join(batches):
        parts = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in batches]
        if parts:
            a, b = (np.concatenate(x) for x in zip(*parts))
            root, node = _tree(a, b)
            top = np.setdiff1d(np.concatenate([a, b]), node)
            yield pa.RecordBatch.from_pydict({"node": np.concatenate([node, top]), "root": np.concatenate([root, top])})

    return held.coalesce(1).mapInArrow(join, "node long, root long")


def _in_cells(rows: DataFrame, tile: int, every_pair: bool) -> DataFrame:
    """Links of labels within the cells ``cell`` of rows ``cell, size, node, label, n, fp``; large cells are cut into tiles.

    Without ``every_pair`` tiles are not compared with each other.
    """
    member = F.struct("node", "label", "n", "fp").alias("member")
    dealt = rows.select("cell", F.ceil(F.col("size") / tile).alias("cuts"), member) \
        .withColumn("cut", F.pmod(F.xxhash64("member.node"), F.col("cuts")))
    tiles = dealt.groupBy("cell", "cut").agg(F.collect_list("member").alias("members"), F.first("cuts").alias("cuts"))
    if not every_pair:
        return tiles.select("members").mapInArrow(lambda b: _links(b, False), "a long, b long")
    tiles = staged(tiles, "tiles")
    found = tiles.select("members").mapInArrow(lambda b: _links(b, False), "a long, b long")
    many = tiles.where("cuts > 1")
    if many.isEmpty():
        return found
    left = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).where("other > cut")
    pairs = left.join(many.select("cell", F.col("cut").alias("other"), F.col("members").alias("others")), ["cell", "other"])
    return found.unionByName(pairs.select("members", "others").mapInArrow(lambda b: _links(b, True), "a long, b long"))


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the group of their ``id``: the least id that links lead to."""
    named = found.select(F.col("node").alias("id"), F.col("root").alias("label"))
    return rows.join(named, "id", "left").withColumn("label", F.coalesce("label", "id"))


def candidates(nodes: DataFrame, met: DataFrame, tile: int = TILE) -> DataFrame:
    """Links of ids whose texts (``node, id, n, fp``) share a prefix shingle (``met``, as by ``_meetings``) and are near in bits.

    The groups that they make hold every pair that is alike.
    """
    home = met.groupBy("node").agg(F.max(F.struct("size", "token")).alias("home")) \
        .select("node", F.col("home.token").alias("cell"), F.col("home.size").alias("size"))
    links = staged(_in_cells(home.join(nodes, "node").withColumn("label", F.col("id")), tile, False), "links")
    # a cell of one group has nothing left to find
    named = staged(_labelled(nodes, _groups(links)).select("node", "label"), "labels")
    rows = met.join(named, "node")
    several = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    rest = rows.join(several, "token").join(nodes, "node").withColumnRenamed("token", "cell")
    return links.unionByName(_in_cells(rest, tile, True)).distinct()


def alike(ids: np.ndarray, shingles: list[np.ndarray], side: np.ndarray, label: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs with a likeness of ``least`` or more that join the texts' labels; pairs of one label are not compared.

    With two sides only texts of unlike sides are compared.
    """
    size = np.array([len(s) for s in shingles], np.int64)
    flat = np.unique(np.concatenate(shingles), return_inverse=True)[1]
    start = np.cumsum(size) - size
    mine = np.zeros(flat.max() + 1, bool)
    label = np.unique(label, return_inverse=True)[1]
    two = bool((side != side[0]).any())
    later = np.arange(len(ids))
    found = []
    for x in range(len(ids)):
        if two and side[x]:
            continue
        other = (label != label[x]) & (np.minimum(size, size[x]) >= least * np.maximum(size, size[x]) - 1e-6)
        other = np.nonzero(other & ((side == 1) if two else (later > x)))[0]
        if not len(other):
            continue
        own = flat[start[x]:start[x] + size[x]]
        mine[own] = True
        if 8 * len(other) > len(ids):
            common = np.add.reduceat(mine[flat], start)[other]
        else:
            common = np.array([mine[flat[start[y]:start[y] + size[y]]].sum() for y in other])
        mine[own] = False
        for y in other[common >= least * (size[x] + size[other] - common) - 1e-9]:
            if label[y] != label[x]:
                found.append((int(ids[x]), int(ids[y])))
                label[label == label[y]] = label[x]
    return found


def _confirm(least: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        group, ids, side, label = (table[c].to_numpy() for c in ("group", "id", "side", "label"))
        shingles = np.empty(len(ids), object)
        shingles[:] = [s.values.to_numpy() for s in table["shingles"]]
        order = np.argsort(group, kind="stable")
        found = []
        for own in np.split(order, np.nonzero(np.diff(group[order]))[0] + 1):
            if len(own) > 1:
                found += alike(ids[own], list(shingles[own]), side[own], label[own], least)
        return pa.table({"a": np.array([f[0] for f in found], np.int64), "b": np.array([f[1] for f in found], np.int64)})

    return run


def confirmed(groups: DataFrame, sets: DataFrame, least: float, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Links of texts that are alike, among the candidate groups ``node, id, group, n``; ``sets``: ``node, shingles``.

    A group of several blocks is confirmed block by block first, then each block against each other one.
    """
    spread = groups.groupBy("group").agg(
        F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_shingles)).alias("cuts"))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = staged(groups.join(spread, "group").withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts"))), "blocks")
    filled = rows.join(sets, "node").withColumn("side", F.lit(0))
    # small groups are confirmed many at a time
    share = F.when(F.col("cuts") > 1, F.xxhash64("group", "cut")).otherwise(F.pmod(F.xxhash64("group"), F.lit(total // block_shingles * 2 + 8)))
    own = staged(filled.withColumn("label", F.col("id")).groupBy((F.col("cuts") > 1).alias("large"), share.alias("share"))
                 .applyInArrow(_confirm(least), "a long, b long"), "alike")
    large = rows.where("cuts > 1")
    if large.isEmpty():
        return own
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("other")
    dealt = _labelled(large, staged(_groups(own), "settled")).select("*", other).where("other <> cut").select(
        "group", "node", "id", "label", F.least("cut", "other").alias("low"), F.greatest("cut", "other").alias("high"),
        F.when(F.col("cut") < F.col("other"), 0).otherwise(1).alias("side"))
    # two blocks that are one group by now have no pair to compare
    open_ = dealt.groupBy("group", "low", "high").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").drop("x", "y")
    across = dealt.join(open_, ["group", "low", "high"]).join(sets, "node").groupBy("group", "low", "high") \
        .applyInArrow(_confirm(least), "a long, b long")
    return own.unionByName(across)


def similar_documents(docs: DataFrame, width: int = WIDTH, least: float = SIMILAR, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """``doc_id, component_id`` of every row with an id.

    ``component_id`` is the smallest id reachable over pairs of texts whose shingle sets have a Jaccard likeness of
    ``least`` or more.  Texts with equal sets, such as texts without words (null ones too), are linked without being
    compared.  A text of fewer than ``width`` words is one shingle.  Repeated rows come back as often as given; an id
    with several texts is one document that has them all.  An empty table gives no rows.

    The one step that is not exact: texts alike differ in 39 of 256 bits on average (48 for tiny sets), with a
    deviation of six; pairs beyond ``WIDE_RADIUS`` bits are not looked at.
    """
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    marked = staged(_marked(docs, width, least).withColumn("row", F.monotonically_increasing_id()), "marked")
    # a set (node) is known by the least id that has it
    nodes = staged(marked.groupBy("node").agg(
        F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("fp").alias("fp"),
        F.min("row").alias("row")), "nodes")
    # staged, so that no later task runs two Python workers at a time, one for this filter and one for what reads it
    prefixes = staged(_prefixes(marked, nodes), "own")
    ids = staged(marked.select("doc_id", "node"), "ids")
    unstaged(marked)
    crowded, _ = _crowded(prefixes, _buckets(prefixes))
    if len(crowded):
        own, prefixes = prefixes, staged(_common_last(docs, prefixes, crowded, width, least), "prefixes")
        unstaged(own)
    met = staged(_meetings(prefixes), "met")
    unstaged(prefixes)
    near = _groups(candidates(nodes.select("node", "id", "n", "fp"), met, tile)).withColumnsRenamed({"node": "id", "root": "group"})
    unstaged(met)
    groups = staged(nodes.select("node", "id", "n").join(near, "id"), "candidates")
    sets = staged(_sets(docs, groups, width), "sets")
    several = ids.groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("doc_id")
    own = ids.join(several, "doc_id").join(nodes.select("node", "id"), "node").select(
        F.col("doc_id").alias("a"), F.col("id").alias("b"))
    root = _groups(confirmed(groups, sets, least, block).unionByName(own)).withColumnsRenamed({"node": "id", "root": "component_id"})
    unstaged(sets)
    # only sets of several documents, or with alike ones, meet the documents again
    named = staged(nodes.join(root, "id", "left").where("copies > 1 OR component_id IS NOT NULL")
                   .select("node", F.coalesce("component_id", "id").alias("component_id")), "named")
    return ids.join(named, "node", "left").select(
        "doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
