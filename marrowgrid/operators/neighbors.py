"""Nearest code and k nearest neighbours.

Codes are a model: they travel with the task and each Arrow batch is one
matrix product.  Neighbours among events use the same path while the base is
small.  A large base is cut into cells around pivots, and the triangle
inequality decides which cells a query has to visit.  In many dimensions it
rules out next to nothing; how much is counted before any vector travels, and
then slices of queries go round blocks of the base instead.  Blocks are as large
as a task may hold, so a vector is sent a few times, however small the cells.

:func:`knn_indexed` is the approximate search for graphs over large cohorts:
an inverted file of all rows, of which a query visits the nearest lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrowgrid.functions.vectors import matrix_of, squared_distances
from marrowgrid.operators.selection import hash_order, take
from marrowgrid.operators.sizing import as_model, model_rows
from marrowgrid.session import staged

#: numbers (rows x dimensions) of a base that may travel to every task
SHIPPED_NUMBERS = 4_000_000
#: least rows of one block in the cell join
BLOCK_ROWS = 8_192
#: numbers of the vectors of one block, and pairs one task compares, at most (unless a block of least rows has more)
TILE_NUMBERS, TILE_PAIRS = 8_000_000, 4_000_000_000
#: queries and base rows whose distances are held at once, and numbers of vectors that are copied at once
PIECE_QUERIES, PIECE_ROWS, PIECE_NUMBERS = 256, 1_024, 4_000_000
#: part of all (query, base row) pairs from which on cells give way to rounds
CELL_SHARE = 0.2
#: numbers of the sample that the lists of an index are learnt from, and rounds of learning
TRAINED_NUMBERS, TRAINED_ROUNDS = 2_000_000, 8


def nearest_code(
    events: DataFrame, codes: np.ndarray, labels: Sequence[int] | None = None, *, x: str = "x", node: str = "node_id",
    distance: str | None = "distance", keep: Sequence[str] | None = None,
) -> DataFrame:
    """Adds the best code of each event and its euclidean distance."""
    if codes.size > SHIPPED_NUMBERS:
        raise ValueError("codebook is not model-sized")
    keep = [c for c in events.columns if c != x] if keep is None else list(keep)
    names = np.arange(len(codes)) if labels is None else np.asarray(labels)
    schema = T.StructType([events.schema[c] for c in keep] + [T.StructField(node, T.LongType())]
                          + ([T.StructField(distance, T.DoubleType())] if distance else []))
    shipped = events.sparkSession.sparkContext.broadcast((np.asarray(codes, dtype=float), names.astype("int64")))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, ids = shipped.value
        for batch in batches:
            m = matrix_of(batch.column(len(keep)))
            best = squared_distances(m, book).argmin(axis=1) if len(m) else np.empty(0, dtype=int)
            columns = [batch.column(i) for i in range(len(keep))] + [pa.array(ids[best])]
            if distance:
                columns.append(pa.array(np.sqrt(((m - book[best]) ** 2).sum(axis=1)) if len(m) else np.empty(0)))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return events.select(*keep, x).mapInArrow(assign, schema)


def knn(
    queries: DataFrame, base: DataFrame, k: int, *, query_id: str = "query_id", base_id: str = "base_id", x: str = "x",
    exclude_same: bool = True, shipped_numbers: int = SHIPPED_NUMBERS, block_rows: int = BLOCK_ROWS, cell_share: float = CELL_SHARE,
) -> DataFrame:
    """Exact k nearest base rows of every query: (query_id, base_id, distance, rank).

    ``exclude_same`` leaves out the base row with the query's own id.  ``cell_share`` is the part of all pairs that
    cells may leave to compare; beyond it the search goes on in rounds (0: always, above 1: never).
    """
    q = queries.select(F.col(query_id).cast("long").alias("q"), F.col(x).alias("x"))
    b = base.select(F.col(base_id).cast("long").alias("b"), F.col(x).alias("x"))
    size = b.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    if size["n"] == 0:
        found = q.select("q", F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("distance")).limit(0)
    elif size["n"] * size["d"] <= shipped_numbers:
        found = _against_shipped(q, b, k, exclude_same)
    else:
        found = _distinct_search(q, b, k, exclude_same, size["d"], block_rows, shipped_numbers, cell_share)
    order = Window.partitionBy("q").orderBy("distance", "b")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select(F.col("q").alias(query_id), F.col("b").alias(base_id), "distance", "rank"))


def _top(qid: np.ndarray, qx: np.ndarray, bid: np.ndarray, bx: np.ndarray, k: int, exclude: bool, limit: np.ndarray | None = None):
    """Candidates (q, b, distance) of two bounded blocks, at most k per query and none beyond its ``limit``.

    Matrix products tell what cannot be among the best, with slack for their rounding; exact distances and then the
    smaller id decide, also among equal distances.
    """
    qx, bx = np.asarray(qx, float), np.asarray(bx, float)
    # rows of a query's own id never count
    wide = k + (int(np.unique(bid, return_counts=True)[1].max()) if exclude and len(bid) else 0)
    norms = (bx * bx).sum(axis=1)
    most = norms.max() if len(norms) else 0.0
    # the product adds the norms of the base, those of the queries are in the bounds
    right = np.column_stack([bx, norms]).T if len(bid) else bx.T
    out = []
    for lo in range(0, len(qid), PIECE_QUERIES):
        part, ids = qx[lo:lo + PIECE_QUERIES], qid[lo:lo + PIECE_QUERIES]
        own = (part * part).sum(axis=1)
        left = np.column_stack([-2.0 * part, np.ones(len(part))])
        slack = 1e-12 * (own + most) + 1e-300
        bound = np.full(len(ids), np.inf) if limit is None else limit[lo:lo + PIECE_QUERIES] ** 2 * (1 + 1e-9)
        who, where, far = np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)
        for at in range(0, len(bid), PIECE_ROWS):
            d = left @ right[:, at:at + PIECE_ROWS]
            if d.shape[1] > wide:
                loose = np.isinf(bound)
                if loose.any():
                    bound[loose] = np.partition(d[loose], wide - 1, axis=1)[:, wide - 1] + own[loose] + slack[loose]
            i, j = np.nonzero(d <= (bound - own + slack)[:, None])
            j = j + at
            if exclude:
                other = ids[i] != bid[j]
                i, j = i[other], j[other]
            if not len(i):
                continue
            step = max(1, PIECE_NUMBERS // max(part.shape[1], 1))
            exact = np.concatenate([np.sqrt(((part[i[c:c + step]] - bx[j[c:c + step]]) ** 2).sum(axis=1)) for c in range(0, len(i), step)])
            who, where, far = np.concatenate([who, i]), np.concatenate([where, j]), np.concatenate([far, exact])
            order = np.lexsort((bid[where], far, who))
            who, where, far = who[order], where[order], far[order]
            first = np.searchsorted(who, np.arange(len(ids) + 1))
            kept = np.arange(len(who)) - first[who] < k
            full = np.diff(first) >= k
            bound[full] = np.minimum(bound[full], far[first[:-1][full] + k - 1] ** 2 * (1 + 1e-9))
            who, where, far = who[kept], where[kept], far[kept]
        out.append((ids[who], bid[where], far))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)]


_FOUND = "q long, b long, distance double"


def _against_shipped(q: DataFrame, b: DataFrame, k: int, exclude: bool) -> DataFrame:
    table = b.toArrow()  # at most SHIPPED_NUMBERS numbers, checked by the caller
    packed = q.sparkSession.sparkContext.broadcast(
        (table.column("b").to_numpy(), matrix_of(table.column("x")).astype(float)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bid, bx = packed.value
        for batch in batches:
            if batch.num_rows:
                found = _top(batch.column(0).to_numpy(), matrix_of(batch.column(1)), bid, bx, k, exclude)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["q", "b", "distance"])

    return q.mapInArrow(search, _FOUND)


def _distinct_search(q: DataFrame, b: DataFrame, k: int, exclude: bool, d: int, block: int, shipped: int, cell_share: float) -> DataFrame:
    """Search distinct vectors once, however many copies they have.

    Copies of a base vector are at one distance, so only the k + 1 smallest
    ids of each vector can be among the neighbours of anyone.  Equal queries
    share one search for k + 1 neighbours and then leave themselves out.
    """
    wide = k + 1 if exclude else k
    # floats of half the width travel where they hold the same values
    same = F.bool_and(F.col("x").cast("array<float>").cast("array<double>") == F.col("x").cast("array<double>"))
    narrow = all(df.agg(same).first()[0] is not False for df in (b, q))
    b, q = [df.withColumn("x", F.col("x").cast("array<float>" if narrow else "array<double>")) for df in (b, q)]
    # Spark cuts each group of copies before the shuffle
    copies = b.withColumn("_k", F.row_number().over(Window.partitionBy("x").orderBy("b"))).where(F.col("_k") <= wide).drop("_k")
    copies = staged(copies, "copies")
    asked = staged(q.groupBy("x").agg(F.min("q").alias("q")), "asked")
    # who asks for whom, so that no vector travels with the neighbours found
    groups = staged(q.join(asked.withColumnRenamed("q", "_first"), "x").select("q", "_first"), "groups")
    found = _by_cells(asked, copies, wide, False, copies.count(), d, block, shipped, cell_share)
    order = Window.partitionBy("q").orderBy("distance", "b")
    best = found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= wide).drop("_k")
    dealt = groups.join(best.withColumnRenamed("q", "_first"), "_first").select("q", "b", "distance")
    return dealt.where("q <> b") if exclude else dealt


def _by_cells(q: DataFrame, b: DataFrame, k: int, exclude: bool, n: int, d: int, block: int, shipped: int, cell_share: float) -> DataFrame:
    # pivots are a model: about the square root of the base, bounded
    wanted = int(min(math.sqrt(n), 2048, shipped // d))
    rows = model_rows(take(b, max(wanted, 2), hash_order("b")))
    pivots = np.array([r["x"] for r in rows], dtype=float)
    kept = staged(nearest_code(b.withColumn("v", F.col("x")), pivots, node="cell", distance="radius", keep=["b", "v"]), "base")
    asked = staged(nearest_code(q.withColumn("v", F.col("x")), pivots, node="cell", distance=None, keep=["q", "v"]), "query")
    cells = as_model(kept.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("r")))
    order = Window.partitionBy("q").orderBy("distance", "b")
    nearest = _cell_join(asked, kept, cells, k, exclude, block, d).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k)
    home = staged(nearest.drop("_k"), "home")
    # distance of the k-th neighbour at home bounds the search elsewhere
    bound = home.groupBy("q").agg(F.count("*").alias("c"), F.max("distance").alias("d"))
    bound = bound.select("q", F.when(F.col("c") >= k, F.col("d")).otherwise(F.lit(float("inf"))).alias("bound"))
    book = {r["cell"]: (r["n"], r["r"]) for r in model_rows(cells)}
    ids = np.array(sorted(book), dtype="int64")
    reach = np.array([book[i][1] for i in ids])
    sent = q.sparkSession.sparkContext.broadcast((pivots[ids], ids, reach))

    # a query may visit every cell, so few queries are looked at at once: their copies stay bounded
    few = max(1, PIECE_NUMBERS // max(1, len(ids) * d))

    def _goes(batches: Iterator[pa.RecordBatch]):
        centers, names, radius = sent.value
        for whole in batches:
            for lo in range(0, whole.num_rows, few):
                batch = whole.slice(lo, few)
                gap = np.sqrt(squared_distances(matrix_of(batch.column(1)).astype(float), centers)) - radius[None, :]
                limit = batch.column(3).to_numpy(zero_copy_only=False)[:, None]
                # a hair of slack for rounding in the matrix product
                yield batch, (gap <= limit * (1 + 1e-9) + 1e-6) & (names[None, :] != batch.column(2).to_numpy()[:, None])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value[1]
        for batch, go in _goes(batches):
            who, where = np.nonzero(go)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who)), pa.array(names[where]), batch.column(3).take(pa.array(who))],
                names=["q", "v", "cell", "bound"])

    bounded = asked.join(bound, "q", "left").select("q", "v", "cell", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    sizes = np.array([book[i][0] for i in ids])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # counted without any copy of a vector
        total = sum((float((go @ sizes).sum()) for _, go in _goes(batches)), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["pairs"])

    # pairs that the cells would compare, against all pairs there are
    pairs = bounded.mapInArrow(load, "pairs double").agg(F.sum("pairs")).first()[0] or 0.0
    if pairs > cell_share * asked.count() * n:
        return by_rounds(bounded.select("q", "v", "bound"), kept.select("b", "v"), k, exclude, n, d, block)
    kind = asked.schema["v"].dataType.simpleString()
    away = bounded.mapInArrow(visits, f"q long, v {kind}, cell long, bound double")
    return home.unionByName(_cell_join(away, kept, cells, k, exclude, block, d))


def _tile_rows(d: int, block: int) -> int:
    return max(block, TILE_NUMBERS // max(d, 1))


def by_rounds(q: DataFrame, b: DataFrame, k: int, exclude: bool, n: int, d: int, block: int = BLOCK_ROWS) -> DataFrame:
    """Exact candidates ``q, b, distance`` without any pruning, at most k a query; ``q`` are unique ids.

    Base and queries are dealt to blocks and slices, and every slice goes round all blocks, which is one shuffle: a
    query is sent once per block, a base row once per slice.  A task holds one of each.  There are as many as memory
    or parallelism ask for.  With a column ``bound`` of ``q`` nothing farther is looked at.
    """
    slots = q.sparkSession.sparkContext.defaultParallelism
    asked = q.count()
    rows = _tile_rows(d, block)
    # balanced: both sides are sent about equally often
    tiles = min(2 * slots, max(1, -(-n // block)) * max(1, -(-asked // block)))
    blocks = max(-(-n // rows), min(tiles, round(math.sqrt(tiles * n / max(asked, 1)))), 1)
    slices = max(-(-asked // rows), -(-tiles // blocks), 1)
    slices = max(slices, -(-asked * -(-n // blocks) // TILE_PAIRS))
    held = q if "bound" in q.columns else q.withColumn("bound", F.lit(float("inf")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = held.withColumn("slice", F.pmod(F.xxhash64("q"), F.lit(slices)).cast("int")).withColumn("block", every(blocks))
    right = b.withColumn("block", F.pmod(F.xxhash64("b"), F.lit(blocks)).cast("int")).withColumn("slice", every(slices))
    order = Window.partitionBy("q").orderBy("distance", "b")
    found = _matched(left, right, ["block", "slice"], k, exclude).withColumn("_k", F.row_number().over(order))
    return found.where(F.col("_k") <= k).drop("_k")


# --- index -------------------------------------------------------------------


def index_centres(base: DataFrame, lists: int, base_id: str = "base_id", x: str = "x") -> np.ndarray:
    """Centres of an inverted file: k-means on a sample of at most ``TRAINED_NUMBERS`` numbers, drawn by hash of the id."""
    d = base.agg(F.max(F.size(x))).first()[0] or 1
    rows = model_rows(take(base.select(F.col(base_id).alias("b"), F.col(x).alias("x")), max(1, min(TRAINED_NUMBERS // d, 100_000)), hash_order("b")))
    sample = np.array([r["x"] for r in sorted(rows, key=lambda r: r["b"])], float).reshape(len(rows), -1)
    centres = sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)]
    for _ in range(TRAINED_ROUNDS):
        own = np.concatenate([squared_distances(sample[i:i + 4096], centres).argmin(1) for i in range(0, len(sample), 4096)])
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


class Index:
    """Inverted file of all base rows: learnt centres, and every row filed under its nearest one."""

    def __init__(self, base: DataFrame, lists: int | None = None, base_id: str = "base_id", x: str = "x"):
        b = base.select(F.col(base_id).cast("long").alias("b"), F.col(x).alias("v"))
        n = b.count()
        self.base_id = base_id
        self.centres = index_centres(base, lists or int(min(max(math.sqrt(n), 1), 4096)), base_id, x) if n else np.empty((0, 0))
        if n:
            self.kept = staged(nearest_code(b.withColumn("x", F.col("v")), self.centres, node="cell", distance=None, keep=["b", "v"]), "lists")
            self.cells = as_model(self.kept.groupBy("cell").agg(F.count("*").alias("n")))

    def search(
        self, queries: DataFrame, k: int, probes: int, *, query_id: str = "query_id", x: str = "x", exclude_same: bool = True,
        block_rows: int = BLOCK_ROWS,
    ) -> DataFrame:
        """Near neighbours in the ``probes`` nearest lists of every query: (query_id, base_id, distance, rank).

        Distances are exact, neighbours in other lists are missed.  A list of many rows is cut into blocks, so no list
        is one task's.
        """
        q = queries.select(F.col(query_id).cast("long").alias("q"), F.col(x).alias("v"))
        if not len(self.centres):
            return q.select(F.col("q").alias(query_id), F.lit(0).cast("long").alias(self.base_id), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
        wide = min(probes, len(self.centres))
        sent = queries.sparkSession.sparkContext.broadcast(self.centres)

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = matrix_of(batch.column(1))
                if len(m):
                    near = squared_distances(m, sent.value)
                    pick = np.argpartition(near, wide - 1, axis=1)[:, :wide]
                    who = pa.array(np.repeat(np.arange(len(m)), wide))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(pick.ravel())], names=["q", "v", "cell"])

        asked = q.mapInArrow(visits, "q long, v array<double>, cell long")
        found = _cell_join(asked, self.kept, self.cells, k, exclude_same, block_rows, self.centres.shape[1])
        order = Window.partitionBy("q").orderBy("distance", "b")
        return (
            found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("q").alias(query_id), F.col("b").alias(self.base_id), "distance", "rank"))

    def tuned(self, asked: DataFrame, exact: DataFrame, k: int, target: float = 0.9, **kw) -> tuple[int, float]:
        """Fewest probes (doubled from 4) whose measured recall on ``asked`` reaches the target, and that recall."""
        probes = 4
        while True:
            reached = recall(self.search(asked, k, probes, **kw), exact, kw.get("query_id", "query_id")).first()["recall"]
            if reached is None or reached >= target or probes >= len(self.centres):
                return probes, reached or 0.0
            probes *= 2


def knn_indexed(
    queries: DataFrame, base: DataFrame, k: int, *, probes: int = 8, lists: int | None = None, query_id: str = "query_id",
    base_id: str = "base_id", x: str = "x", exclude_same: bool = True,
) -> DataFrame:
    """Build an :class:`Index` of the base and search it."""
    return Index(base, lists, base_id, x).search(queries, k, probes, query_id=query_id, x=x, exclude_same=exclude_same)


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(queries, neighbours, recall): share of exact neighbours whose distance the found ones reach, over all queries.

    A found neighbour counts if it is no farther than the exact one of its rank, so equal distances are no misses.
    """
    ours = found.select(query_id, "rank", F.col("distance").alias("_found"))
    met = exact.select(query_id, "rank", "distance").join(ours, [query_id, "rank"], "left")
    hit = F.coalesce(F.col("_found") <= F.col("distance") * (1 + 1e-9) + 1e-12, F.lit(False))
    return met.agg(F.countDistinct(query_id).alias("queries"), F.count("*").alias("neighbours"), F.avg(hit.cast("double")).alias("recall"))


def _cell_join(asked: DataFrame, kept: DataFrame, cells: DataFrame, k: int, exclude: bool, block: int, d: int) -> DataFrame:
    """Candidates of each query in its listed cells.

    A cell is cut into base blocks and query slices that a task can hold, so a
    crowded cell becomes many tasks; other cells are one block.
    """
    rows = _tile_rows(d, block)
    load = as_model(asked.groupBy("cell").agg(F.count("*").alias("nq")))
    blocks = F.ceil(F.col("n") / rows).cast("int")
    plan = as_model(cells.join(load, "cell").select(
        "cell", blocks.alias("blocks"),
        F.greatest(F.ceil(F.col("nq") / rows), F.ceil(F.col("nq") * F.ceil(F.col("n") / blocks) / TILE_PAIRS)).cast("int").alias("slices")))
    span = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    held = asked if "bound" in asked.columns else asked.withColumn("bound", F.lit(float("inf")))
    left = held.join(plan, "cell").withColumn("slice", F.pmod(F.xxhash64("q"), "slices").cast("int")).withColumn("block", span("blocks"))
    right = kept.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("b"), "blocks").cast("int")).withColumn("slice", span("slices"))
    return _matched(left, right, ["cell", "block", "slice"], k, exclude)


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str], k: int, exclude: bool) -> DataFrame:
    """Candidates of the queries on the left among the base rows of the same keys."""
    def match(lhs: pa.Table, rhs: pa.Table) -> pa.Table:
        found = [np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)]
        if lhs.num_rows and rhs.num_rows:
            found = _top(lhs["q"].to_numpy(), matrix_of(lhs["v"]), rhs["b"].to_numpy(), matrix_of(rhs["v"]), k, exclude, lhs["bound"].to_numpy())
        return pa.table([pa.array(c) for c in found], names=["q", "b", "distance"])

    # fresh columns: the two sides may come from one table
    lhs, rhs = [df.select(*[F.col(c).alias(c) for c in (*keys, *names)]) for df, names in ((left, ("q", "v", "bound")), (right, ("b", "v")))]
    return lhs.groupBy(*keys).cogroup(rhs.groupBy(*keys)).applyInArrow(match, _FOUND)
