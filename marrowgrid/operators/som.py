"""Self-organising map trained in batches over distributed events.

Every epoch ships the codebooks, lets each Arrow batch reduce its rows to
per-node sums, adds the sums up by node and moves the codes on the driver.
Nothing but node sums leaves a task.  Several models (one per patient) train in
the same jobs when ``model`` names a key column.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from marrowgrid.functions.vectors import matrix_of, nearest, squared_distances
from marrowgrid.operators.neighbors import SHIPPED_NUMBERS, nearest_code
from marrowgrid.operators.selection import hash_order, smallest
from marrowgrid.operators.sizing import as_model, folded, model_rows

# Limits of the heuristics.
MIN_EPOCHS, MAX_EPOCHS, SMALL_SAMPLE, SMALL_SIDE, START_QUANTILE = 10, 100, 50_000, 7, 0.67


def epochs_for(n: int) -> int:
    """Training epochs for n events."""
    return int(min(max(math.sqrt(n) * 0.1, MIN_EPOCHS), MAX_EPOCHS))


def grid_for(n: int, xdim: int, ydim: int) -> tuple[int, int]:
    """A 7 x 7 grid replaces a larger one for small samples."""
    return (SMALL_SIDE, SMALL_SIDE) if n < SMALL_SAMPLE and xdim * ydim > SMALL_SIDE**2 else (xdim, ydim)


def grid_distances(xdim: int, ydim: int) -> np.ndarray:
    """Chebyshev distances of the nodes on the grid, node = y * xdim + x."""
    node = np.arange(xdim * ydim)
    gx, gy = node % xdim, node // xdim
    return np.maximum(np.abs(gx[:, None] - gx[None, :]), np.abs(gy[:, None] - gy[None, :])).astype(float)


@dataclass
class SomModel:
    """Codebooks by model key with the grid they live on."""

    xdim: int
    ydim: int
    codes: dict[object, np.ndarray]
    weights: np.ndarray | None = None
    model: str | None = None
    metaclusters: dict[object, np.ndarray] = field(default_factory=dict)
    shipped_numbers: int = SHIPPED_NUMBERS

    def transform(self, events: DataFrame, x: str = "x", node: str = "node_id", distance: str = "distance") -> DataFrame:
        """Events with their node, distance and, once known, metacluster."""
        if self.model is None and self.weights is None:
            out = nearest_code(events, self.codes[None], x=x, node=node, distance=distance)
        else:
            out = self._in_groups(events, x, node, distance)
        return out if not self.metaclusters else out.join(self._labels(out), [*([self.model] if self.model else []), node], "left")

    def _labels(self, like: DataFrame) -> DataFrame:
        rows = [(k, i, int(m)) for k, labels in self.metaclusters.items() for i, m in enumerate(labels)]
        fields = [T.StructField("node_id", T.LongType()), T.StructField("metacluster", T.IntegerType())]
        if self.model is None:
            rows = [r[1:] for r in rows]
        else:
            fields = [like.schema[self.model], *fields]
        # a local relation, whose size is known
        return as_model(like.sparkSession.createDataFrame(rows, T.StructType(fields)))

    def _in_groups(self, events: DataFrame, x: str, node: str, distance: str) -> DataFrame:
        """Assign with as many codebooks at a time as may travel to a task."""
        size = next(iter(self.codes.values())).size
        held = max(1, self.shipped_numbers // size)
        keys = list(self.codes)
        if len(keys) <= held:
            return self._keyed(events, x, node, distance)
        out = None
        for i in range(0, len(keys), held):
            group = keys[i:i + held]
            part = replace(self, codes={k: self.codes[k] for k in group})
            mine = F.col(self.model).isin(group)
            if i == 0:  # and the events of models that were not trained
                mine = F.coalesce(mine, F.lit(True)) | ~F.col(self.model).isin(keys)
            found = part._keyed(events.where(mine), x, node, distance)
            out = found if out is None else out.unionByName(found)
        return out

    def _keyed(self, events: DataFrame, x: str, node: str, distance: str) -> DataFrame:
        keep = [c for c in events.columns if c != x]
        schema = T.StructType([events.schema[c] for c in keep] + [T.StructField(node, T.LongType()), T.StructField(distance, T.DoubleType())])
        sent = events.sparkSession.sparkContext.broadcast((self.codes, self.weights))
        at = keep.index(self.model) if self.model else None

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books, weights = sent.value
            for batch in batches:
                m = matrix_of(batch.column(len(keep)))
                m = m if weights is None or not len(m) else m * weights
                best, dist = np.zeros(len(m), dtype="int64"), np.full(len(m), np.nan)
                for key, rows in _rows_by_key(batch, at):
                    book = books.get(key)
                    if book is not None and len(rows):
                        best[rows] = squared_distances(m[rows], book).argmin(axis=1)
                        dist[rows] = np.sqrt(((m[rows] - book[best[rows]]) ** 2).sum(axis=1))
                columns = [batch.column(i) for i in range(len(keep))]
                # an event of a model that was not trained has no node
                none = np.isnan(dist)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(best, mask=none), pa.array(dist, mask=none)], names=[f.name for f in schema])

        return events.select(*keep, x).mapInArrow(assign, schema)

    def codebook(self, spark) -> DataFrame:
        """Rows (model_id, node_id, grid_x, grid_y, code[, metacluster])."""
        rows = []
        for key, book in self.codes.items():
            labels = self.metaclusters.get(key)
            for i, code in enumerate(book):
                meta = None if labels is None else int(labels[i])
                rows.append((str(key), i, i % self.xdim, i // self.xdim, [float(v) for v in code], meta))
        return spark.createDataFrame(rows, "model_id string, node_id long, grid_x int, grid_y int, code array<double>, metacluster int")


def _rows_by_key(batch: pa.RecordBatch, at: int | None):
    if at is None:
        yield None, np.arange(batch.num_rows)
        return
    encoded = batch.column(at).dictionary_encode()
    index = encoded.indices.to_numpy(zero_copy_only=False)
    for i, key in enumerate(encoded.dictionary.to_pylist()):
        yield key, np.nonzero(index == i)[0]


def _packed(rows: DataFrame, x: str) -> DataFrame:
    """The rows of a map with their number as blocks of doubles, persisted; an epoch reads a block as it lies."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                block = np.column_stack([matrix_of(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)]).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], pa.binary())], names=["block"])

    return rows.select(x, "_n").mapInArrow(pack, "block binary").persist()


def _epoch_sums(events: DataFrame, books: dict, weights, model: str | None, x: str, d: int, blocks: DataFrame | None = None) -> dict:
    """Event count and vector sum of every node, by model.

    ``events`` holds distinct rows with their number ``_n``.  Without a
    ``model`` column every row takes part in every one of the books, and
    ``blocks`` holds the same rows as :func:`_packed` does.
    """
    sent = events.sparkSession.sparkContext.broadcast((books, weights))
    kind = events.schema[model].dataType if model else T.IntegerType()
    key_type = to_arrow_type(kind)
    schema = T.StructType(
        [T.StructField("m", kind), T.StructField("node", T.LongType()), T.StructField("n", T.LongType())]
        + [T.StructField(f"s{i}", T.DoubleType()) for i in range(d)])

    def pieces(batch: pa.RecordBatch, keys) -> Iterator[tuple]:
        if model:
            m, copies = matrix_of(batch.column(2)), batch.column(1).to_numpy(zero_copy_only=False)
            for key, rows in _rows_by_key(batch, 0):
                yield key, m[rows], copies[rows]
            return
        for block in batch.column(0):
            held = np.frombuffer(block.as_buffer(), float).reshape(-1, d + 1)
            for key in keys:
                yield key, held[:, :d], held[:, d]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, w = sent.value
        sums = {k: np.zeros((len(c), d)) for k, c in codes.items()}
        sizes = {k: np.zeros(len(c), dtype="int64") for k, c in codes.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            for key, m, copies in pieces(batch, codes):
                if key in codes and len(m):
                    m = m if w is None else m * w
                    best, k = nearest(m, codes[key]), len(codes[key])
                    sizes[key] += np.bincount(best, weights=copies, minlength=k).astype("int64")
                    for i in range(d):
                        sums[key][:, i] += np.bincount(best, weights=m[:, i] * copies, minlength=k)
        for key, n in sizes.items():
            used = np.nonzero(n)[0]
            if len(used):
                keys = pa.array([key] * len(used), type=key_type)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(used), pa.array(n[used])] + [pa.array(sums[key][used, i]) for i in range(d)],
                    names=[f.name for f in schema])

    read = events.select(model, "_n", x) if model else blocks
    partial = read.mapInArrow(reduce, schema)
    # the sums of few tasks are added up here, those of many meet in a shuffle first
    if model or blocks.rdd.getNumPartitions() * sum(c.size for c in books.values()) > SHIPPED_NUMBERS:
        partial = partial.groupBy("m", "node").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(d)])
    table = partial.toArrow()
    out = {k: (np.zeros(len(c)), np.zeros((len(c), d))) for k, c in books.items()}
    places: dict = {}
    for i, key in enumerate(table.column("m").to_pylist()):
        places.setdefault(key, []).append(i)
    node, number, *sums = [c.to_numpy() for c in table.columns[1:]]
    for key, at in places.items():
        np.add.at(out[key][0], node[at], number[at])
        for i in range(d):
            np.add.at(out[key][1][:, i], node[at], sums[i][at])
    return out


def neighbourhood(grid: np.ndarray, radius: float) -> np.ndarray:
    """Gaussian pull between nodes; the node alone once the radius is small."""
    return np.exp(-0.5 * (grid / radius) ** 2) if radius > 0.5 else (grid == 0).astype(float)


def _moved(book: np.ndarray, n: np.ndarray, s: np.ndarray, grid: np.ndarray, radius: float) -> np.ndarray:
    near = neighbourhood(grid, radius)
    mass = near @ n
    return np.where(mass[:, None] > 0, (near @ s) / np.where(mass > 0, mass, 1.0)[:, None], book)


def fit_som(
    events: DataFrame, *, x: str = "x", key: Sequence[str] = ("event_id",), model: str | None = None, xdim: int = 10, ydim: int = 10,
    epochs: int | None = None, weights: Sequence[float] | None = None, seed: int = 42, tol: float = 0.0,
    shipped_numbers: int = SHIPPED_NUMBERS, rows: DataFrame | None = None,
) -> SomModel:
    """Train one map, or one per ``model`` key, over all events.

    Codes start as distinct-row samples in hash order; the neighbourhood
    shrinks from the 0.67 quantile of the grid distances to the node itself.
    ``rows`` are the same events as :func:`sizing.folded` holds them, where the
    caller has them; the events then only give the start.
    """
    # the keys only pick the start, they need not be cached
    source = folded(events.select(*([model] if model else []), x)) if rows is None else rows
    try:
        n, d = source.agg(F.sum("_n"), F.max(F.size(x))).first()
        by = [model] if model else []
        models = source.select(model).distinct().count() if model else 1
        held = max(1, shipped_numbers // (xdim * ydim * d))
        if models > held:
            # the codebooks of all models do not fit a task: train groups of them
            keys = sorted(r[0] for r in model_rows(source.select(model).distinct().where(F.col(model).isNotNull())))
            groups = [keys[i:i + held] for i in range(0, len(keys), held)]
            fits = [fit_som(events.where(F.col(model).isin(g)), x=x, key=key, model=model, xdim=xdim, ydim=ydim, epochs=epochs,
                            weights=weights, seed=seed, tol=tol, shipped_numbers=shipped_numbers,
                            rows=None if rows is None else rows.where(F.col(model).isin(g))) for g in groups]
            joined = {k: c for f in fits for k, c in f.codes.items()}
            return SomModel(xdim, ydim, joined, fits[0].weights, model, shipped_numbers=shipped_numbers)
        w = None if weights is None else np.asarray(weights, dtype=float)
        # at most `held` models are trained at once, so the start is bounded like the codebooks themselves
        books = _start(events, x, key, by, xdim * ydim, d, w, seed, max(models, 1))
        books = _train(source, books, w, model, x, d, grid_distances(xdim, ydim), epochs or epochs_for(n // max(models, 1)), tol)
        return SomModel(xdim, ydim, books, w, model)
    finally:
        if rows is None:
            source.unpersist()


def fit_soms(
    events: DataFrame, seeds: Sequence[int], *, x: str = "x", key: Sequence[str] = ("event_id",), xdim: int = 10, ydim: int = 10,
    epochs: int | None = None, tol: float = 0.0, shipped_numbers: int = SHIPPED_NUMBERS, rows: DataFrame | None = None,
) -> list[SomModel]:
    """One map per seed over the same events, as :func:`fit_som` trains each; an epoch of all maps is one job.

    ``rows`` are the events with their number, as for :func:`fit_som`.
    """
    source = folded(events.select(x)) if rows is None else rows
    try:
        n, d = source.agg(F.sum("_n"), F.max(F.size(x))).first()
        held, fitted = max(1, shipped_numbers // (xdim * ydim * d)), []
        for i in range(0, len(seeds), held):
            books = dict(enumerate(_starts(events, x, key, seeds[i:i + held], xdim * ydim, d, n)))
            books = _train(source, books, None, None, x, d, grid_distances(xdim, ydim), epochs or epochs_for(n), tol)
            fitted += [SomModel(xdim, ydim, {None: books[b]}) for b in sorted(books)]
        return fitted
    finally:
        if rows is None:
            source.unpersist()


def _book(rows: list, nodes: int, d: int, weights=None) -> np.ndarray:
    """Start of a map from its (key, vector) rows, repeated where these are fewer than the nodes."""
    first = np.array([v for _, v in sorted(rows)], dtype=float)
    return np.resize(first if weights is None else first * weights, (nodes, d))


def _start(events: DataFrame, x: str, key: Sequence[str], by: Sequence[str], nodes: int, d: int, weights, seed: int, models: int) -> dict:
    """Codebooks of the first rows in hash order, repeated where a map has fewer rows than nodes."""
    seeds_from = events.select(*dict.fromkeys([*key, *by, x]))
    start = smallest(seeds_from, by, nodes, hash_order(*key, seed=seed), ties=list(key))
    seeds: dict = {}
    for r in model_rows(start, models * nodes):
        seeds.setdefault(r[by[0]] if by else None, []).append((tuple(str(r[k]) for k in key), r[x]))
    return {k: _book(rows, nodes, d, weights) for k, rows in seeds.items()}


def _starts(events: DataFrame, x: str, key: Sequence[str], seeds: Sequence[int], nodes: int, d: int, n: int) -> list[np.ndarray]:
    """What :func:`_start` gives for every seed, from one pass over the ``n`` events.

    Rows are ranked below a bound on their hash that leaves some more than a map has nodes.  A seed that finds
    fewer there (keys that repeat do not spread evenly) gets a pass of its own.
    """
    margin = nodes + 8 * math.ceil(math.sqrt(nodes)) + 40
    bound = "g" if n <= 4 * margin else f"{(margin << 32) // n:08x}"
    rows, orders = events.select(*dict.fromkeys([*key, x])), [hash_order(*key, seed=s) for s in seeds]
    # exploded before they are cut: a filter below would work out the key anew for every seed
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("_b"), o.alias("_h")) for b, o in enumerate(orders)]))
    drawn = rows.withColumn("_e", each).select(*rows.columns, "_e.*").where(F.col("_h") < bound)
    # Spark cuts the rows of a seed before the shuffle
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", *key))
    found: list[list] = [[] for _ in seeds]
    for r in model_rows(drawn.withColumn("_k", place).where(F.col("_k") <= nodes), len(seeds) * nodes):
        found[r["_b"]].append((tuple(str(r[k]) for k in key), r[x]))
    return [_book(f, nodes, d) if len(f) >= min(nodes, n) else _start(events, x, key, [], nodes, d, None, s, 1)[None] for f, s in zip(found, seeds)]


def _train(source: DataFrame, books: dict, weights, model: str | None, x: str, d: int, grid: np.ndarray, rounds: int, tol: float) -> dict:
    """Codebooks after the epochs; a map that no longer moves takes no further part."""
    top = float(np.quantile(grid, START_QUANTILE))
    moving, done = dict(books), {}
    blocks = _packed(source, x) if model is None else None
    try:
        for e in range(rounds):
            radius = top * (1 - e / max(rounds - 1, 1))
            # a single map without a key column goes by the number 0
            sent = {0: moving[None]} if None in moving and model is None else moving
            sums = _epoch_sums(source, sent, weights, model, x, d, blocks)
            for k, book in list(moving.items()):
                moving[k] = _moved(book, *sums[k if sent is moving else 0], grid, radius)
                if radius <= 0.5 and float(np.abs(moving[k] - book).max()) <= tol:
                    done[k] = moving.pop(k)
            if not moving:
                break
    finally:
        if blocks is not None:
            blocks.unpersist()
    fitted = {**moving, **done}
    return {k: fitted[k] for k in books}


def fit_kmeans_codebook(events: DataFrame, *, x: str = "x", xdim: int = 10, ydim: int = 10, seed: int = 42, iterations: int = 20) -> SomModel:
    """Codebook by distributed k-means, for the k-means backend of the map."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    source = folded(events.select(x))
    try:
        data = source.select(array_to_vector(F.col(x)).alias("features"), F.col("_n").cast("double").alias("weight"))
        fitted = KMeans(k=xdim * ydim, seed=seed, maxIter=iterations, weightCol="weight").fit(data)
    finally:
        source.unpersist()
    codes = np.array([c for c in fitted.clusterCenters()], dtype=float)
    return SomModel(xdim, ydim, {None: codes})


def outlier_limits(reference: DataFrame, deviations: Mapping[str, "str | Column"], *, node: str = "node_id", factor: float = 4.0) -> DataFrame:
    """Per node and deviation: median + factor * MAD of the reference, in long form (node, name, threshold).

    Two passes serve all deviations; the limits are one small model.
    """
    from marrowgrid.operators.quantiles import medians
    from marrowgrid.operators.sizing import as_model

    value = {n: F.col(c) if isinstance(c, str) else c for n, c in deviations.items()}
    held = reference.select(node, *[v.alias(f"_d{i}") for i, v in enumerate(value.values())])
    middle = as_model(medians(held, [node], {f"_m{i}": f"_d{i}" for i in range(len(value))}))
    spread = medians(held.join(middle, node), [node], {f"_s{i}": F.abs(F.col(f"_d{i}") - F.col(f"_m{i}")) for i in range(len(value))})
    limits = F.array(*[F.struct(F.lit(n).alias("name"), (F.col(f"_m{i}") + factor * F.col(f"_s{i}")).alias("threshold")) for i, n in enumerate(value)])
    return as_model(middle.join(spread, node).select(node, F.explode(limits).alias("l")).select(node, "l.name", "l.threshold"))


def flag_outliers(reference: DataFrame, new: DataFrame, *, node: str = "node_id", distance: str = "distance", factor: float = 4.0) -> DataFrame:
    """Per node: limit median + factor * MAD of the reference, hits and maximum among new events.

    A node that the reference never reached has limit 0, so all that lies off its code is an outlier.
    """
    limits = outlier_limits(reference, {"distance": distance}, node=node, factor=factor).select(node, "threshold")
    scored = new.join(limits, node, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0))).groupBy(node).agg(
        F.first("threshold").alias("threshold"), F.count("*").alias("n"),
        F.count_if(F.col(distance) > F.col("threshold")).alias("n_outliers"), F.max(distance).alias("max_distance"))
    return scored


def channel_outliers(
    reference: DataFrame, new: DataFrame, codes: DataFrame, channels: Sequence[str], *, node: str = "node_id", factor: float = 4.0,
    by: Sequence[str] = (),
) -> DataFrame:
    """(by, node, channel, threshold, n, n_outliers): events whose single channel lies too far from their node's code.

    ``codes`` holds the channels of every node.  Limits come from the reference as in :func:`flag_outliers`; ``by``
    splits the counts, for example by file.
    """
    book = codes.select(node, *[F.col(c).alias(f"_code_{c}") for c in channels])
    deviation = {c: F.abs(F.col(c) - F.col(f"_code_{c}")) for c in channels}
    limits = outlier_limits(reference.join(book, node), deviation, node=node, factor=factor)
    wide = limits.groupBy(node).pivot("name", list(channels)).agg(F.first("threshold")).select(node, *[F.col(c).alias(f"_limit_{c}") for c in channels])
    limit = {c: F.coalesce(F.col(f"_limit_{c}"), F.lit(0.0)) for c in channels}
    met = new.join(book, node).join(wide, node, "left")
    counted = met.groupBy(*by, node).agg(
        F.count("*").alias("n"), *[F.count_if(deviation[c] > limit[c]).alias(f"_n_{c}") for c in channels],
        *[F.first(limit[c]).alias(f"_t_{c}") for c in channels])
    each = F.explode(F.array(*[
        F.struct(F.lit(c).alias("channel"), F.col(f"_t_{c}").alias("threshold"), F.col("n"), F.col(f"_n_{c}").alias("n_outliers")) for c in channels]))
    return counted.select(*by, node, each.alias("c")).select(*by, node, "c.*")


def outlier_grid(reference: DataFrame, new: DataFrame, sample: str, nodes: int, *, node: str = "node_id", distance: str = "distance", factor: float = 4.0) -> DataFrame:
    """(sample, node, n, n_outliers) for every file and every node of the map, zeros included."""
    limits = outlier_limits(reference, {"distance": distance}, node=node, factor=factor).select(node, "threshold")
    counted = new.join(limits, node, "left").groupBy(sample, node).agg(
        F.count("*").alias("n"), F.count_if(F.col(distance) > F.coalesce("threshold", F.lit(0.0))).alias("n_outliers"))
    grid = new.select(sample).distinct().withColumn(node, F.explode(F.sequence(F.lit(0), F.lit(nodes - 1)).cast(T.ArrayType(new.schema[node].dataType))))
    return grid.join(counted, [sample, node], "left").na.fill(0, ["n", "n_outliers"])
