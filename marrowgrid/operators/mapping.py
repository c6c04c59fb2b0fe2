"""Node to reference-population mapping by several distances.

Nodes and populations are long tables (entity, marker, v); one equality join
on the marker and one aggregation give every distance at once.  Populations
are a model; nodes may belong to many patients (``by``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrowgrid.operators.neighbors import knn
from marrowgrid.operators.selection import hash_order, smallest
from marrowgrid.operators.sizing import as_model

# Metrics, weight of scatter channels, prior and threshold limits.
METRICS = tuple(f"M{i}" for i in range(1, 13))
SCATTER_WEIGHT, ASINH_COFACTOR, HARD_LIMIT, MIN_ASSIGNED = 0.3, 5.0, 5.0, 0.30
OTSU_BINS, MAD_FACTOR, NEIGHBOURS, POOL_ROWS, POOL_MIN = 64, 2.0, 15, 15_000, 50
UNKNOWN = "Unknown"
#: part of the largest variance that the ridge adds, and cells of a population's uniform sample
RIDGE, SAMPLE_ROWS = 1e-4, 2_000


def population_reference(cells: DataFrame, population: str, markers: Sequence[str], ridge: float = 0.0) -> DataFrame:
    """Long reference (population, n_cells, marker, v, var): mean and diagonal covariance.

    ``ridge`` adds ridge * max(variance, 1) to each variance.
    """
    complete = cells.na.drop(subset=list(markers))
    wide = complete.groupBy(F.col(population).cast("string").alias("population")).agg(
        F.count("*").alias("n_cells"), *[F.struct(F.avg(m).alias("v"), F.var_samp(m).alias("s")).alias(m) for m in markers])
    rows = [F.struct(F.lit(m).alias("marker"), F.col(f"{m}.v").alias("v"),
                     (F.col(f"{m}.s") + ridge * F.greatest(F.col(f"{m}.s"), F.lit(1.0))).alias("var")) for m in markers]
    return wide.select("population", "n_cells", F.explode(F.array(*rows)).alias("_r")).select("population", "n_cells", "_r.*")


def population_statistics(
    cells: DataFrame, population: str, markers: Sequence[str], key: Sequence[str], *, ridge: float = RIDGE, sample_rows: int = SAMPLE_ROWS,
    transform: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Reference of every population and a uniform sample of its cells.

    The reference is long (population, n_cells, marker, v, var): one aggregation of mergeable moments.  The ridge keeps
    the covariance regular: ``ridge`` times the population's largest variance, at least 1, is added to each.  The
    sample has the ``sample_rows`` cells of each population whose hashed ``key`` is smallest, so it does not depend on
    partitions.  Cells with a missing marker are left out of both.
    """
    complete = cells.na.drop(subset=list(markers))
    if transform is not None:
        complete = complete.withColumns({m: transform(F.col(m)) for m in markers})
    wide = complete.groupBy(F.col(population).cast("string").alias("population")).agg(
        F.count("*").alias("n_cells"), *[F.struct(F.avg(m).alias("v"), F.var_samp(m).alias("s")).alias(m) for m in markers])
    spread = [F.coalesce(F.col(f"{m}.s"), F.lit(0.0)) for m in markers]
    added = ridge * F.greatest(*spread, F.lit(1.0))
    rows = [F.struct(F.lit(m).alias("marker"), F.col(f"{m}.v").alias("v"), (s + added).alias("var")) for m, s in zip(markers, spread)]
    reference = wide.select("population", "n_cells", F.explode(F.array(*rows)).alias("_r")).select("population", "n_cells", "_r.*")
    named = complete.select(F.col(population).cast("string").alias("population"), *key, *markers)
    return reference, smallest(named, ["population"], sample_rows, hash_order(*key), ties=list(key))


def vector_reference(vectors: DataFrame, population: str, x: str = "x") -> DataFrame:
    """The same reference from array columns; the marker is the position."""
    long = vectors.select(F.col(population).cast("string").alias("population"), F.posexplode(x).alias("marker", "value"))
    return long.groupBy("population", F.col("marker").cast("string").alias("marker")).agg(
        F.count("*").alias("n_cells"), F.avg("value").alias("v"), F.var_samp("value").alias("var"))


def _nonzero(value: Column) -> Column:
    return F.when(value == 0, 1.0).otherwise(value)


def node_distances(nodes: DataFrame, populations: DataFrame, by: Sequence[str] = (), node: str = "node_id", normalization: str = "range") -> DataFrame:
    """(by, node, population, n_cells, M1..M6, M8, M10) from long tables."""
    frame = Window.partitionBy(*by, "marker")
    asinh = F.asinh(F.col("v") / ASINH_COFACTOR)
    scaled = nodes.withColumns({
        "lo": F.min("v").over(frame), "hi": F.max("v").over(frame),
        "mean": F.avg("v").over(frame), "sd": F.stddev_pop("v").over(frame),
        "p10": F.percentile("v", F.lit(0.1)).over(frame), "p90": F.percentile("v", F.lit(0.9)).over(frame),
        "alo": F.min(asinh).over(frame), "ahi": F.max(asinh).over(frame)})
    ref = Window.partitionBy("marker")
    model = as_model(populations.select(
        "population", "n_cells", "marker", F.col("v").alias("p"), "var",
        _nonzero(F.max("v").over(ref) - F.min("v").over(ref)).alias("ref_range")))
    pair = scaled.join(model, "marker")
    v, p = F.col("v"), F.col("p")
    if normalization == "range":
        unit = _nonzero(F.col("hi") - F.col("lo"))
        xn, pn = (v - F.col("lo")) / unit, F.greatest((p - F.col("lo")) / unit, F.lit(0.0))
    elif normalization == "zscore":
        unit = _nonzero(F.col("sd"))
        xn, pn = (v - F.col("mean")) / unit, (p - F.col("mean")) / unit
    else:
        unit, xn, pn = F.lit(1.0), v, p
    xa, pa = F.greatest(xn, F.lit(0.0)), F.greatest(pn, F.lit(0.0))
    aspan = _nonzero(F.col("ahi") - F.col("alo"))
    x5 = (asinh - F.col("alo")) / aspan
    p5 = F.greatest((F.asinh(p / ASINH_COFACTOR) - F.col("alo")) / aspan, F.lit(0.0))
    robust = _nonzero(F.col("p90") - F.col("p10"))
    weight = F.when(F.upper("marker").rlike("^(FSC|SSC)"), SCATTER_WEIGHT).otherwise(1.0)

    def root(term: Column) -> Column:
        return F.sqrt(F.sum(term * term))

    out = pair.groupBy(*by, node, "population", "n_cells").agg(
        root(xn - pn).alias("M1"), F.sum(F.abs(xn - pn)).alias("M2"),
        (1 - F.coalesce(F.try_divide(F.sum(xa * pa), F.sqrt(F.sum(xa * xa)) * F.sqrt(F.sum(pa * pa))), F.lit(0.0))).alias("M3"),
        root((v - p) / robust).alias("M4"), root(x5 - p5).alias("M5"), root(weight * (xn - pn)).alias("M6"),
        root((v - p) / F.col("ref_range")).alias("M8"),
        # a marker without variance counts by its plain distance
        F.sqrt(F.sum((xn - pn) * (xn - pn) * F.coalesce(F.try_divide(unit * unit, F.col("var")), F.lit(1.0)))).alias("M10"))
    return out


def prior_weight(n_cells: Column, mode: str, total: Column | None = None, populations: Column | None = None) -> Column:
    """Prevalence weight; ``linear`` needs all cells and the number of populations."""
    log = F.log10(F.greatest(n_cells, F.lit(10)))
    weight = {"log10_cubed": F.pow(log, F.lit(3.0)), "log10": log, "none": F.lit(1.0)}.get(mode)
    if mode == "linear":  # cells over the mean of all populations
        weight = F.greatest(n_cells, F.lit(1)) / F.greatest(total / populations, F.lit(1))
    if weight is None:
        raise ValueError(f"unknown prior {mode}")
    return F.greatest(weight, F.lit(1e-9))


def with_prior(distance: Column, mode: str, *, n_cells: str = "n_cells", size: str = "size", factor: float = HARD_LIMIT, by: Sequence[str] = (), node: str = "node_id") -> Column:
    """Distance over the prevalence weight; infinite when the node is larger
    than the population can fill.

    The row set must be complete: one row per (node, population).
    """
    everything = Window.partitionBy(*(by or [F.lit(0)]))
    per_node = Window.partitionBy(*by, node)
    total_cells = F.sum(n_cells).over(per_node)
    # every node size occurs once per population
    total_size = F.sum(size).over(everything) / F.count("*").over(per_node)
    limit = F.col(n_cells) / F.greatest(total_cells, F.lit(1)) * total_size * factor
    return F.when(F.col(size) > limit, F.lit(float("inf"))).otherwise(
        distance / prior_weight(F.col(n_cells), mode, F.greatest(total_cells, F.lit(1)), F.count("*").over(per_node)))


def all_metrics(
    nodes: DataFrame, populations: DataFrame, sizes: DataFrame, by: Sequence[str] = (), node: str = "node_id",
    votes: DataFrame | None = None,
) -> DataFrame:
    """Long distances (by, node, population, method, dist) of the twelve metrics.

    ``votes`` are the (node, population, dist) winners of :func:`knn_vote`;
    without them M11 falls back to M3.  A vote names one population, all
    others are infinitely far.
    """
    wide = node_distances(nodes, populations, by, node).join(as_model(sizes.select(*by, node, "size")), [*by, node])
    per_node = Window.partitionBy(*by, node)
    last = F.greatest(F.count("*").over(per_node) - 1, F.lit(1))

    def rank(metric: str) -> Column:
        return F.row_number().over(per_node.orderBy(metric, "population")) - 1

    wide = wide.withColumns({
        # integer ranks first, so equal rank sums stay equal
        "M7": (rank("M2") + rank("M3") + rank("M8")) / last,
        "M9": with_prior(F.col("M8"), "log10", by=by, node=node),
        "M12": with_prior(F.col("M3"), "log10_cubed", by=by, node=node)})
    if votes is None:
        wide = wide.withColumn("M11", F.col("M3"))
    else:
        wide = wide.join(as_model(votes.withColumnRenamed("dist", "_vote")), [*by, node, "population"], "left")
        wide = wide.withColumn("M11", F.coalesce("_vote", F.lit(float("inf"))))
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("dist")) for m in METRICS]))
    return wide.select(*by, node, "population", rows.alias("_r")).select(*by, node, "population", "_r.*")


def best_population(distances: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Closest population per key; the first name wins ties."""
    low = F.min(F.struct("dist", "population"))
    return distances.groupBy(*keys).agg(low.alias("_b")).select(
        *keys, F.col("_b.population").alias("best_pop"), F.col("_b.dist").alias("best_dist"))


def otsu_threshold(values: DataFrame, by: Sequence[str], value: str, bins: int = OTSU_BINS) -> DataFrame:
    """Threshold of largest between-class variance on a histogram per group."""
    frame = Window.partitionBy(*by)
    spread = values.withColumn("_a", F.min(value).over(frame)).withColumn("_z", F.max(value).over(frame))
    flat = F.col("_z") == F.col("_a")
    spread = spread.withColumn("_lo", F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a"))).withColumn(
        "_w", F.when(flat, 1.0).otherwise(F.col("_z") - F.col("_a")) / bins)
    spot = F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_w")), F.lit(bins - 1))
    hist = spread.groupBy(*by, "_lo", "_w", spot.alias("_bin")).agg(F.count("*").alias("_c"))
    hist = hist.withColumn("_x", F.col("_lo") + (F.col("_bin") + 0.5) * F.col("_w"))
    run = frame.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, nx = F.sum("_c").over(frame), F.sum(F.col("_c") * F.col("_x")).over(frame)
    c, cx = F.sum("_c").over(run), F.sum(F.col("_c") * F.col("_x")).over(run)
    gap = cx / c - (nx - cx) / (n - c)
    between = F.when(n > c, c / n * (1 - c / n) * gap * gap).otherwise(0.0)
    scored = hist.withColumn("_var", between)
    best = F.max(F.struct(F.round("_var", 12).alias("v"), (-F.col("_bin")).alias("b")))
    found = scored.groupBy(*by, "_lo", "_w").agg(best.alias("_m"))
    pick = F.when(F.col("_m.v") > 0, -F.col("_m.b")).otherwise(F.lit(0))
    return found.select(*by, (F.col("_lo") + (pick + 0.5) * F.col("_w")).alias("threshold"))


def unknown_threshold(best: DataFrame, by: Sequence[str], mode: str = "auto_otsu", percentile: float = 70.0, value: str = "best_dist") -> DataFrame:
    """Distance above which a node stays Unknown, per group."""
    finite = best.where(F.col(value) < float("inf"))
    d = F.col(value)
    if mode == "auto_otsu":
        return otsu_threshold(finite, by, value)
    if mode == "mad":
        frame = Window.partitionBy(*by)
        off = finite.withColumn("_m", F.percentile(d, F.lit(0.5)).over(frame)).withColumn("_o", F.abs(d - F.col("_m")))
        return off.groupBy(*by).agg((F.first("_m") + MAD_FACTOR * 1.4826 * F.percentile("_o", F.lit(0.5))).alias("threshold"))
    quart = F.percentile(d, F.lit(0.75))
    made = {
        "mean_std": F.avg(d) + F.stddev_pop(d),
        "median_iqr": quart + 1.5 * (quart - F.percentile(d, F.lit(0.25))),
    }.get(mode, F.percentile(d, F.lit(percentile / 100)))
    return finite.groupBy(*by).agg(made.alias("threshold"))


def assign_populations(
    distances: DataFrame, by: Sequence[str], node: str = "node_id", mode: str = "auto_otsu", percentile: float = 70.0,
    min_assigned: float = MIN_ASSIGNED, fallback_percentile: float | None = None,
) -> DataFrame:
    """Best population per node with the Unknown rule.

    When fewer than ``min_assigned`` of a group's nodes are assigned the
    threshold becomes the (fallback) percentile.
    """
    best = as_model(best_population(distances, [*by, node]))
    first = unknown_threshold(best, by, mode, percentile)
    second = unknown_threshold(best, by, "percentile", fallback_percentile or percentile).withColumnRenamed("threshold", "_alt")
    share = F.avg((F.col("best_dist") <= F.col("threshold")).cast("double")).over(Window.partitionBy(*by))
    joined = best.join(as_model(first), list(by)).join(as_model(second), list(by)).withColumn("_share", share)
    joined = joined.withColumn("threshold", F.when(F.col("_share") < min_assigned, F.col("_alt")).otherwise(F.col("threshold")))
    inside = (F.col("best_dist") < float("inf")) & (F.col("best_dist") <= F.col("threshold"))
    return joined.withColumn("assigned_pop", F.when(inside, F.col("best_pop")).otherwise(UNKNOWN)).drop("_alt", "_share")


def benchmark(assigned: DataFrame, by: Sequence[str] = (), method: str = "method") -> DataFrame:
    """Score of each metric: distinct populations times assigned fraction; ``chosen`` marks the best."""
    known = F.col("assigned_pop") != UNKNOWN
    scored = assigned.groupBy(*by, method).agg(
        F.count_distinct(F.when(known, F.col("assigned_pop"))).alias("n_pops"), F.avg(known.cast("double")).alias("fraction"))
    scored = scored.withColumn("score", F.col("n_pops") * F.col("fraction"))
    number = F.regexp_extract(method, r"(\d+)$", 1).cast("int")
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("score"), number)
    return scored.withColumn("chosen", F.row_number().over(order) == 1)


def stratified_pool(samples: DataFrame, population: str, order: Column, total: int = POOL_ROWS, minimum: int = POOL_MIN) -> DataFrame:
    """Rows per population in proportion to its size, at least ``minimum``."""
    sizes = as_model(samples.groupBy(population).agg(F.count("*").alias("_n")))
    whole = sizes.agg(F.sum("_n")).first()[0]
    quota = F.greatest(F.lit(minimum), F.floor(F.lit(total) * F.col("_n") / F.lit(whole)))
    return smallest(samples.join(sizes, population), [population], quota, order).select(*samples.columns)


def knn_vote(nodes: DataFrame, pool: DataFrame, *, node: str = "node_id", pool_id: str = "pool_id", population: str = "population", k: int = NEIGHBOURS) -> DataFrame:
    """Majority population among the k nearest pool rows and the distance of the nearest."""
    found = knn(nodes, pool, k, query_id=node, base_id=pool_id, exclude_same=False)
    named = found.join(pool.select(pool_id, F.col(population).cast("string").alias("population")), pool_id)
    votes = named.groupBy(node, "population").agg(F.count("*").alias("n"))
    near = named.groupBy(node).agg(F.min("distance").alias("dist"))
    order = Window.partitionBy(node).orderBy(F.desc("n"), "population")
    won = votes.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(node, "population")
    return won.join(near, node)


def map_nearest(nodes: DataFrame, populations: DataFrame, by: Sequence[str] = (), node: str = "node_id", percentile: float = 60.0, normalization: str = "range") -> DataFrame:
    """Closest population by euclidean distance; Unknown above the percentile."""
    wide = node_distances(nodes, populations, by, node, normalization)
    named = wide.withColumn("_g", F.lit(0)).select(*by, "_g", node, "population", F.col("M1").alias("dist"))
    best = as_model(best_population(named, [*by, "_g", node]))
    cut = unknown_threshold(best, [*by, "_g"], "percentile", percentile)
    joined = best.join(as_model(cut), [*by, "_g"])
    assigned = F.when(F.col("best_dist") <= F.col("threshold"), F.col("best_pop")).otherwise(UNKNOWN)
    return joined.withColumn("assigned_pop", assigned).drop("_g")
