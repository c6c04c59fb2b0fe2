"""Cluster, sample and condition summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrowgrid.functions.numeric import all_of, col, percent
from marrowgrid.operators.quantiles import medians, quantiles
from marrowgrid.operators.sizing import as_model


def mfi(events: DataFrame, by: Sequence[str], markers: Sequence[str], how: str = "median") -> DataFrame:
    """Median (or mean) of every marker per group."""
    if how == "mean":
        return events.groupBy(*by).agg(*[F.avg(m).alias(m) for m in markers])
    return medians(events, by, {m: m for m in markers})


def describe(events: DataFrame, by: Sequence[str], markers: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles in long form."""
    basic = events.groupBy(*by).agg(*[
        F.struct(
            F.count(m).alias("n"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"),
            F.min(m).alias("min"), F.max(m).alias("max")).alias(m)
        for m in markers])
    cuts = quantiles(events, by, {f"{m}|{q}": (m, q) for m in markers for q in (0.25, 0.5, 0.75)})
    joined = basic.join(cuts, list(by)) if by else basic.join(cuts)
    rows = [
        F.struct(
            F.lit(m).alias("marker"), F.col(f"{m}.n").alias("n"), F.col(f"{m}.mean").alias("mean"),
            F.col(f"{m}.std").alias("std"), F.col(f"{m}.min").alias("min"), F.col(f"`{m}|0.25`").alias("q25"),
            F.col(f"`{m}|0.5`").alias("median"), F.col(f"`{m}|0.75`").alias("q75"), F.col(f"{m}.max").alias("max"))
        for m in markers]
    return joined.select(*by, F.explode(F.array(*rows)).alias("_r")).select(*by, "_r.*")


def cluster_statistics(events: DataFrame, cluster: str, markers: Sequence[str]) -> DataFrame:
    """Size, share of all events (3 decimals) and marker medians."""
    sizes = events.groupBy(cluster).agg(F.count("*").alias("n_cells"))
    share = F.round(100.0 * F.col("n_cells") / F.sum("n_cells").over(Window.partitionBy(F.lit(0))), 3)
    middle = medians(events, [cluster], {f"median_{m}": m for m in markers})
    return sizes.withColumn("pct_total", share).join(middle, cluster)


def node_statistics(events: DataFrame, by: Sequence[str], markers: Sequence[str]) -> DataFrame:
    """Median, population deviation, cv = sd/|median| and MAD, long form."""
    middle = medians(events, by, {m: m for m in markers})
    middle = as_model(middle)
    spread = events.groupBy(*by).agg(F.count("*").alias("n"), *[F.stddev_pop(m).alias(f"sd|{m}") for m in markers])
    renamed = middle.select(*by, *[F.col(m).alias(f"med|{m}") for m in markers])
    off = events.join(renamed, list(by))
    mad = medians(off, by, {f"mad|{m}": F.abs(F.col(m) - F.col(f"med|{m}")) for m in markers})
    wide = renamed.join(spread, list(by)).join(mad, list(by))
    rows = [
        F.struct(
            F.lit(m).alias("marker"), F.col(f"med|{m}").alias("median"), F.col(f"sd|{m}").alias("sd"),
            F.try_divide(F.col(f"sd|{m}"), F.abs(F.col(f"med|{m}"))).alias("cv"), F.col(f"mad|{m}").alias("mad"))
        for m in markers]
    return wide.select(*by, "n", F.explode(F.array(*rows)).alias("_r")).select(*by, "n", "_r.*")


def counts_with_empty(events: DataFrame, codebook: DataFrame, key: str) -> DataFrame:
    """Size and share of every known node, zero for empty ones."""
    sizes = events.groupBy(key).agg(F.count("*").alias("n"))
    full = codebook.select(key).distinct().join(sizes, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0)))))


def percent_positive(events: DataFrame, by: Sequence[str], cutoffs: Mapping[str, float]) -> DataFrame:
    """Share of events above a cutoff per group and marker."""
    return events.groupBy(*by).agg(*[
        F.avg((F.col(m) > c).cast("double")).alias(f"pos_{m}") for m, c in cutoffs.items()])


def abundance(
    events: DataFrame, sample: str, cluster: str, clusters: Sequence, *, normalize: bool = False
) -> DataFrame:
    """Sample x cluster counts, optionally as shares of the sample."""
    long = events.groupBy(sample, cluster).agg(F.count("*").alias("n"))
    wide = long.groupBy(sample).pivot(cluster, list(clusters)).agg(F.sum("n"))
    names = [str(c) for c in clusters]
    wide = wide.select(sample, *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(f"c{n}") for n in names])
    if not normalize:
        return wide
    size = sum((F.col(f"c{n}") for n in names), F.lit(0))
    return wide.select(sample, *[F.coalesce(F.try_divide(F.col(f"c{n}"), size), F.lit(0.0)).alias(f"c{n}") for n in names])


def condition_distribution(
    events: DataFrame, cluster: str, metacluster: str | None = None, condition: str = "condition",
    sain: str = "Sain", patho: str = "Pathologique", keep: Sequence[str] = (),
) -> DataFrame:
    """Events per cluster and condition with their shares.

    With ``metacluster`` the dominant one is added: the most frequent, the
    smallest id on ties.
    """
    fine = [cluster, *keep] + ([metacluster] if metacluster else [])
    base = events.groupBy(*fine).agg(
        F.count("*").alias("n"), F.count_if(F.col(condition) == sain).alias("s"),
        F.count_if(F.col(condition) == patho).alias("p"))
    aggs = [F.sum("n").alias("n_total"), F.sum("s").alias("n_sain"), F.sum("p").alias("n_patho")]
    if metacluster:
        # the larger struct wins: most events, then the smallest id
        best = F.max(F.struct("n", (-F.col(metacluster)).alias("k")))
        aggs.append((-best["k"]).alias("metacluster"))
    out = base.groupBy(cluster, *keep).agg(*aggs)
    everything = Window.partitionBy(F.lit(0))

    def pct(part: str, whole: Column) -> Column:
        return F.round(F.col(part) / F.greatest(whole, F.lit(1)) * 100, 6)

    return out.withColumns({
        "pct_total": pct("n_total", F.sum("n_total").over(everything)),
        "pct_sain_in_cluster": pct("n_sain", F.col("n_total")),
        "pct_sain_of_sain": pct("n_sain", F.sum("n_sain").over(everything)),
        "pct_patho_in_cluster": pct("n_patho", F.col("n_total")),
        "pct_patho_of_patho": pct("n_patho", F.sum("n_patho").over(everything)),
    })


def exclusive_clusters(events: DataFrame, cluster: str, condition: str = "condition",
                       sain: str = "Sain", patho: str = "Pathologique") -> DataFrame:
    """Clusters held by one condition only, or mixed."""
    counts = events.groupBy(cluster).agg(
        F.count("*").alias("n"), F.count_if(F.col(condition) == patho).alias("p"),
        F.count_if(F.col(condition) == sain).alias("s"))
    kind = F.when(F.col("p") == F.col("n"), "patho_only").when(F.col("s") == F.col("n"), "sain_only").otherwise("mixed")
    return counts.select(cluster, "n", kind.alias("kind"))


def features(
    events: DataFrame, sample: str, node: str, metacluster: str, markers: Sequence[str], cutoffs: Mapping[str, float]
) -> DataFrame:
    """Long features per file at node and metacluster level.

    One rollup gives counts and positives of both levels; medians need their
    own pass per level.
    """
    sums = events.rollup(sample, metacluster, node).agg(
        F.count("*").alias("count"),
        *[F.avg((F.col(m) > c).cast("double")).alias(f"pos_{m}") for m, c in cutoffs.items()],
        F.grouping_id().alias("_g")).where("_g < 3")
    level = F.when(F.col("_g") == 0, "node").otherwise("metacluster")
    key = F.when(F.col("_g") == 0, F.col(node)).otherwise(F.col(metacluster))
    size = F.sum("count").over(Window.partitionBy(sample, "_g"))
    flat = sums.withColumns({"level": level, "cluster": key, "pct": F.col("count") / size})
    middle = medians(events, [sample, node], {f"mfi_{m}": m for m in markers}).withColumnRenamed(node, "cluster")
    upper = medians(events, [sample, metacluster], {f"mfi_{m}": m for m in markers})
    both = middle.withColumn("level", F.lit("node")).unionByName(
        upper.withColumnRenamed(metacluster, "cluster").withColumn("level", F.lit("metacluster")))
    wanted = [sample, "level", "cluster", "count", "pct", *[f"pos_{m}" for m in cutoffs]]
    return flat.select(*wanted).join(both, [sample, "level", "cluster"])


def sample_features(
    events: DataFrame, sample: str, cluster: str, clusters: Sequence, markers: Sequence[str]
) -> DataFrame:
    """Wide matrix: abundance of each cluster and its functional medians, 0 when absent."""
    shares = abundance(events, sample, cluster, clusters, normalize=True)
    middle = medians(events, [sample, cluster], {m: m for m in markers})
    wide = middle.groupBy(sample).pivot(cluster, list(clusters)).agg(*[F.first(m).alias(m) for m in markers])
    names = [(f"{c}_{m}" if len(markers) > 1 else str(c), f"c{c}_{m}") for c in clusters for m in markers]
    wide = wide.select(sample, *[F.coalesce(F.col(f"`{a}`"), F.lit(0.0)).alias(b) for a, b in names])
    return shares.join(wide, sample)


def gate_statistics(members: DataFrame, by: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Median and CV% (sample deviation over mean) per (group, gate, channel)."""
    keys = [*by, "gate"]
    spread = members.groupBy(*keys).agg(
        *[F.try_divide(100.0 * F.stddev_samp(c), F.avg(c)).alias(f"cv|{c}") for c in channels])
    wide = medians(members, keys, {f"med|{c}": c for c in channels}).join(spread, keys)
    rows = [F.struct(F.lit(c).alias("channel"), F.col(f"med|{c}").alias("median"), F.col(f"cv|{c}").alias("cv"))
            for c in channels]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")


def stage_flow(events: DataFrame, masks: Mapping[str, Column], file: str) -> DataFrame:
    """Rows left after each stage, per file and over all files (NULL file)."""
    names = list(masks)
    flags = events.select(file, *[all_of(masks[m] for m in names[: i + 1]).alias(n) for i, n in enumerate(names)])
    return flags.cube(file).agg(F.count("*").alias("n_start"), *[F.count_if(n).alias(f"n_{n}") for n in names])


def histogram(
    events: DataFrame, x: "str | Column", low: float, high: float, bins: int, by: Sequence[str] = ()
) -> DataFrame:
    """Equal-width counts on [low, high]; the last bin includes its upper edge."""
    x = col(x)
    width = (high - low) / bins or 1.0
    spot = F.least(F.floor((x - low) / width), F.lit(bins - 1))
    inside = events.where((x >= low) & (x <= high))
    return inside.groupBy(*by, spot.alias("bin")).agg(F.count("*").alias("n"))


def histogram2d(events: DataFrame, x: str, y: str, box: Sequence[float], bins: int) -> DataFrame:
    """Counts on a grid, values outside the box moved to its border."""
    x0, x1, y0, y1 = (float(v) for v in box)

    def spot(name: str, low: float, high: float) -> Column:
        held = F.least(F.greatest(F.col(name), F.lit(low)), F.lit(high))
        return F.least(F.floor((held - low) / ((high - low) / bins or 1.0)), F.lit(bins - 1))

    return events.groupBy(spot(x, x0, x1).alias("bx"), spot(y, y0, y1).alias("by")).agg(F.count("*").alias("n"))


def weighted_profile(nodes: DataFrame, by: Sequence[str], markers: Sequence[str], size: str) -> DataFrame:
    """Size-weighted mean of node profiles; a node weighs at least one."""
    weight = F.greatest(F.col(size), F.lit(1))
    return nodes.groupBy(*by).agg(*[(F.sum(weight * F.col(m)) / F.sum(weight)).alias(m) for m in markers])


def source_trace(events: DataFrame, candidates: DataFrame, node: str, file: str = "file_origin",
                 condition: str = "condition", patho: str = "Pathologique", alert_pct: float = 50.0) -> DataFrame:
    """Files behind each candidate node, largest contributor first."""
    candidates = as_model(candidates)
    wanted = events.join(candidates.select(node), node, "left_semi")
    parts = wanted.groupBy(node, file).agg(F.count("*").alias("n"), F.count_if(F.col(condition) == patho).alias("p"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(file).alias("f"))))
    nodes = parts.groupBy(node).agg(
        F.sum("n").alias("n_cells"), F.count("*").alias("n_files"),
        F.concat_ws(", ", F.transform(listed, lambda s: F.concat(s["f"], F.lit(":"), -s["k"]))).alias("sources"),
        (100.0 * F.sum("p") / F.sum("n")).alias("pct_patho"))
    out = candidates.join(nodes, node, "left")
    return out.withColumn("alert", (F.col("blast_score") >= 6.0) & (F.col("pct_patho") >= alert_pct)).select(
        node, "n_cells", "n_files", "sources", "pct_patho", "blast_score", "alert")
