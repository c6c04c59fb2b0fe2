"""Gates whose shape is learnt: mixtures, densities, robust lines.

All rows enter a histogram by one partial aggregation; the fit then works on
the bins, which are few whatever the number of events.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marrowgrid.functions.numeric import all_of, is_finite
from marrowgrid.operators.neighbors import SHIPPED_NUMBERS
from marrowgrid.operators.quantiles import medians, quantiles
from marrowgrid.operators.selection import smallest
from marrowgrid.operators.sizing import as_model, model_rows
from marrowgrid.session import staged

# Parameters of the learnt gates.
MIN_ROWS, MIN_FRACTION, FSC_SHARE, DENSITY_SHARE = 200, 0.02, 0.25, 0.3
LINE_MIN_ROWS, LINE_SAMPLE, LINE_R2, LINE_MAD, LINE_TRIALS, LINE_SEEDS, LINE_FLOOR = 50, 5_000, 0.85, 3.0, 100, 50, 100.0
CD45_FOOT, CD45_FINENESS, CD45_SMOOTH, CD45_GRID = 0.05, 0.6, 10, 1000
CD34_FOOT, CD34_SMOOTH, CD34_GRID = 0.12, 5.0, 512
LOG_TOP, LOG_DECADES = 262144.0, 4.5
DIM_LOW, DIM_HIGH, ALERT_MODERATE, ALERT_HIGH = 5.0, 40.0, 0.05, 0.15
FINE_BINS, PLANE_BINS = 4096, 256


# --- histograms and small numeric helpers -----------------------------------


def fine_histogram(events: DataFrame, value: Column, by: Sequence[str] = (), bins: int = FINE_BINS) -> DataFrame:
    """(by, lo, hi, bin, n) over each group's own range; finite values only."""
    held = events.select(*by, value.alias("_v")).where(is_finite("_v"))
    span = as_model(held.groupBy(*by).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    if by:
        placed = held.join(span, list(by))
    else:
        row = span.first()
        placed = held.withColumns({"lo": F.lit(row["lo"]), "hi": F.lit(row["hi"])})
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)
    spot = F.least(F.floor((F.col("_v") - F.col("lo")) / width), F.lit(bins - 1))
    return placed.groupBy(*by, "lo", "hi", spot.alias("bin")).agg(F.count("*").alias("n"))


def _centers(pdf: pd.DataFrame, bins: int = FINE_BINS) -> tuple[np.ndarray, np.ndarray, float, float]:
    lo, hi = float(pdf["lo"].iloc[0]), float(pdf["hi"].iloc[0])
    width = (hi - lo) / bins if hi > lo else 0.0
    return lo + (pdf["bin"].to_numpy() + 0.5) * width, pdf["n"].to_numpy(dtype=float), lo, hi


def _weighted_quantile(x: np.ndarray, w: np.ndarray, q: float) -> float:
    order = np.argsort(x)
    run = np.cumsum(w[order])
    return float(x[order][np.searchsorted(run, q * run[-1])])


def _smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="symmetric"), kernel / kernel.sum(), mode="valid")


def _density(x: np.ndarray, w: np.ndarray, grid: np.ndarray, bandwidth: float) -> np.ndarray:
    z = (grid[:, None] - x[None, :]) / bandwidth
    return (np.exp(-0.5 * z * z) @ w) / (w.sum() * bandwidth * math.sqrt(2 * math.pi))


def _spread(x: np.ndarray, w: np.ndarray) -> float:
    mean = np.average(x, weights=w)
    return float(np.sqrt(np.average((x - mean) ** 2, weights=w)))


def _otsu(x: np.ndarray, w: np.ndarray, lo: float, hi: float, bins: int = 512) -> float:
    counts, edges = np.histogram(x, bins=bins, range=(lo, hi), weights=w)
    mid = (edges[:-1] + edges[1:]) / 2
    low, mass = np.cumsum(counts)[:-1], np.cumsum(counts * mid)[:-1]
    total, whole = counts.sum(), (counts * mid).sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = low * (total - low) * (mass / low - (whole - mass) / (total - low)) ** 2
    return float(mid[1:][int(np.nanargmax(between))]) if np.isfinite(between).any() else float(mid[bins // 2])


def left_foot(x: np.ndarray, w: np.ndarray, lo: float, hi: float) -> tuple[float, str]:
    """Foot of the main peak on its left, Otsu when the density never drops."""
    n, sd = w.sum(), _spread(x, w)
    iqr = _weighted_quantile(x, w, 0.75) - _weighted_quantile(x, w, 0.25)
    bandwidth = 0.9 * min(sd, iqr / 1.34) * n ** (-0.2) * CD45_FINENESS if sd > 1e-12 else 0.1
    grid = np.linspace(lo, hi, CD45_GRID)
    # a bin is the finest detail the histogram has
    density = _smooth(_density(x, w, grid, max(bandwidth, (hi - lo) / FINE_BINS, 1e-12)), CD45_SMOOTH)
    peak = int(np.argmax(density))
    below = np.nonzero(density[1:peak + 1] < density.max() * CD45_FOOT)[0]
    if len(below):
        return float(grid[below[-1] + 1]), "kde_foot"
    return _otsu(x, w, lo, hi), "otsu"


def _peaks(density: np.ndarray, prominence: float) -> np.ndarray:
    inner = np.nonzero((density[1:-1] > density[:-2]) & (density[1:-1] >= density[2:]))[0] + 1
    kept = []
    for i in inner:
        higher_left = np.nonzero(density[:i] > density[i])[0]
        higher_right = np.nonzero(density[i + 1:] > density[i])[0]
        left = density[(higher_left[-1] if len(higher_left) else 0):i + 1].min()
        right = density[i:(i + 2 + higher_right[0] if len(higher_right) else len(density))].min()
        if density[i] - max(left, right) >= prominence:
            kept.append(i)
    return np.array(kept, dtype=int)


def right_foot(x: np.ndarray, w: np.ndarray, lo: float, hi: float) -> tuple[float, str]:
    """Foot of the main (negative) peak on its right with minimum-density fallbacks."""
    n, sd = w.sum(), _spread(x, w)
    bandwidth = max(sd * (n * 0.75) ** (-0.2), (hi - lo) / FINE_BINS, 1e-12)
    grid = np.linspace(lo, hi, CD34_GRID)
    density = _smooth(_density(x, w, grid, bandwidth), CD34_SMOOTH)
    top = density.max()
    peaks = _peaks(density, top * 0.08)
    if not len(peaks):
        zone = (grid >= np.percentile(grid, 30)) & (grid <= np.percentile(grid, 80))
        return float(grid[zone][np.argmin(density[zone])]), "central_minimum"
    main = peaks[np.argmax(density[peaks])]
    drop = np.nonzero(density[main:] < top * CD34_FOOT)[0]
    if len(drop):
        return float(grid[main + drop[0]]), "kde_foot"
    zone = (grid >= grid[main]) & (grid <= _weighted_quantile(x, w, 0.90))
    if zone.any():
        return float(grid[zone][np.argmin(density[zone])]), "right_minimum"
    return _weighted_quantile(x, w, 0.85), "percentile"


def two_gaussians(x: np.ndarray, w: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and shares of a two-component mixture on weighted bins."""
    mean = np.array([_weighted_quantile(x, w, 0.25), _weighted_quantile(x, w, 0.90)])
    if mean[0] == mean[1]:
        mean = np.array([x.min(), x.max()])
    floor = max(_spread(x, w) * 1e-3, 1e-9)
    sd, share = np.full(2, max(_spread(x, w) / 2, floor)), np.array([0.5, 0.5])
    for _ in range(steps):
        log = np.log(share) - np.log(sd) - 0.5 * ((x[:, None] - mean) / sd) ** 2
        resp = np.exp(log - log.max(axis=1, keepdims=True))
        resp *= (w / resp.sum(axis=1))[:, None]
        mass = np.maximum(resp.sum(axis=0), 1e-12)
        fresh = (resp * x[:, None]).sum(axis=0) / mass
        sd = np.maximum(np.sqrt((resp * (x[:, None] - fresh) ** 2).sum(axis=0) / mass), floor)
        share = mass / mass.sum()
        done = np.abs(fresh - mean).max() < 1e-9
        mean = fresh
        if done:
            break
    return mean, sd, share


def mixture_cut(x: np.ndarray, w: np.ndarray, lo: float, hi: float) -> tuple[float, str]:
    """Value above which the brighter of two components is more likely."""
    mean, sd, share = two_gaussians(x, w)
    high = int(np.argmax(mean))
    grid = np.linspace(mean.min(), mean.max(), 20_001)
    log = np.log(share) - np.log(sd) - 0.5 * ((grid[:, None] - mean) / sd) ** 2
    above = np.nonzero(log[:, high] >= log[:, 1 - high])[0]
    return float(grid[above[0]] if len(above) else mean.mean()), "mixture"


def learn_threshold(
    events: DataFrame, value: Column, method: Callable, by: Sequence[str] = (), min_rows: int = MIN_ROWS,
) -> DataFrame:
    """(by, threshold, method, n_values) per group from its histogram.

    Groups below ``min_rows`` have no threshold.
    """
    hist = fine_histogram(events, value, by)
    keys = list(by)
    frame = hist if keys else hist.withColumn("_g", F.lit(0))
    group = keys or ["_g"]
    schema = T.StructType([frame.schema[k] for k in group] + [
        T.StructField("threshold", T.DoubleType()), T.StructField("method", T.StringType()), T.StructField("n_values", T.LongType())])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, w, lo, hi = _centers(pdf)
        cut, how = method(x, w, lo, hi) if w.sum() >= min_rows and hi > lo else (None, "too_few")
        return pd.DataFrame([[*key, cut, how, int(w.sum())]], columns=schema.names)

    out = frame.groupBy(*group).applyInPandas(fit, schema)
    return as_model(out if keys else out.drop("_g"))


def _applied(events: DataFrame, cuts: DataFrame, value: Column, by: Sequence[str], mask: str, missing: bool) -> DataFrame:
    """Boolean column value >= threshold; ``missing`` where there is none."""
    if by:
        joined = events.join(cuts.select(*by, F.col("threshold").alias("_t")), list(by), "left")
    else:
        row = cuts.first()
        joined = events.withColumn("_t", F.lit(row["threshold"] if row else None).cast("double"))
    test = F.when(F.col("_t").isNull(), F.lit(missing)).otherwise(is_finite(value) & (value >= F.col("_t")))
    return joined.withColumn(mask, test).drop("_t")


# --- CD45 and CD34 -----------------------------------------------------------


def log_scale(value: Column) -> Column:
    return F.log10(1 + F.greatest(value, F.lit(0.0))) * (LOG_DECADES / math.log10(1 + LOG_TOP))


def auto_cd45(events: DataFrame, cd45: str, by: Sequence[str] = (), mask: str = "cd45_pos") -> tuple[DataFrame, DataFrame]:
    """CD45 positive events and the thresholds, learnt per ``by`` (e.g. condition)."""
    value = log_scale(F.col(cd45).cast("double"))
    cuts = learn_threshold(events, F.when(is_finite(cd45), value), left_foot, by)
    return _applied(events, cuts, value, by, mask, True), cuts


def auto_cd34(events: DataFrame, cd34: str, by: Sequence[str] = (), method: str = "kde", mask: str = "cd34_pos",
              ssc: str | None = None) -> tuple[DataFrame, DataFrame]:
    """CD34 positive events by density or mixture, optionally with the low-SSC component."""
    value = F.col(cd34).cast("double")
    cuts = learn_threshold(events, value, right_foot if method == "kde" else mixture_cut, by, 100)
    out = _applied(events, cuts, value, by, mask, False)
    if ssc is None:
        return out, cuts
    side = F.col(ssc).cast("double")
    scatter = learn_threshold(events, side, mixture_cut, by)
    high = _applied(out, scatter, side, by, "_high", False)
    return high.withColumn(mask, F.col(mask) & ~F.col("_high") & is_finite(ssc)).drop("_high"), cuts


def dim_limits(events: DataFrame, cd45: str, by: Sequence[str]) -> DataFrame:
    return as_model(quantiles(events.where(is_finite(cd45)), list(by), {"dim_low": (cd45, DIM_LOW / 100), "dim_high": (cd45, DIM_HIGH / 100)}))


def prescreen(
    events: DataFrame, cd34: str, cd45: str, by: Sequence[str], method: str = "kde", inside: bool = False, min_rows: int = MIN_ROWS,
) -> DataFrame:
    """CD34 positive share of the CD45-dim events with an alert level per sample.

    ``inside`` learns the CD34 threshold on the dim events only.
    """
    valid = events.where(is_finite(cd34) & is_finite(cd45))
    dim = valid.join(dim_limits(valid, cd45, by), list(by)).withColumn(
        "_dim", F.col(cd45).between(F.col("dim_low"), F.col("dim_high"))).drop("dim_low", "dim_high")
    base = dim.where("_dim") if inside else dim
    value = F.col(cd34).cast("double")
    cuts = learn_threshold(base, value, right_foot if method == "kde" else mixture_cut, by, 50 if inside else 100)
    marked = _applied(dim, cuts, value, by, "_pos", False)
    counts = marked.groupBy(*by).agg(
        F.count("*").alias("n_valid"), F.count_if("_dim").alias("n_cd45dim"), F.count_if(F.col("_dim") & F.col("_pos")).alias("n_cd34_pos"))
    ratio = F.col("n_cd34_pos") / F.greatest(F.col("n_cd45dim"), F.lit(1))
    level = F.when(ratio >= ALERT_HIGH, "high").when(ratio >= ALERT_MODERATE, "moderate").otherwise("none")
    return counts.where(F.col("n_valid") >= min_rows).withColumn("ratio", ratio).withColumn("alert", level).join(
        cuts.select(*by, "threshold", "method"), list(by), "left")


# --- debris ------------------------------------------------------------------


def _plane(events: DataFrame, fsc: str, ssc: str, bins: int) -> tuple[DataFrame, dict, Column, Column]:
    """Weighted grid of both channels and the bin expressions."""
    valid = events.where(is_finite(fsc) & is_finite(ssc))
    row = valid.agg(F.min(fsc).alias("x0"), F.max(fsc).alias("x1"), F.min(ssc).alias("y0"), F.max(ssc).alias("y1"),
                    F.count("*").alias("n")).first().asDict()
    if not row["n"]:
        return valid.limit(0), row, F.lit(0), F.lit(0)

    def spot(name: str, lo: float, hi: float) -> Column:
        width = (hi - lo) / bins if hi > lo else 1.0
        return F.least(F.floor((F.col(name) - lo) / width), F.lit(bins - 1)).cast("int")

    bx, by = spot(fsc, row["x0"], row["x1"]), spot(ssc, row["y0"], row["y1"])
    grid = valid.groupBy(bx.alias("bx"), by.alias("by")).agg(
        F.count("*").alias("n"), F.avg(fsc).alias("x"), F.avg(ssc).alias("y"))
    return as_model(grid, bins * bins), row, bx, by


def auto_debris_mixture(
    events: DataFrame, fsc: str, ssc: str, mask: str = "not_debris", components: Sequence[int] = (2, 3),
    min_fraction: float = MIN_FRACTION, bins: int = PLANE_BINS, seed: int = 42,
) -> tuple[DataFrame, dict]:
    """Keep mixture components that are large enough and not far below the main one.

    The mixture is fitted by EM on the weighted grid of all rows; the number
    of components has the smallest BIC.
    """
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    grid, span, _, _ = _plane(events, fsc, ssc, bins)
    if span["n"] < MIN_ROWS:
        return events.withColumn(mask, F.lit(True)), {"components": 0}
    n = F.col("n")
    stats = grid.agg(*[s for c in ("x", "y") for s in (
        (F.sum(n * F.col(c)) / F.sum(n)).alias(f"m{c}"), (F.sum(n * F.col(c) * F.col(c)) / F.sum(n)).alias(f"q{c}"))]).first()
    sd = {c: math.sqrt(max(stats[f"q{c}"] - stats[f"m{c}"] ** 2, 1e-12)) for c in ("x", "y")}

    def scaled(x: Column, y: Column) -> Column:
        return array_to_vector(F.array((x - stats["mx"]) / sd["x"], (y - stats["my"]) / sd["y"]))

    points = grid.select(scaled(F.col("x"), F.col("y")).alias("features"), F.col("n").cast("double").alias("weight"))
    fits = []
    for k in components:
        model = GaussianMixture(k=k, seed=seed, maxIter=100, weightCol="weight").fit(points)
        free = k * 5 + k - 1
        fits.append((-2 * model.summary.logLikelihood + free * math.log(span["n"]), k, model))
    bic, k, model = min(fits, key=lambda f: f[0])
    finite = is_finite(fsc) & is_finite(ssc)
    feature = F.when(finite, scaled(F.col(fsc), F.col(ssc))).otherwise(array_to_vector(F.array(F.lit(0.0), F.lit(0.0))))
    labelled = model.transform(events.withColumn("features", feature)).drop("features", "probability")
    sizes = {r["prediction"]: (r["n"], r["m"]) for r in labelled.where(finite).groupBy("prediction").agg(
        F.count("*").alias("n"), F.avg(fsc).alias("m")).collect()}
    main = max(sizes, key=lambda c: sizes[c][0])
    kept = [c for c, (size, m) in sizes.items() if size / span["n"] >= min_fraction and m >= FSC_SHARE * sizes[main][1]] or [main]
    out = labelled.withColumn(mask, finite & F.col("prediction").isin(*kept)).drop("prediction")
    return out, {"components": k, "bic": bic, "kept": sorted(kept), "sizes": sizes}


def auto_debris_density(
    events: DataFrame, fsc: str, ssc: str, mask: str = "not_debris", share: float = DENSITY_SHARE,
    min_fraction: float = MIN_FRACTION, bins: int = 128,
) -> DataFrame:
    """Keep events in places at least ``share`` of the median density."""
    grid, span, bx, by = _plane(events, fsc, ssc, bins)
    if span["n"] < MIN_ROWS:
        return events.withColumn(mask, F.lit(True))
    rows = model_rows(grid, bins * bins)
    plane = np.zeros((bins, bins))
    for r in rows:
        plane[r["bx"], r["by"]] = r["n"]
    # normal-reference bandwidth of a plane, in bins, from the marginal spreads
    factor = span["n"] ** (-1 / 6)
    at = np.arange(bins)
    sx = max(_spread(at, plane.sum(axis=1)) * factor, 0.5)
    sy = max(_spread(at, plane.sum(axis=0)) * factor, 0.5)
    density = np.apply_along_axis(_smooth, 0, plane, sx)
    density = np.apply_along_axis(_smooth, 1, density, sy)
    held = np.array([density[r["bx"], r["by"]] for r in rows])
    weight = np.array([r["n"] for r in rows], dtype=float)
    cut = _weighted_quantile(held, weight, 0.5) * share
    if weight[held >= cut].sum() < int(span["n"] * min_fraction):
        return events.withColumn(mask, F.lit(True))
    good = events.sparkSession.createDataFrame(
        [(r["bx"], r["by"], bool(d >= cut)) for r, d in zip(rows, held)], "_bx int, _by int, _keep boolean")
    placed = events.withColumns({"_bx": bx, "_by": by}).join(good, ["_bx", "_by"], "left")
    return placed.withColumn(mask, F.coalesce(F.col("_keep"), F.lit(False))).select(*events.columns, mask)


# --- singlets ----------------------------------------------------------------


def robust_lines(events: DataFrame, file: str, area: str, height: str, order: Column, proposals: int = LINE_SAMPLE) -> DataFrame:
    """Robust line area ~ height per file: (file, n, slope, intercept, r2).

    Random subsets of at most ``proposals`` rows of a file propose lines.  All
    rows of the file then decide: the line with most inliers (within one raw
    MAD of the areas) wins and is refitted on its inliers.
    """
    return _lines(staged(events.select(file, area, height, order.alias("_o")), "lines"), file, area, height, proposals)


def _lines(rows: DataFrame, file: str, area: str, height: str, proposals: int = LINE_SAMPLE) -> DataFrame:
    """As :func:`robust_lines`, over stored rows with their order in ``_o``."""
    middle = as_model(rows.groupBy(file).agg(F.count("*").alias("n")).join(medians(rows, [file], {"_mid": area}), file))
    near = rows.join(middle, file)
    limits = as_model(medians(near, [file], {"_limit": F.abs(F.col(area) - F.col("_mid"))}))
    large = F.col("n") >= LINE_MIN_ROWS
    part = smallest(near.where(large).select(file, area, height, "_o"), [file], proposals, F.col("_o"))
    pair = T.ArrayType(T.DoubleType())
    schema = T.StructType([rows.schema[file], T.StructField("_slopes", pair), T.StructField("_starts", pair)])

    def propose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_o")
        x, y = pdf[height].to_numpy(dtype=float), pdf[area].to_numpy(dtype=float)
        pick = np.random.default_rng(42).integers(0, len(x), (LINE_TRIALS, min(LINE_SEEDS, len(x))))
        px, py = x[pick], y[pick]
        cx, cy = px - px.mean(axis=1, keepdims=True), py - py.mean(axis=1, keepdims=True)
        slopes = (cx * cy).sum(axis=1) / np.maximum((cx * cx).sum(axis=1), 1e-300)
        return pd.DataFrame({file: [key[0]], "_slopes": [slopes], "_starts": [py.mean(axis=1) - slopes * px.mean(axis=1)]})

    offered = as_model(part.groupBy(file).applyInPandas(propose, schema)).join(limits, file)
    best = as_model(_votes(rows, offered, file, area, height).groupBy(file).agg(
        F.max(F.struct("votes", (-F.col("trial")).alias("first"))).alias("_w")).select(file, (-F.col("_w.first")).alias("_b")))
    chosen = as_model(best.join(offered, file).select(
        file, "_limit", F.col("_slopes")[F.col("_b")].alias("_slope"), F.col("_starts")[F.col("_b")].alias("_start")))
    y, x = F.col(area), F.col(height)
    held = rows.join(chosen, file).where(F.abs(y - F.col("_slope") * x - F.col("_start")) <= F.col("_limit"))
    fitted = held.groupBy(file).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.when(F.count("*") > LINE_MIN_ROWS, F.regr_r2(y, x)).alias("r2"))
    return as_model(middle.select(file, "n").join(fitted, file, "left"))


def _votes(rows: DataFrame, offered: DataFrame, file: str, area: str, height: str) -> DataFrame:
    """(file, trial, votes): inliers of every proposed line among all rows of its file.

    The lines of up to ``SHIPPED_NUMBERS`` numbers travel to the tasks, where each Arrow batch leaves one count per
    line; more files than that are judged by columns after a join.
    """
    if offered.count() * 2 * LINE_TRIALS > SHIPPED_NUMBERS:
        judged = rows.join(offered, file)
        counts = judged.groupBy(file).agg(F.array(*[
            F.count_if(F.abs(F.col(area) - F.col("_slopes")[i] * F.col(height) - F.col("_starts")[i]) <= F.col("_limit")) for i in range(LINE_TRIALS)]).alias("_v"))
        return counts.select(file, F.posexplode("_v").alias("trial", "votes"))
    lines = {r[file]: (np.array(r["_slopes"]), np.array(r["_starts"]), r["_limit"]) for r in offered.collect()}
    sent = rows.sparkSession.sparkContext.broadcast(lines)
    schema = T.StructType([rows.schema[file], T.StructField("trial", T.IntegerType()), T.StructField("votes", T.LongType())])
    trials = np.arange(LINE_TRIALS, dtype="int32")

    def judge(batches):
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            index = np.asarray(codes.indices.fill_null(-1))
            x, y = (batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in (1, 2))
            for k, name in enumerate(codes.dictionary.to_pylist()):
                if name in sent.value:
                    slopes, starts, limit = sent.value[name]
                    own = index == k
                    near = np.abs(y[own, None] - slopes[None, :] * x[own, None] - starts[None, :]) <= limit
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * LINE_TRIALS, batch.column(0).type), pa.array(trials), pa.array(near.sum(axis=0).astype("int64"))], names=[file, "trial", "votes"])

    return rows.select(file, height, area).mapInArrow(judge, schema).groupBy(file, "trial").agg(F.sum("votes").alias("votes"))


def auto_singlets(
    events: DataFrame, file: str, area: str, height: str, order: Column, mask: str = "singlet", valid: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Events not far above their file's area/height line, and the per-file report.

    Line, residual median and MAD come from all usable rows: finite, above
    ``LINE_FLOOR`` in both channels and ``valid`` (viable, say).  A poor line
    falls back to the ratio test; below ``MIN_ROWS`` usable rows in all, every
    event is kept.
    """
    usable = all_of([
        is_finite(area), is_finite(height), F.col(area) > LINE_FLOOR, F.col(height) > LINE_FLOOR,
        *([valid] if valid is not None else [])])
    usable = F.coalesce(usable, F.lit(False))
    # the passes below read these three columns and no lineage
    base = staged(events.where(usable).select(file, area, height, order.alias("_o")), "singlets")
    lines = _lines(base, file, area, height)
    enough = (lines.agg(F.sum("n")).first()[0] or 0) >= MIN_ROWS
    lines = lines.drop("n")
    joined = events.join(lines, file, "left")
    residual = F.col(area) - (F.col("slope") * F.col(height) + F.col("intercept"))
    placed = base.join(lines, file)
    middle = as_model(medians(placed, [file], {"_med": residual}))
    mad = as_model(medians(placed.join(middle, file), [file], {"_mad": F.abs(residual - F.col("_med"))}))
    scored = joined.withColumn("_res", F.when(usable, residual)).join(middle, file, "left").join(mad, file, "left")
    ratio = F.col(area) / F.greatest(F.col(height), F.lit(1.0))
    poor = F.coalesce(F.col("r2") < LINE_R2, F.lit(False))
    keep = (
        F.when(~usable, False).when(F.col("slope").isNull(), True)
        .when(poor, ratio.between(0.6, 1.5)).otherwise(F.col("_res") <= F.col("_med") + LINE_MAD * F.col("_mad")))
    marked = scored.withColumn(mask, keep if enough else F.lit(True))
    how = F.when(F.col("slope").isNull(), "skip_too_few").when(poor, "ratio_fallback").otherwise("ransac")
    report = marked.withColumn("method", how).groupBy(file, "method").agg(
        F.count("*").alias("n"), F.count_if(mask).alias("n_singlets"), F.first("r2").alias("r2"))
    return marked.select(*events.columns, mask), report
