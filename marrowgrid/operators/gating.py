"""Gates: limits learnt from all rows, then a predicate on each row.

Limits come back as plain numbers, so the predicate is made of literals and
can be pushed into the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrowgrid.functions.numeric import all_of, any_of, col, is_finite
from marrowgrid.operators.quantiles import quantile_row

# Default limits of the percentile gates.
VIABLE_PCT = (2.0, 98.0)
SINGLET_RATIO = (0.6, 1.5)
SINGLET_MIN_HEIGHT = 100.0
CD45_PCT = 10.0
CD34_PCT, CD34_SSC_PCT = 85.0, 70.0
DEBRIS_PCT = (1.0, 99.0)
# Percentiles of the status flags on patient rows.
CD45_NEG_PCT, CD45_DIM_PCT, CD34_POS_PCT, DEBRIS_FLAG_PCT, DOUBLET_RATIO = 5.0, 15.0, 85.0, 5.0, 1.20


def learn_limits(events: DataFrame, wanted: Mapping[str, tuple[str, float]]) -> dict[str, float]:
    """Percentile limits ``{name: (column, percent)}`` over the finite rows."""
    finite = events.select(*{c for c, _ in wanted.values()})
    specs = {n: (F.when(is_finite(c), F.col(c)), p / 100) for n, (c, p) in wanted.items()}
    return quantile_row(finite, specs)


def _between(column: str, low: float, high: float) -> Column:
    return is_finite(column) & F.col(column).between(F.lit(low), F.lit(high))


def gate_viable(
    events: DataFrame, fsc: str | None, ssc: str | None, low: float = VIABLE_PCT[0], high: float = VIABLE_PCT[1]
) -> Column:
    """Scatter inside its percentile range, both ends included."""
    channels = [c for c in (fsc, ssc) if c]
    limits = learn_limits(events, {f"{c}|{p}": (c, p) for c in channels for p in (low, high)}) if channels else {}
    return all_of(_between(c, limits[f"{c}|{low}"], limits[f"{c}|{high}"]) for c in channels)


def singlet_ratio(area: "str | Column", height: "str | Column", floor: float = SINGLET_MIN_HEIGHT) -> Column:
    """Area over height, NULL when the height is at or below the floor."""
    height = col(height)
    return F.try_divide(col(area), F.when(height > floor, height))


def gate_singlets(
    area: str | None, height: str | None, low: float = SINGLET_RATIO[0], high: float = SINGLET_RATIO[1]
) -> Column:
    if not area or not height:
        return F.lit(True)
    return F.coalesce(singlet_ratio(area, height).between(low, high), F.lit(False))


def gate_cd45(events: DataFrame, cd45: str | None, pct: float = CD45_PCT) -> Column:
    """Strictly above the percentile."""
    if not cd45:
        return F.lit(True)
    cut = learn_limits(events, {"cut": (cd45, pct)})["cut"]
    return is_finite(cd45) & (F.col(cd45) > cut)


def gate_cd34(
    events: DataFrame, cd34: str | None, ssc: str | None, pct: float = CD34_PCT, ssc_pct: float = CD34_SSC_PCT
) -> Column:
    """At or above the CD34 percentile and, with SSC, at or below its percentile."""
    if not cd34:
        return F.lit(True)
    wanted = {"cd34": (cd34, pct)} | ({"ssc": (ssc, ssc_pct)} if ssc else {})
    cut = learn_limits(events, wanted)
    bright = is_finite(cd34) & (F.col(cd34) >= cut["cd34"])
    return bright & is_finite(ssc) & (F.col(ssc) <= cut["ssc"]) if ssc else bright


def gate_debris(events: DataFrame, fsc: str, ssc: str, bounds: Mapping[str, tuple[float, float]] | None = None) -> Column:
    """Scatter box from percentiles or explicit bounds."""
    if bounds is None:
        low, high = DEBRIS_PCT
        limits = learn_limits(events, {f"{c}|{p}": (c, p) for c in (fsc, ssc) for p in (low, high)})
        bounds = {c: (limits[f"{c}|{low}"], limits[f"{c}|{high}"]) for c in (fsc, ssc)}
    return all_of(_between(c, *bounds[c]) for c in (fsc, ssc))


def standard_masks(
    events: DataFrame, fsc="FSC_A", fsc_h="FSC_H", ssc="SSC_A", cd45="CD45", cd34="CD34", *,
    condition: str = "condition", cd34_of: str | None = None,
) -> dict[str, Column]:
    """The four gates of the sequence, each learnt on all rows in one job.

    ``cd34_of`` is the condition whose events the CD34 gate selects; all other
    events pass it, which keeps the normal side of a comparison whole.
    """
    wanted = {
        "fsc_lo": (fsc, VIABLE_PCT[0]), "fsc_hi": (fsc, VIABLE_PCT[1]),
        "ssc_lo": (ssc, VIABLE_PCT[0]), "ssc_hi": (ssc, VIABLE_PCT[1]),
        "cd45": (cd45, CD45_PCT), "cd34": (cd34, CD34_PCT), "cd34_ssc": (ssc, CD34_SSC_PCT),
    }
    cut = learn_limits(events, wanted)
    blast = is_finite(cd34) & (F.col(cd34) >= cut["cd34"]) & is_finite(ssc) & (F.col(ssc) <= cut["cd34_ssc"])
    if cd34_of is not None:
        blast = blast | ~F.col(condition).eqNullSafe(cd34_of)
    return {
        "viable": _between(fsc, cut["fsc_lo"], cut["fsc_hi"]) & _between(ssc, cut["ssc_lo"], cut["ssc_hi"]),
        "singlets": gate_singlets(fsc, fsc_h),
        "cd45": is_finite(cd45) & (F.col(cd45) > cut["cd45"]),
        "cd34": blast,
    }


def gating_log(events: DataFrame, masks: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows before and after each gate of a sequence, in one aggregation."""
    names = list(masks)
    passed = {n: all_of(masks[m] for m in names[: i + 1]) for i, n in enumerate(names)}
    totals = events.groupBy(*by).agg(
        F.count("*").alias("_all"), *[F.count_if(c).alias(f"_n{i}") for i, c in enumerate(passed.values())])
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(i + 1).alias("step"), F.lit(n).alias("gate"),
            F.col("_all" if i == 0 else f"_n{i - 1}").alias("n_before"), F.col(f"_n{i}").alias("n_after"))
        for i, n in enumerate(names)
    ]))
    return (
        totals.select(*by, rows.alias("_r")).select(*by, "_r.*")
        .withColumn("pct_kept", F.when(F.col("n_before") > 0, 100.0 * F.col("n_after") / F.col("n_before")).otherwise(0.0))
    )


def status_flags(patient: DataFrame, cd45="CD45", cd34="CD34", fsc="FSC_A", fsc_h="FSC_H", ssc="SSC_A") -> DataFrame:
    """CD45 code (1 bright, 2 dim, 3 negative), CD34, debris and doublet flags."""
    cut = learn_limits(patient, {
        "neg": (cd45, CD45_NEG_PCT), "dim": (cd45, CD45_DIM_PCT), "cd34": (cd34, CD34_POS_PCT),
        "fsc": (fsc, DEBRIS_FLAG_PCT), "ssc": (ssc, DEBRIS_FLAG_PCT)})
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    ratio = F.try_divide(F.col(fsc), F.when(F.col(fsc_h) > 0, F.col(fsc_h)))
    return patient.withColumns({
        "cd45_status": F.when(F.col(cd45) < cut["neg"], 3.0).when(F.col(cd45) < cut["dim"], 2.0).otherwise(1.0),
        "cd34_status": flag(F.col(cd34) >= cut["cd34"]),
        "debris_flag": flag((F.col(fsc) < cut["fsc"]) & (F.col(ssc) < cut["ssc"])),
        "doublet_flag": flag(ratio > DOUBLET_RATIO),
    })


def mask_report(events: DataFrame, masks: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pass fraction of each boolean column and of their conjunction."""
    joint = all_of(F.col(m) for m in masks)
    return events.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.avg(F.col(m).cast("double")).alias(f"frac_{m}") for m in masks],
        F.count_if(joint).alias("n_pass"), F.avg(joint.cast("double")).alias("frac_pass"))


def pre_gated(events: DataFrame, masks: Sequence[str]) -> DataFrame:
    """Rows that pass every named mask."""
    return events.where(all_of(F.col(m) for m in masks))


# --- user gates along a tree -------------------------------------------------


class GateTree:
    """Named gates with parents; each compiles to one boolean expression.

    Every gate implies its parent.  ``root`` stands for all rows.  When many
    gates are needed at once they are computed layer by layer, so a condition
    shared by several gates is evaluated once per row.
    """

    def __init__(self) -> None:
        self._own: dict[str, Column] = {}
        self._parts: dict[str, tuple[str, tuple[str, ...]]] = {}
        self._parent: dict[str, str] = {}

    def _check(self, name: str, parent: str) -> None:
        if name in self._parent or name == "root":
            raise ValueError(f"gate {name} exists already")
        if parent != "root" and parent not in self._parent:
            raise KeyError(parent)

    def add(self, name: str, condition: Column, parent: str = "root") -> "GateTree":
        self._check(name, parent)
        self._own[name], self._parent[name] = condition, parent
        return self

    def add_boolean(self, name: str, op: str, parts: Sequence[str], parent: str = "root") -> "GateTree":
        """AND, OR or NOT of gates that exist already."""
        self._check(name, parent)
        missing = [p for p in parts if p not in self._parent]
        if missing or op not in ("and", "or", "not"):
            raise KeyError(", ".join(missing) or op)
        self._parts[name], self._parent[name] = (op, tuple(parts)), parent
        return self

    def names(self) -> list[str]:
        return list(self._parent)

    def path(self, name: str) -> list[str]:
        steps = []
        while name != "root":
            if name not in self._parent:
                raise KeyError(name)
            steps.append(name)
            name = self._parent[name]
        return steps[::-1]

    def _condition(self, name: str, mask) -> Column:
        """Own condition and parent, other gates taken from ``mask(name)``."""
        if name in self._parts:
            op, parts = self._parts[name]
            members = [mask(p) for p in parts]
            own = {"and": all_of, "or": any_of, "not": lambda m: ~any_of(m)}[op](members)
        else:
            own = self._own[name]
        parent = self._parent[name]
        own = F.coalesce(own, F.lit(False))
        return own if parent == "root" else mask(parent) & own

    def mask(self, name: str) -> Column:
        return self._condition(name, self.mask)

    def _marked(self, events: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
        """Events with one hidden boolean per gate, each layer built on the one before."""
        hidden = {n: f"_gate_{i}" for i, n in enumerate(self._parent)}
        depth: dict[str, int] = {"root": 0}
        for name, parent in self._parent.items():
            needs = [parent, *(self._parts[name][1] if name in self._parts else ())]
            depth[name] = 1 + max(depth[n] for n in needs)
        for level in range(1, max(depth.values()) + 1):
            events = events.withColumns({
                hidden[n]: self._condition(n, lambda g: F.col(hidden[g])) for n, d in depth.items() if d == level})
        return events, {n: F.col(h) for n, h in hidden.items()}

    def rows(self, events: DataFrame, name: str) -> DataFrame:
        """Rows of a population; every row for ``root``."""
        return events if name == "root" else events.where(self.mask(name))

    def population(self, events: DataFrame, name: str) -> DataFrame:
        """Rows of one population, an error when it is unknown or empty."""
        hits = [n for n in self._parent if n == name or n.split("/")[-1] == name]
        if name != "root" and len(hits) != 1:
            raise ValueError(f"population {name}: {len(hits)} matches")
        found = self.rows(events, "root" if name == "root" else hits[0])
        if found.isEmpty():
            raise ValueError(f"population {name} is empty")
        return found

    def counts(self, events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """Count, share of parent and of grandparent for every gate: one scan."""
        names = self.names()
        marked, masks = self._marked(events)
        row = marked.groupBy(*by).agg(
            F.count("*").alias("_n_root"), *[F.count_if(masks[n]).alias(f"_n_{i}") for i, n in enumerate(names)])
        at = {"root": "_n_root"} | {n: f"_n_{i}" for i, n in enumerate(names)}
        entries = []
        for name in names:
            parent = self._parent[name]
            above = self._parent.get(parent, "root")
            entries.append(F.struct(
                F.lit(name).alias("gate"), F.lit(parent).alias("parent"),
                F.lit("/".join(["root", *self.path(name)])).alias("path"),
                F.col(at[name]).alias("n"),
                F.try_divide(100.0 * F.col(at[name]), F.col(at[parent])).alias("pct_parent"),
                F.try_divide(100.0 * F.col(at[name]), F.col(at[above])).alias("pct_grandparent")))
        return row.select(*by, F.explode(F.array(*entries)).alias("_g")).select(*by, "_g.*")

    def assigned(self, events: DataFrame, parent: str, default: str, child: str = "child") -> DataFrame:
        """Rows of a population with the child they belong to; of overlapping children the last wins."""
        marked, masks = self._marked(events)
        children = [n for n in self._parent if self._parent[n] == parent]
        picks = [F.when(masks[n], F.lit(n)) for n in reversed(children)]
        inside = marked if parent == "root" else marked.where(masks[parent])
        return inside.withColumn(child, F.coalesce(*picks, F.lit(default))).select(*events.columns, child)

    def members(self, events: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
        """One row per (event, gate) it belongs to."""
        marked, masks = self._marked(events)
        hit = F.array_compact(F.array(*[F.when(masks[n], F.lit(n)) for n in masks]))
        return marked.select(*by, *columns, F.explode(hit).alias("gate"))


# --- time gate ---------------------------------------------------------------


def time_gate(
    events: DataFrame, sample: str, time: str, n_sigma: float = 3.0, min_bins: int = 100, rows_per_bin: int = 500
) -> DataFrame:
    """Drop the rows of time bins whose count is far from the median count.

    Bins are equal in width per sample; rows at the last edge are never
    dropped.
    """
    from marrowgrid.operators.quantiles import medians
    from marrowgrid.operators.sizing import as_model

    spans = as_model(
        events.groupBy(sample).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"), F.count("*").alias("_n"))
        .withColumn("_bins", F.greatest(F.lit(min_bins), F.floor(F.col("_n") / rows_per_bin)))
        .drop("_n"))
    width = (F.col("_t1") - F.col("_t0")) / F.col("_bins")
    spot = F.when(F.col("_t1") > F.col("_t0"), F.floor((F.col(time) - F.col("_t0")) / width)).otherwise(0)
    placed = events.join(spans, sample).withColumn("_bin", F.least(spot, F.col("_bins") - 1))
    counts = as_model(placed.groupBy(sample, "_bin").agg(F.count("*").alias("_c")))
    middle = medians(counts, [sample], {"_m": "_c"})
    spread = counts.groupBy(sample).agg(F.stddev_pop("_c").alias("_s"))
    bad = (
        counts.join(middle, sample).join(spread, sample)
        .where(F.abs(F.col("_c") - F.col("_m")) > n_sigma * F.col("_s"))
        .select(sample, "_bin", F.lit(True).alias("_bad"))
    )
    checked = placed.join(as_model(bad), [sample, "_bin"], "left")
    return checked.where(F.col("_bad").isNull() | (F.col(time) >= F.col("_t1"))).select(*events.columns)


# --- compensation and spillover ----------------------------------------------


def compensate(events: DataFrame, detectors: Sequence[str], spillover: Sequence[Sequence[float]]) -> DataFrame:
    """Multiply the detector values of every event by the inverse spillover."""
    import numpy as np

    inverse = np.linalg.inv(np.asarray(spillover, dtype=float))
    return events.withColumns({
        d: reduce(lambda a, b: a + b, [F.lit(float(inverse[i][j])) * F.col(s) for i, s in enumerate(detectors)])
        for j, d in enumerate(detectors)})


def compensate_by(
    events: DataFrame, detectors: Sequence[str], matrices: Mapping[object, Sequence[Sequence[float]]], sample: str
) -> DataFrame:
    """Compensation with one model-sized matrix per sample."""
    import numpy as np

    from marrowgrid.operators.sizing import as_model

    spark = events.sparkSession
    kind = events.schema[sample].dataType.simpleString()
    rows = [(k, [float(v) for v in np.linalg.inv(np.asarray(m, dtype=float)).ravel()]) for k, m in matrices.items()]
    inverse = as_model(spark.createDataFrame(rows, f"`{sample}` {kind}, _inv array<double>"))
    d = len(detectors)
    mixed = events.join(inverse, sample, "left")
    made = {}
    for j, name in enumerate(detectors):
        terms = [F.col("_inv")[i * d + j] * F.col(s) for i, s in enumerate(detectors)]
        made[name] = F.when(F.col("_inv").isNull(), F.col(name)).otherwise(reduce(lambda a, b: a + b, terms))
    return mixed.withColumns(made).select(*events.columns)


def inverse_spillovers(spillovers: DataFrame, detectors: Sequence[str], sample: str = "sample_id") -> DataFrame:
    """(sample, inverse, error): matrices of many samples over one list of detectors, solved in batches.

    ``spillovers`` has ``detectors`` and ``matrix`` (row by row) per sample.  A detector that a sample does not record
    is left as it is; a matrix that has no inverse is an error.
    """
    import numpy as np
    import pandas as pd

    place, d = {n: i for i, n in enumerate(detectors)}, len(detectors)

    def solve(frames):
        for frame in frames:
            full = np.repeat(np.eye(d)[None], len(frame), 0)
            for k, (names, values) in enumerate(zip(frame["detectors"], frame["matrix"])):
                at = [place[n] for n in names]
                full[k][np.ix_(at, at)] = np.asarray(values, float).reshape(len(at), len(at))
            sound = np.linalg.cond(full) < 1e12 if len(frame) else np.zeros(0, bool)
            inverse = np.linalg.inv(np.where(sound[:, None, None], full, np.eye(d)))
            yield pd.DataFrame({
                sample: frame[sample], "inverse": [list(m.ravel()) if ok else None for m, ok in zip(inverse, sound)],
                "error": [None if ok else "spillover matrix has no inverse" for ok in sound]})

    kind = spillovers.schema[sample].dataType.simpleString()
    return spillovers.where("detectors IS NOT NULL").select(sample, "detectors", "matrix").mapInPandas(
        solve, f"`{sample}` {kind}, inverse array<double>, error string")


def compensate_recorded(events: DataFrame, spillovers: DataFrame, sample: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Events compensated with the matrix their own file records, and (sample, error) of matrices that cannot be used.

    Events of a file without a usable matrix are left as they are.  A missing detector value stays NULL and counts as
    zero for the others.
    """
    from marrowgrid.operators.sizing import as_model, model_rows

    named = model_rows(spillovers.select(F.explode("detectors").alias("d")).distinct())
    detectors = sorted(r["d"] for r in named if r["d"] in events.columns)
    usable = F.size(F.array_except("detectors", F.array(*[F.lit(d) for d in detectors]).cast("array<string>"))) == 0
    known = spillovers.where("detectors IS NOT NULL")
    solved = as_model(inverse_spillovers(known.where(usable), detectors, sample))
    missing = known.where(~usable).select(sample, F.lit("spillover names a detector that no event has").alias("error"))
    errors = spillovers.where("error IS NOT NULL").select(sample, "error").unionByName(missing) \
        .unionByName(solved.where("error IS NOT NULL").select(sample, "error"))
    inverse = solved.where("inverse IS NOT NULL").select(sample, F.col("inverse").alias("_inv"))
    mixed, d, made = events.join(inverse, sample, "left"), len(detectors), {}
    for j, name in enumerate(detectors):
        own = F.col(f"`{name}`").cast("double")
        terms = [F.col("_inv")[i * d + j] * F.coalesce(F.col(f"`{s}`").cast("double"), F.lit(0.0)) for i, s in enumerate(detectors)]
        made[name] = F.when(own.isNull() | F.col("_inv").isNull(), own).otherwise(reduce(lambda a, b: a + b, terms))
    return mixed.withColumns(made).select(*[F.col(f"`{c}`") for c in events.columns]), errors


def spillover_from_controls(controls: DataFrame, stain: str, primary: Mapping[str, str]) -> DataFrame:
    """Spillover rows from single-stained controls.

    ``primary`` maps a stain to its own detector.  Each row is the median of
    every detector over that of the primary one: unit diagonal, zeros when
    the primary median is not positive.
    """
    from marrowgrid.operators.quantiles import medians

    detectors = list(primary.values())
    middle = medians(controls, [stain], {f"_{d}": d for d in detectors})
    own = F.coalesce(*[F.when(F.col(stain) == s, F.col(f"_{d}")) for s, d in primary.items()])
    cells = {}
    for d in detectors:
        is_own = F.coalesce(*[F.when(F.col(stain) == s, F.lit(d == p)) for s, p in primary.items()])
        cells[d] = F.when(is_own, 1.0).when(own > 0, F.col(f"_{d}") / own).otherwise(0.0)
    return middle.select(stain, *[c.alias(n) for n, c in cells.items()])
