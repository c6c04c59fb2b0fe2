"""Exact quantiles per group, safe for groups of any size.

Groups that fit one task use the built-in ``percentile``.  Larger ones are
narrowed by histograms: every level counts equal-width bins between the
current bounds (partial aggregation, at most ``BINS`` rows per group leave a
task), keeps the bin that holds the wanted rank and goes on inside it, until
the remaining values fit one task.  No level shuffles rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrowgrid.operators.sizing import GROUP_ROWS, as_model, groups_fit

BINS = 4096
_MAX_LEVELS = 40

Spec = Mapping[str, tuple["str | Column", float]]


def _column(value: "str | Column") -> Column:
    return F.col(value) if isinstance(value, str) else value


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    specs: Spec,
    *,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per group with ``{name: quantile}`` columns.

    ``specs`` maps an output name to ``(column, fraction)``.  Interpolation is
    linear between the two neighbouring order statistics; NULL and NaN values
    are skipped.
    """
    cleaned = {n: (F.nanvl(_column(c).cast("double"), F.lit(None)), p) for n, (c, p) in specs.items()}
    if groups_fit(df, by, group_rows):
        # one sorted value map per column serves all its fractions
        shared: dict[str, list[str]] = {}
        for name, (column, _) in specs.items():
            shared.setdefault(str(column), []).append(name)
        aggs, picks = [], {}
        for i, names in enumerate(shared.values()):
            fractions = F.array(*[F.lit(float(cleaned[n][1])) for n in names])
            aggs.append(F.percentile(cleaned[names[0]][0], fractions).alias(f"_q{i}"))
            picks |= {n: F.col(f"_q{i}")[k].alias(n) for k, n in enumerate(names)}
        return df.groupBy(*by).agg(*aggs).select(*by, *[picks[n] for n in specs])
    return _narrowed(df, list(by), cleaned, group_rows)


def medians(df: DataFrame, by: Sequence[str], columns: Mapping[str, "str | Column"], **kw) -> DataFrame:
    """Exact medians; ``columns`` maps output names to inputs."""
    return quantiles(df, by, {name: (c, 0.5) for name, c in columns.items()}, **kw)


def quantile_row(df: DataFrame, specs: Spec, **kw) -> dict[str, float]:
    """Quantiles of the whole frame as plain numbers (a fitted model)."""
    return quantiles(df, [], specs, **kw).first().asDict()


def _narrowed(df: DataFrame, by: list[str], specs: dict, group_rows: int) -> DataFrame:
    values = F.explode(F.array(*[
        F.struct(F.lit(name).alias("_series"), column.alias("_v")) for name, (column, _) in specs.items()
    ]))
    long = (
        df.select(*by, values.alias("_s"))
        .select(*by, "_s._series", "_s._v")
        .where(F.col("_v").isNotNull())
    )
    keys = [*by, "_series"]
    fraction = F.element_at(
        F.create_map(*[F.lit(x) for name, (_, p) in specs.items() for x in (name, float(p))]), F.col("_series")
    )
    # the two order statistics around position (n - 1) * p, as 1-based ranks
    position = (F.col("_n") - 1) * F.col("_p")
    targets = (
        long.groupBy(*keys)
        .agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_p", fraction)
        .withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("_rank", F.when(F.col("_side") == 0, F.floor(position)).otherwise(F.ceil(position)) + 1)
        .withColumn("_left", F.col("_n"))
    )
    slot = [*keys, "_side"]
    for _ in range(_MAX_LEVELS):
        targets = as_model(targets)
        open_targets = targets.where("_lo < _hi")
        widest = open_targets.agg(F.max("_left")).first()[0]
        if widest is None:
            break
        inside = long.join(
            open_targets.select(*slot, "_lo", "_hi", "_rank"), keys
        ).where("_v >= _lo AND _v <= _hi")
        if widest <= group_rows:
            cell = F.col("_v")
        else:
            # dividing first keeps huge spans finite; the map stays monotone
            share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
            cell = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("double")
        order = Window.partitionBy(*slot).orderBy("_cell")
        found = (
            inside.withColumn("_cell", cell)
            .groupBy(*slot, "_cell")
            .agg(
                F.count("*").alias("_c"),
                F.min("_v").alias("_blo"),
                F.max("_v").alias("_bhi"),
                F.first("_rank").alias("_r"),
            )
            .withColumn("_cum", F.sum("_c").over(order))
            .where("_cum >= _r AND _cum - _c < _r")
            .select(*slot, "_blo", "_bhi", "_c", (F.col("_r") - F.col("_cum") + F.col("_c")).alias("_nr"))
        )
        targets = (
            targets.join(found, slot, "left")
            .withColumn("_rank", F.coalesce("_nr", "_rank"))
            .withColumn("_left", F.coalesce("_c", "_left"))
            .withColumn("_lo", F.coalesce("_blo", "_lo"))
            .withColumn("_hi", F.coalesce("_bhi", "_hi"))
            .drop("_nr", "_c", "_blo", "_bhi")
        )
    weight = position - F.floor(position)
    low = F.max(F.when(F.col("_side") == 0, F.col("_lo")))
    high = F.max(F.when(F.col("_side") == 1, F.col("_lo")))
    solved = targets.groupBy(*keys).agg(
        (low + (high - low) * F.max(weight)).alias("_q")
    )
    if not by:
        return solved.groupBy().pivot("_series", list(specs)).agg(F.first("_q"))
    wide = solved.groupBy(*by).pivot("_series", list(specs)).agg(F.first("_q"))
    # groups whose values are all NULL appear too, as ``percentile`` shows them
    return df.select(*by).distinct().join(wide, by, "left")
