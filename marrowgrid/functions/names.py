"""Marker, file and condition names as expressions and channel-table jobs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrowgrid.functions.numeric import any_of, col
from marrowgrid.functions.transforms import SCATTER_PATTERNS

# Keywords of the two conditions.
PATIENT_WORDS = "PATHO|DIAG|DX|LAM|AML"
HEALTHY_WORDS = "SAIN|NORMAL|NBM|HEALTHY"
# Date patterns of file names, by priority, with the date format
# of the matched digits.
DATE_PATTERNS = (
    (r"(\d{4})[._-](\d{2})[._-](\d{2})", 3, "yyyy-MM-dd"),
    (r"(\d{2})[._-](\d{2})[._-](\d{4})", 3, "dd-MM-yyyy"),
    (r"(\d{2})[._-](\d{2})[._-](\d{2})", 3, "dd-MM-yy"),
    (r"(\d{8})", 1, "yyyyMMdd"),
)


def channel_suffix(name: "str | Column") -> Column:
    """A or H when the name carries that suffix, else an empty string."""
    return F.upper(F.regexp_extract(col(name), r"(?i)-(A|H)\b", 1))


def canonical_marker(name: "str | Column") -> Column:
    """First word of the name, with the area/height suffix kept."""
    name = F.trim(F.coalesce(col(name), F.lit("")))
    base = F.split(name, " ")[0]
    suffix = channel_suffix(name)
    missing = (suffix != "") & ~F.upper(base).rlike("-(A|H)$")
    return F.when(missing, F.concat(base, F.lit("-"), suffix)).otherwise(base)


def normalized_name(name: "str | Column") -> Column:
    """Lower case without accents, single spaces."""
    plain = F.translate(
        col(name), "àâäáãéèêëíìîïóòôöõúùûüçñÀÂÄÁÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑ", "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN")
    return F.regexp_replace(F.lower(F.trim(plain)), "  +", " ")


def safe_file_name(name: "str | Column") -> Column:
    return F.regexp_replace(col(name), r"[^A-Za-z0-9._-]", "_")


def is_scatter_name(name: "str | Column") -> Column:
    upper = F.upper(col(name))
    return any_of(upper.contains(p) for p in SCATTER_PATTERNS)


def condition_of(name: "str | Column") -> Column:
    upper = F.upper(col(name))
    return (
        F.when(upper.rlike(PATIENT_WORDS), "Pathologique").when(upper.rlike(HEALTHY_WORDS), "Sain").otherwise("Unknown")
    )


def harmonized(name: "str | Column", targets: Sequence[str]) -> Column:
    """Target marker a raw name stands for, NULL when none.

    An exact name wins; otherwise the first target the name starts with, with
    an equal area/height suffix if the target has one.
    """
    name = col(name)
    suffix = channel_suffix(name)
    hits = [F.when(name.isin(*targets), name)]
    for target in targets:
        ending = target[-1].upper() if target.upper().endswith(("-A", "-H")) else None
        base = target[:-2] if ending else target
        starts = name.rlike("(?i)^" + re.escape(base) + r"(\s|$|[^a-zA-Z0-9])")
        hits.append(F.when(starts & (suffix == ending) if ending else starts, F.lit(target)))
    found = F.coalesce(*hits)
    sharper = F.concat(found, F.lit("-"), suffix)
    bare = ~F.upper(found).rlike("-(A|H)$") & (suffix != "")
    return F.when(bare & sharper.isin(*targets), sharper).otherwise(found)


def harmonize_channels(channels: DataFrame, targets: Sequence[str], sample: str = "sample_id", name: str = "name") -> DataFrame:
    """Rename map per sample with a conflict flag (two names for one target)."""
    mapped = channels.select(sample, name).distinct().withColumn("target", harmonized(name, targets))
    hits = mapped.where(F.col("target").isNotNull())
    shared = F.count("*").over(Window.partitionBy(sample, "target"))
    return hits.withColumn("conflict", shared > 1)


def drop_height_twins(channels: DataFrame, sample: str = "sample_id", name: str = "name") -> DataFrame:
    """Channels without the ``-H`` ones that have an ``-A`` twin."""
    stem = F.regexp_replace(F.upper(name), "-(A|H)$", "")
    has_area = F.max(F.upper(name).endswith("-A")).over(Window.partitionBy(sample, stem))
    marked = channels.withColumn("_twin", has_area & F.upper(name).endswith("-H"))
    return marked.where("NOT _twin").drop("_twin")


def resolve_roles(
    channels: DataFrame, roles: dict[str, Sequence[str]], sample: str = "sample_id", name: str = "name",
    position: str = "position",
) -> DataFrame:
    """One channel per (sample, role): best pattern first, then position."""
    found = []
    for role, patterns in roles.items():
        upper = F.upper(name)
        rank = F.coalesce(*[F.when(upper.contains(p.upper()), F.lit(i)) for i, p in enumerate(patterns)])
        found.append(F.struct(F.lit(role).alias("role"), rank.alias("priority")))
    order = Window.partitionBy(sample, "role").orderBy("priority", position)
    return (
        channels.select(sample, name, position, F.explode(F.array(*found)).alias("_r"))
        .select(sample, name, position, "_r.*").where("priority IS NOT NULL")
        .withColumn("_k", F.row_number().over(order)).where("_k = 1").select(sample, "role", name)
    )


def select_markers(names: Sequence[str], whitelist: Sequence[str] | None = None, blacklist: Sequence[str] = ()) -> list[str]:
    """Markers to cluster on: the whitelist, else all but scatter, time and the blacklist."""
    if whitelist:
        return [n for n in names if any(w.upper() in n.upper() for w in whitelist)]
    banned = [*SCATTER_PATTERNS, *(b.upper() for b in blacklist)]
    return [n for n in names if not any(b in n.upper() for b in banned)]


def file_date(file: "str | Column") -> Column:
    """Date in a file name by the first pattern that gives a valid one."""
    stem = F.regexp_replace(F.regexp_extract(col(file), r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    found = []
    for pattern, groups, form in DATE_PATTERNS:
        parts = [F.regexp_extract(stem, pattern, g + 1) for g in range(groups)]
        text = F.concat_ws("-", *parts) if groups > 1 else parts[0]
        date = F.to_date(F.try_to_timestamp(text, F.lit(form)))
        if form.endswith("-yy"):
            # two-digit years from 69 on belong to the last century
            date = F.when(F.year(date) > 2068, F.add_months(date, -1200)).otherwise(date)
        found.append(F.when(stem.rlike(pattern), date))
    return F.coalesce(*found)


def timepoints(files: DataFrame, file: str = "file_origin", by: Sequence[str] = ()) -> DataFrame:
    """ISO date and chronological rank of each file; 0 when it has no date.

    ``by`` ranks within a key such as the patient.
    """
    dated = files.select(*by, file).distinct().withColumn("_d", file_date(file))
    frame = Window.partitionBy(*(by or [F.lit(0)]), F.col("_d").isNull()).orderBy("_d", file)
    return dated.select(
        *by, file,
        F.coalesce(F.date_format("_d", "yyyy-MM-dd"), F.lit("Unknown")).alias("timepoint"),
        F.when(F.col("_d").isNull(), 0).otherwise(F.row_number().over(frame)).alias("timepoint_num"))
