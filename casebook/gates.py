"""Gates, gate trees, compensation, time gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.base import ACQ, CELLS, query, rounded
from marrowgrid.functions import gates as shape
from marrowgrid.operators import aggregates as agg
from marrowgrid.operators import gating as g
from marrowgrid.sources.tables import acquisition, cells

LIMITS = """cut AS (
  SELECT quantile_cont(FSC_A, 0.02) AS f_lo, quantile_cont(FSC_A, 0.98) AS f_hi,
         quantile_cont(SSC_A, 0.02) AS s_lo, quantile_cont(SSC_A, 0.98) AS s_hi,
         quantile_cont(CD45, 0.10) AS c45, quantile_cont(CD34, 0.85) AS c34, quantile_cont(SSC_A, 0.70) AS s70,
         quantile_cont(FSC_A, 0.01) AS d_flo, quantile_cont(FSC_A, 0.99) AS d_fhi,
         quantile_cont(SSC_A, 0.01) AS d_slo, quantile_cont(SSC_A, 0.99) AS d_shi FROM cells),
masked AS (
  SELECT cells.*, FSC_A BETWEEN f_lo AND f_hi AND SSC_A BETWEEN s_lo AND s_hi AS m1,
         FSC_H > 100 AND FSC_A / FSC_H BETWEEN 0.6 AND 1.5 AS m2, CD45 > c45 AS m3, CD34 >= c34 AND SSC_A <= s70 AS m4,
         FSC_A BETWEEN d_flo AND d_fhi AND SSC_A BETWEEN d_slo AND d_shi AS m5 FROM cells, cut)"""


def _one(key, mask_sql, make):
    @query(key, f"""WITH {CELLS}, {LIMITS}
SELECT file_origin, count(*) AS n_before, count(*) FILTER ({mask_sql}) AS n_after FROM masked GROUP BY 1""")
    def run(spark, sf_dir):
        events = cells(spark, sf_dir)
        return events.groupBy("file_origin").agg(
            F.count("*").alias("n_before"), F.count_if(make(events)).alias("n_after"))


_one("G1_viable", "m1", lambda e: g.gate_viable(e, "FSC_A", "SSC_A"))
_one("G2_singlets", "m2", lambda e: g.gate_singlets("FSC_A", "FSC_H"))
_one("G3_cd45_positive", "m3", lambda e: g.gate_cd45(e, "CD45"))
_one("G4_cd34_blasts", "m4", lambda e: g.gate_cd34(e, "CD34", "SSC_A"))
_one("G5_debris_box", "m5", lambda e: g.gate_debris(e, "FSC_A", "SSC_A"))


@query("F8_singlet_ratio", f"""WITH {CELLS}
SELECT event_id, round(CASE WHEN FSC_H > 20000 THEN FSC_A / FSC_H END, 8) AS ratio FROM cells""")
def singlet_ratio(spark, sf_dir):
    ratio = g.singlet_ratio("FSC_A", "FSC_H", floor=20000.0)
    return cells(spark, sf_dir).select("event_id", F.round(ratio, 8).alias("ratio"))


@query("G14_gating_log", f"""WITH {CELLS}, {LIMITS},
t AS (SELECT condition, count(*) AS n0, count(*) FILTER (m1) AS n1, count(*) FILTER (m1 AND m2) AS n2,
             count(*) FILTER (m1 AND m2 AND m3) AS n3, count(*) FILTER (m1 AND m2 AND m3 AND m4) AS n4 FROM masked GROUP BY 1),
l AS (SELECT condition, 1 AS step, 'viable' AS gate, n0 AS n_before, n1 AS n_after FROM t
      UNION ALL SELECT condition, 2, 'singlets', n1, n2 FROM t UNION ALL SELECT condition, 3, 'cd45', n2, n3 FROM t
      UNION ALL SELECT condition, 4, 'cd34', n3, n4 FROM t)
SELECT *, round(CASE WHEN n_before > 0 THEN 100.0 * n_after / n_before ELSE 0 END, 6) AS pct_kept FROM l""")
def sequence_log(spark, sf_dir):
    events = cells(spark, sf_dir)
    log = g.gating_log(events, g.standard_masks(events), ["condition"])
    return log.withColumn("pct_kept", F.round("pct_kept", 6))


@query("G14_patient_cd34", f"""WITH {CELLS}, {LIMITS},
t AS (SELECT condition, count(*) AS n0, count(*) FILTER (m1 AND m2 AND m3) AS n3,
             count(*) FILTER (m1 AND m2 AND m3 AND (m4 OR condition <> 'Pathologique')) AS n4 FROM masked GROUP BY 1)
SELECT condition, n0 AS n_raw, n3 AS n_before, n4 AS n_after FROM t""")
def patient_cd34(spark, sf_dir):
    """The CD34 gate selects among the patients' events only; healthy marrow passes it whole."""
    events = cells(spark, sf_dir)
    log = g.gating_log(events, g.standard_masks(events, cd34_of="Pathologique"), ["condition"])
    first = log.where("gate = 'viable'").select("condition", F.col("n_before").alias("n_raw"))
    return log.where("gate = 'cd34'").join(first, "condition").select("condition", "n_raw", "n_before", "n_after")


@query("K9_gating_log_json", f"""WITH {CELLS}, {LIMITS},
t AS (SELECT count(*) AS n0, count(*) FILTER (m1) AS n1, count(*) FILTER (m1 AND m2) AS n2,
             count(*) FILTER (m1 AND m2 AND m3) AS n3, count(*) FILTER (m1 AND m2 AND m3 AND m4) AS n4 FROM masked)
SELECT 'viable' AS gate, n0 AS n_before, n1 AS n_after FROM t UNION ALL SELECT 'singlets', n1, n2 FROM t
UNION ALL SELECT 'cd45', n2, n3 FROM t UNION ALL SELECT 'cd34', n3, n4 FROM t""")
def log_json(spark, sf_dir):
    from marrowgrid.session import scratch_path
    from marrowgrid.sources.sinks import append_log

    events = cells(spark, sf_dir)
    path = scratch_path(spark, "gating_log")
    log = g.gating_log(events, g.standard_masks(events))
    for _ in range(2):  # a repeated run counts once
        append_log(log, path, run_id="r1")
    return spark.read.json(path).select("gate", "n_before", "n_after")


@query("P2_pre_gated", f"""WITH {CELLS}, {LIMITS}
SELECT file_origin, count(*) AS n, round(avg(m1::INT), 8) AS frac_viable, round(avg(m2::INT), 8) AS frac_singlets,
       count(*) FILTER (m1 AND m2) AS n_pass, round(avg((m1 AND m2)::INT), 8) AS frac_pass FROM masked GROUP BY 1""")
def pre_gated(spark, sf_dir):
    events = cells(spark, sf_dir)
    masks = g.standard_masks(events)
    marked = events.withColumns({n: masks[n] for n in ("viable", "singlets")})
    out = g.mask_report(marked, ["viable", "singlets"], ["file_origin"])
    return out.withColumns({c: F.round(c, 8) for c in ("frac_viable", "frac_singlets", "frac_pass")})


@query("P1_filter_mask", f"""WITH {CELLS}, {LIMITS} SELECT event_id, CD45, CD34 FROM masked WHERE m1 AND m4""")
def filter_mask(spark, sf_dir):
    events = cells(spark, sf_dir)
    masks = g.standard_masks(events)
    marked = events.withColumns({"viable": masks["viable"], "blast": masks["cd34"]})
    return g.pre_gated(marked, ["viable", "blast"]).select("event_id", "CD45", "CD34")


@query("P3_mask_algebra", f"""WITH {CELLS}, {LIMITS}
SELECT count(*) FILTER (m1 AND m3) AS n_and, count(*) FILTER (m1 OR m3) AS n_or, count(*) FILTER (NOT m1) AS n_not,
       round(avg((m1 AND NOT m3)::INT), 8) AS freq FROM masked""")
def mask_algebra(spark, sf_dir):
    events = cells(spark, sf_dir)
    masks = g.standard_masks(events)
    a, b = masks["viable"], masks["cd45"]
    return events.agg(
        F.count_if(a & b).alias("n_and"), F.count_if(a | b).alias("n_or"), F.count_if(~a).alias("n_not"),
        F.round(F.avg((a & ~b).cast("double")), 8).alias("freq"))


FLAGS = """pat AS (SELECT * FROM cells WHERE condition = 'Pathologique'),
pc AS (SELECT quantile_cont(CD45, 0.05) AS neg, quantile_cont(CD45, 0.15) AS dim, quantile_cont(CD34, 0.85) AS c34,
              quantile_cont(FSC_A, 0.05) AS f5, quantile_cont(SSC_A, 0.05) AS s5 FROM pat),
flags AS (SELECT pat.*, CASE WHEN CD45 < neg THEN 3.0 WHEN CD45 < dim THEN 2.0 ELSE 1.0 END::DOUBLE AS cd45_status,
       CASE WHEN CD34 >= c34 THEN 1.0 ELSE 0.0 END::DOUBLE AS cd34_status,
       CASE WHEN FSC_A < f5 AND SSC_A < s5 THEN 1.0 ELSE 0.0 END::DOUBLE AS debris_flag,
       CASE WHEN FSC_H > 0 AND FSC_A / FSC_H > 1.2 THEN 1.0 ELSE 0.0 END::DOUBLE AS doublet_flag FROM pat, pc)"""


@query("P9_status_flags", f"""WITH {CELLS}, {FLAGS}
SELECT event_id, cd45_status, cd34_status, debris_flag, doublet_flag FROM flags""")
def status_flags(spark, sf_dir):
    patient = cells(spark, sf_dir).where(F.col("condition") == "Pathologique")
    return g.status_flags(patient).select("event_id", "cd45_status", "cd34_status", "debris_flag", "doublet_flag")


# --- user gates --------------------------------------------------------------

POLYGON = [(10000.0, 5.0), (90000.0, 10.0), (80000.0, 45.0), (30000.0, 48.0), (15000.0, 30.0)]
CENTER, INVERSE, RADIUS = [40000.0, 25.0], [[2.0e-9, -1.0e-6], [-1.0e-6, 6.0e-3]], 1.5


def tree() -> g.GateTree:
    quad = shape.quadrants("CD45", "CD34", 4.5, 3.5)
    out = (
        g.GateTree()
        .add("scatter", shape.in_polygon("FSC_A", "SSC_A", POLYGON))
        .add("core", shape.in_ellipse(["FSC_A", "SSC_A"], CENTER, INVERSE, RADIUS), "scatter")
        .add("bright", shape.in_range("CD45", 2.5, 8.5), "scatter")
        .add("box", shape.in_rectangle("HLA_DR", "CD34", (500.0, 1500.0), (0.5, 6.5)), "bright")
    )
    for name, condition in quad.items():
        out.add(f"cd_{name}", condition, "bright")
    out.add_boolean("diagonal", "or", ["cd_Q1_PosPos", "cd_Q3_NegNeg"])
    out.add_boolean("core_bright", "and", ["core", "bright"])
    out.add_boolean("not_core", "not", ["core"], "scatter")
    return out


def _edges() -> str:
    terms = []
    for (x1, y1), (x2, y2) in zip(POLYGON, POLYGON[1:] + POLYGON[:1]):
        slope = (x2 - x1) / (y2 - y1)
        terms.append(f"(CASE WHEN ({y1} > SSC_A) <> ({y2} > SSC_A) AND FSC_A < {x1} + (SSC_A - {y1}) * {slope!r} THEN 1 ELSE 0 END)")
    return " + ".join(terms)


TREE = f"""raw AS (
  SELECT *, ({_edges()}) % 2 = 1 AS scatter, FSC_A - 40000.0 AS dx, SSC_A - 25.0 AS dy FROM cells),
a AS (SELECT *, scatter AND dx * dx * 2.0e-9 - 2 * dx * dy * 1.0e-6 + dy * dy * 6.0e-3 <= 1.5 AS core,
             scatter AND CD45 >= 2.5 AND CD45 < 8.5 AS bright FROM raw),
gates AS (SELECT *, bright AND HLA_DR >= 500 AND HLA_DR < 1500 AND CD34 >= 0.5 AND CD34 < 6.5 AS box,
    bright AND CD45 >= 4.5 AND CD34 >= 3.5 AS q1, bright AND CD45 < 4.5 AND CD34 >= 3.5 AS q2,
    bright AND CD45 < 4.5 AND CD34 < 3.5 AS q3, bright AND CD45 >= 4.5 AND CD34 < 3.5 AS q4 FROM a)"""

_LIST = [
    ("scatter", "root", "root", "scatter", "root/scatter"),
    ("core", "scatter", "root", "core", "root/scatter/core"),
    ("bright", "scatter", "root", "bright", "root/scatter/bright"),
    ("box", "bright", "scatter", "box", "root/scatter/bright/box"),
    ("cd_Q1_PosPos", "bright", "scatter", "q1", "root/scatter/bright/cd_Q1_PosPos"),
    ("cd_Q2_NegPos", "bright", "scatter", "q2", "root/scatter/bright/cd_Q2_NegPos"),
    ("cd_Q3_NegNeg", "bright", "scatter", "q3", "root/scatter/bright/cd_Q3_NegNeg"),
    ("cd_Q4_PosNeg", "bright", "scatter", "q4", "root/scatter/bright/cd_Q4_PosNeg"),
    ("diagonal", "root", "root", "q1 OR q3", "root/diagonal"),
    ("core_bright", "root", "root", "core AND bright", "root/core_bright"),
    ("not_core", "scatter", "root", "scatter AND NOT core", "root/scatter/not_core"),
]
_EXPR = {"root": "TRUE"} | {name: e for name, _, _, e, _ in _LIST}
TREE_COUNTS = " UNION ALL ".join(
    f"SELECT file_origin, '{n}' AS gate, '{p}' AS parent, '{path}' AS path, count(*) FILTER ({e}) AS n, "
    f"round(100.0 * count(*) FILTER ({e}) / nullif(count(*) FILTER ({_EXPR[p]}), 0), 6) AS pct_parent, "
    f"round(100.0 * count(*) FILTER ({e}) / nullif(count(*) FILTER ({_EXPR[gp]}), 0), 6) AS pct_grandparent "
    f"FROM gates GROUP BY file_origin" for n, p, gp, e, path in _LIST)


@query("G16_gate_tree", f"WITH {CELLS}, {TREE} {TREE_COUNTS}")
def gate_tree(spark, sf_dir):
    out = tree().counts(cells(spark, sf_dir), ["file_origin"])
    return out.withColumns({"pct_parent": F.round("pct_parent", 6), "pct_grandparent": F.round("pct_grandparent", 6)})


@query("J9_parent_counts", f"""WITH {CELLS}, {TREE}, t AS ({TREE_COUNTS}),
s AS (SELECT gate, parent, sum(n) AS n FROM t GROUP BY 1, 2)
SELECT s.gate, CAST(s.n AS BIGINT) AS n, CAST(coalesce(p.n, 0) AS BIGINT) AS n_parent,
       CAST(coalesce(gp.n, 0) AS BIGINT) AS n_grandparent
FROM s LEFT JOIN s p ON s.parent = p.gate LEFT JOIN s gp ON p.parent = gp.gate""")
def parent_counts(spark, sf_dir):
    counts = tree().counts(cells(spark, sf_dir)).select("gate", "parent", "n")
    parent = counts.select(F.col("gate").alias("parent"), F.col("n").alias("n_parent"), F.col("parent").alias("gp"))
    above = counts.select(F.col("gate").alias("gp"), F.col("n").alias("n_grandparent"))
    linked = counts.join(parent, "parent", "left").join(above, "gp", "left")
    return linked.select("gate", "n", "n_parent", "n_grandparent").na.fill(0)


@query("G12_user_gates", f"""WITH {CELLS}, {TREE}
SELECT event_id, core, box, q2, coalesce(scatter AND NOT core, FALSE) AS not_core FROM gates WHERE bright""")
def user_gates(spark, sf_dir):
    t = tree()
    return t.rows(cells(spark, sf_dir), "bright").select(
        "event_id", t.mask("core").alias("core"), t.mask("box").alias("box"), t.mask("cd_Q2_NegPos").alias("q2"),
        t.mask("not_core").alias("not_core"))


@query("S9_gated_population", f"WITH {CELLS}, {TREE} SELECT event_id, FSC_A, SSC_A, CD45 FROM gates WHERE box")
def gated_population(spark, sf_dir):
    return tree().population(cells(spark, sf_dir), "box").select("event_id", "FSC_A", "SSC_A", "CD45")


@query("U5_quadrant_union", f"WITH {CELLS}, {TREE} SELECT file_origin, count(*) AS n FROM gates WHERE q1 OR q3 GROUP BY 1")
def quadrant_union(spark, sf_dir):
    return tree().rows(cells(spark, sf_dir), "diagonal").groupBy("file_origin").agg(F.count("*").alias("n"))


@query("G17_assign_children", f"""WITH {CELLS}, {TREE}
SELECT file_origin, CASE WHEN q4 THEN 'cd_Q4_PosNeg' WHEN q3 THEN 'cd_Q3_NegNeg' WHEN q2 THEN 'cd_Q2_NegPos'
    WHEN q1 THEN 'cd_Q1_PosPos' WHEN box THEN 'box' ELSE 'other' END AS child, count(*) AS n
FROM gates WHERE bright GROUP BY 1, 2""")
def assign_children(spark, sf_dir):
    found = tree().assigned(cells(spark, sf_dir), "bright", "other")
    return found.groupBy("file_origin", "child").agg(F.count("*").alias("n"))


MEMBERS = " UNION ALL ".join(
    f"SELECT file_origin, '{n}' AS gate, CD45, HLA_DR FROM gates WHERE {e}" for n, _, _, e, _ in _LIST)
GATE_STATS = """gs AS (
  SELECT file_origin, gate, 'CD45' AS channel, median(CD45) AS median,
         100.0 * stddev_samp(CD45) / nullif(avg(CD45), 0) AS cv FROM members GROUP BY 1, 2
  UNION ALL SELECT file_origin, gate, 'HLA_DR', median(HLA_DR), 100.0 * stddev_samp(HLA_DR) / nullif(avg(HLA_DR), 0)
  FROM members GROUP BY 1, 2)"""


def gate_stats_table(spark, sf_dir):
    members = tree().members(cells(spark, sf_dir), ["file_origin"], ["CD45", "HLA_DR"])
    out = agg.gate_statistics(members, ["file_origin"], ["CD45", "HLA_DR"])
    return out.withColumns({"median": F.round("median", 6), "cv": F.round("cv", 6)})


@query("A13_gate_statistics", f"""WITH {CELLS}, {TREE}, members AS ({MEMBERS}), {GATE_STATS}
SELECT file_origin, gate, channel, round(median, 6) AS median, round(cv, 6) AS cv FROM gs""")
def gate_statistics(spark, sf_dir):
    return gate_stats_table(spark, sf_dir)


@query("K10_gate_statistics_csv", f"""WITH {CELLS}, {TREE}, members AS ({MEMBERS}), {GATE_STATS}
SELECT gate, channel, count(*) AS n_files, round(avg(median), 4) AS mean_median FROM gs GROUP BY 1, 2""")
def gate_statistics_csv(spark, sf_dir):
    from marrowgrid.session import scratch_path
    from marrowgrid.sources.sinks import write_csv

    path = scratch_path(spark, "gate_stats")
    table = gate_stats_table(spark, sf_dir)
    write_csv(table, path)
    back = spark.read.schema(table.schema).csv(path, header=True)
    return back.groupBy("gate", "channel").agg(
        F.count("*").alias("n_files"), F.round(F.avg("median"), 4).alias("mean_median"))


@query("A15_stage_flow", f"""WITH {CELLS}, {LIMITS}
SELECT file_origin, count(*) AS n_start, count(*) FILTER (m1) AS n_viable, count(*) FILTER (m1 AND m2) AS n_singlets,
       count(*) FILTER (m1 AND m2 AND m3) AS n_cd45, count(*) FILTER (m1 AND m2 AND m3 AND m4) AS n_cd34
FROM masked GROUP BY CUBE (file_origin)""")
def stage_flow(spark, sf_dir):
    events = cells(spark, sf_dir)
    return agg.stage_flow(events, g.standard_masks(events), "file_origin")


# --- time gate, compensation -------------------------------------------------

SPILL = [[1.0, 0.12, 0.03], [0.08, 1.0, 0.20], [0.01, 0.15, 1.0]]


@query("G13_time_gate", f"""WITH {ACQ},
span AS (SELECT sample_id, min(time) AS t0, max(time) AS t1, greatest(100, floor(count(*) / 200)) AS bins FROM acq GROUP BY 1),
p AS (SELECT acq.*, t1, least(floor((time - t0) / ((t1 - t0) / bins)), bins - 1) AS bin FROM acq JOIN span USING (sample_id)),
c AS (SELECT sample_id, bin, count(*) AS n FROM p GROUP BY 1, 2),
s AS (SELECT sample_id, median(n) AS m, stddev_pop(n) AS sd FROM c GROUP BY 1),
bad AS (SELECT sample_id, bin FROM c JOIN s USING (sample_id) WHERE abs(n - m) > 1.5 * sd)
SELECT event_id, sample_id, signal FROM p ANTI JOIN bad USING (sample_id, bin)
UNION ALL SELECT event_id, sample_id, signal FROM p SEMI JOIN bad USING (sample_id, bin) WHERE time >= t1""")
def time_gate(spark, sf_dir):
    out = g.time_gate(acquisition(spark, sf_dir), "sample_id", "time", n_sigma=1.5, rows_per_bin=200)
    return out.select("event_id", "sample_id", "signal")


def _inverse_sql() -> str:
    import numpy as np

    inv = np.linalg.inv(np.array(SPILL))
    names = ["CD45", "CD34", "HLA_DR"]
    return ", ".join(
        "round(" + " + ".join(f"({float(inv[i][j])!r}) * {names[i]}" for i in range(3)) + f", 6) + 0.0 AS {names[j]}"
        for j in range(3))


@query("F7_compensation", f"WITH {CELLS} SELECT event_id, {_inverse_sql()} FROM cells")
def compensation(spark, sf_dir):
    names = ["CD45", "CD34", "HLA_DR"]
    out = g.compensate(cells(spark, sf_dir), names, SPILL)
    return out.select("event_id", *[rounded(n, 6).alias(n) for n in names])


@query("F7_compensation_by_sample", f"""WITH {CELLS}
SELECT event_id, round(CASE WHEN patient_id < 5 THEN (CD45 - 0.1 * CD34) / (1 - 0.02) ELSE CD45 END, 6) + 0.0 AS CD45,
       round(CASE WHEN patient_id < 5 THEN (CD34 - 0.2 * CD45) / (1 - 0.02) ELSE CD34 END, 6) + 0.0 AS CD34 FROM cells""")
def compensation_by_sample(spark, sf_dir):
    matrices = {p: [[1.0, 0.2], [0.1, 1.0]] for p in range(5)}
    out = g.compensate_by(cells(spark, sf_dir), ["CD45", "CD34"], matrices, "patient_id")
    return out.select("event_id", *[rounded(n, 6).alias(n) for n in ("CD45", "CD34")])


@query("G18_spillover_controls", """WITH m AS (
  SELECT l_returnflag AS stain, median(l_extendedprice) AS d1, median(l_quantity * 900) AS d2, median(l_tax * 100000) AS d3
  FROM lineitem GROUP BY 1)
SELECT stain, round(CASE WHEN stain = 'A' THEN 1.0 ELSE d1 / CASE stain WHEN 'N' THEN d2 ELSE d3 END END, 8) AS d1,
       round(CASE WHEN stain = 'N' THEN 1.0 ELSE d2 / CASE stain WHEN 'A' THEN d1 ELSE d3 END END, 8) AS d2,
       round(CASE WHEN stain = 'R' THEN 1.0 ELSE d3 / CASE stain WHEN 'A' THEN d1 ELSE d2 END END, 8) AS d3 FROM m""")
def spillover_controls(spark, sf_dir):
    from marrowgrid.sources.tables import table

    controls = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("stain"), F.col("l_extendedprice").alias("d1"),
        (F.col("l_quantity") * 900).alias("d2"), (F.col("l_tax") * 100000).alias("d3"))
    out = g.spillover_from_controls(controls, "stain", {"A": "d1", "N": "d2", "R": "d3"})
    return out.withColumns({d: F.round(d, 8) for d in ("d1", "d2", "d3")})
