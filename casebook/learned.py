"""Learnt gates, unmixing, embeddings, files, streams, full runs."""

from __future__ import annotations


import numpy as np
from pyspark.sql import functions as F

from casebook import statements as stm
from casebook.base import CELLS, NODES, query, rounded
from casebook.models import MAP_NEAREST, OTSU, POPS, VEC, marker_vectors, node_sizes, nodes_long, populations_long
from casebook.residual import _SUMMARY, MED, SCORED, _rounded, node_z
from marrowgrid.functions.vectors import vector
from marrowgrid.operators import autogate as ag
from marrowgrid.operators import embed as em
from marrowgrid.operators import mrd, som, unmix
from marrowgrid.operators.gating import standard_masks
from marrowgrid.operators.selection import hash_order
from marrowgrid.plans import cohort_run as run
from marrowgrid.session import scratch_path, staged
from marrowgrid.sources import fcs, readers, sinks
from marrowgrid.sources.tables import MARKERS, cells, table, vectors
from marrowgrid.streaming import jobs

def order():
    return hash_order("event_id")


@query("G6_debris_mixture")
def debris_mixture(spark, sf_dir):
    marked, report = ag.auto_debris_mixture(cells(spark, sf_dir), "FSC_A", "SSC_A")
    return marked.groupBy("condition").agg(
        F.count("*").alias("n"), F.count_if("not_debris").alias("n_kept"), F.lit(report["components"]).alias("components"))


@query("G7_debris_density", stm.DENSITY)
def debris_density(spark, sf_dir):
    marked = ag.auto_debris_density(cells(spark, sf_dir), "FSC_A", "HLA_DR")
    return marked.groupBy("condition").agg(F.count("*").alias("n"), F.count_if("not_debris").alias("n_kept"))


@query("G8_robust_singlets")
def robust_singlets(spark, sf_dir):
    events = cells(spark, sf_dir)
    _, report = ag.auto_singlets(events, "file_origin", "FSC_A", "FSC_H", order(), valid=standard_masks(events)["viable"])
    return report


@query("G9_cd45_density", f"""WITH {CELLS}, vals AS (SELECT condition AS g, {stm.LOG} AS v FROM cells), {stm.left_foot_ctes('condition')}
SELECT condition, count(*) AS n, count(*) FILTER ({stm.LOG} >= threshold) AS n_pos, round(any_value(threshold), 6) AS threshold,
       'kde_foot' AS method, any_value(n_values) AS n_values FROM cells JOIN cut USING (condition) GROUP BY 1""")
def cd45_density(spark, sf_dir):
    marked, cuts = ag.auto_cd45(cells(spark, sf_dir), "HLA_DR", ["condition"])
    counts = marked.groupBy("condition").agg(F.count("*").alias("n"), F.count_if("cd45_pos").alias("n_pos"))
    return counts.join(cuts, "condition").withColumn("threshold", F.round("threshold", 6))


@query("G10_cd34_density", f"""WITH {CELLS}, vals AS (SELECT condition AS g, FSC_A AS v FROM cells), {stm.right_foot_ctes()}
SELECT condition, count(*) AS n, count(*) FILTER (FSC_A >= threshold) AS n_pos, round(any_value(threshold), 4) AS threshold,
       any_value(method) AS method, any_value(n_values) AS n_values FROM cells JOIN cut ON condition = g GROUP BY 1""")
def cd34_density(spark, sf_dir):
    marked, cuts = ag.auto_cd34(cells(spark, sf_dir), "FSC_A", ["condition"])
    return marked.groupBy("condition").agg(F.count("*").alias("n"), F.count_if("cd34_pos").alias("n_pos")).join(
        cuts.withColumn("threshold", F.round("threshold", 4)), "condition")


@query("G11_cd34_mixture")
def cd34_mixture(spark, sf_dir):
    marked, cuts = ag.auto_cd34(cells(spark, sf_dir), "FSC_A", ["patient_id"], "mixture", ssc="SSC_A")
    return marked.groupBy("patient_id").agg(F.count("*").alias("n"), F.count_if("cd34_pos").alias("n_pos")).join(cuts, "patient_id")


@query("G11_cd34_in_dim")
def cd34_in_dim(spark, sf_dir):
    return ag.prescreen(cells(spark, sf_dir), "FSC_A", "HLA_DR", ["patient_id"], "mixture", inside=True)


@query("G15_prescreening", f"""WITH {CELLS}, vals AS (SELECT patient_id AS g, FSC_A AS v FROM cells), {stm.right_foot_ctes()},
dim AS (SELECT patient_id, quantile_cont(HLA_DR, 0.05) AS lo, quantile_cont(HLA_DR, 0.4) AS hi FROM cells GROUP BY 1),
c AS (SELECT patient_id, count(*) AS n_valid, count(*) FILTER (HLA_DR BETWEEN dim.lo AND dim.hi) AS n_cd45dim,
             count(*) FILTER (HLA_DR BETWEEN dim.lo AND dim.hi AND FSC_A >= threshold) AS n_cd34_pos,
             any_value(threshold) AS threshold, any_value(method) AS method
      FROM cells JOIN dim USING (patient_id) JOIN cut ON patient_id = g GROUP BY 1)
SELECT patient_id, n_valid, n_cd45dim, n_cd34_pos, round(n_cd34_pos / greatest(n_cd45dim, 1), 8) AS ratio,
       CASE WHEN n_cd34_pos / greatest(n_cd45dim, 1) >= 0.15 THEN 'high' WHEN n_cd34_pos / greatest(n_cd45dim, 1) >= 0.05 THEN 'moderate' ELSE 'none' END AS alert,
       round(threshold, 4) AS threshold, method FROM c WHERE n_valid >= 200""")
def prescreening(spark, sf_dir):
    out = ag.prescreen(cells(spark, sf_dir), "FSC_A", "HLA_DR", ["patient_id"])
    return out.withColumns({"ratio": F.round("ratio", 8), "threshold": F.round("threshold", 4)})


@query("G19_raw_cd45_count", f"""WITH {CELLS}, vals AS (SELECT 0 AS g, {stm.LOG} AS v FROM cells), {stm.left_foot_ctes('g')}
SELECT file_origin, count(*) AS n, count(*) FILTER ({stm.LOG} >= threshold) AS n_pos FROM cells, cut GROUP BY 1""")
def raw_cd45_count(spark, sf_dir):
    marked, _ = ag.auto_cd45(cells(spark, sf_dir), "HLA_DR")
    return marked.groupBy("file_origin").agg(F.count("*").alias("n"), F.count_if("cd45_pos").alias("n_pos"))


# --- unmixing ----------------------------------------------------------------

SPECTRA = np.array([[0.80, 0.50, 0.20, 0.10, 0.05], [0.10, 0.60, 0.70, 0.30, 0.10], [0.05, 0.10, 0.30, 0.70, 0.60]])
DETECTORS = [f"d{i}" for i in range(5)]


def mixed(spark, sf_dir):
    """Detector readings made of three known abundances."""
    parts = [F.col("SSC_A"), F.col("CD45"), F.col("CD34")]
    made = [sum((p * float(SPECTRA[j, i]) for j, p in enumerate(parts)), F.lit(0.0)).alias(d) for i, d in enumerate(DETECTORS)]
    return cells(spark, sf_dir).select("event_id", *made)


@query("F13_unmix_nonnegative", f"""WITH {CELLS} SELECT event_id, round(SSC_A, 4) AS a, round(CD45, 4) + 0.0 AS b, round(CD34, 4) + 0.0 AS c,
   0.0::DOUBLE AS residual FROM cells""")
def unmix_nonnegative(spark, sf_dir):
    out = unmix.non_negative(mixed(spark, sf_dir), DETECTORS, SPECTRA, ["a", "b", "c"])
    return out.withColumns({n: F.round(n, 4) + 0.0 for n in ("a", "b", "c", "residual")})


@query("F13_unmix_least_squares", f"""WITH {CELLS} SELECT event_id, round(SSC_A, 4) AS a, round(CD45, 4) + 0.0 AS b, round(CD34, 4) + 0.0 AS c FROM cells""")
def unmix_least_squares(spark, sf_dir):
    out = unmix.least_squares(mixed(spark, sf_dir), DETECTORS, SPECTRA, ["a", "b", "c"])
    return out.select("event_id", *[(F.round(n, 4) + 0.0).alias(n) for n in ("a", "b", "c")])


PAIR = [[0.9, 0.3, 0.2], [0.3, 0.8, 0.5]]


def _pair_sql():
    """Both sources, else the one that satisfies the conditions of optimality, else none."""
    g = (np.array(PAIR) @ np.array(PAIR).T).tolist()
    t = [" + ".join(f"{PAIR[j][i]!r} * {d}" for i, d in enumerate(("CD45", "CD34", "HLA_DR / 20000"))) for j in (0, 1)]
    return f"""t AS (SELECT event_id, {t[0]} AS t1, {t[1]} AS t2, CD45 AS d0, CD34 AS d1, HLA_DR / 20000 AS d2 FROM cells),
free AS (SELECT *, (t1 * {g[1][1]!r} - t2 * {g[0][1]!r}) / {g[0][0] * g[1][1] - g[0][1] ** 2!r} AS u,
                (t2 * {g[0][0]!r} - t1 * {g[0][1]!r}) / {g[0][0] * g[1][1] - g[0][1] ** 2!r} AS w FROM t),
x AS (SELECT *, CASE WHEN u >= 0 AND w >= 0 THEN u WHEN w < 0 AND t1 > 0 AND t1 / {g[0][0]!r} * {g[0][1]!r} >= t2 THEN t1 / {g[0][0]!r} ELSE 0 END AS a,
                CASE WHEN u >= 0 AND w >= 0 THEN w WHEN u < 0 AND t2 > 0 AND t2 / {g[1][1]!r} * {g[0][1]!r} >= t1 THEN t2 / {g[1][1]!r} ELSE 0 END AS b FROM free)"""


@query("F13_unmix_constrained", f"""WITH {CELLS}, {_pair_sql()}
SELECT event_id, round(a, 4) + 0.0 AS a, round(b, 4) + 0.0 AS b, least(u, w) < 0 AS bound,
   round(sqrt({" + ".join(f"power(d{i} - {PAIR[0][i]!r} * a - {PAIR[1][i]!r} * b, 2)" for i in range(3))}), 4) AS residual FROM x""")
def unmix_constrained(spark, sf_dir):
    """Readings that no positive mixture explains: the unconstrained abundance of one source is often negative."""
    events = cells(spark, sf_dir).select("event_id", F.col("CD45").alias("d0"), F.col("CD34").alias("d1"), (F.col("HLA_DR") / 20000).alias("d2"))
    out = unmix.non_negative(events, ["d0", "d1", "d2"], np.array(PAIR), ["a", "b"])
    free = unmix.least_squares(events, ["d0", "d1", "d2"], np.array(PAIR), ["u", "w"]).select("event_id", (F.least("u", "w") < 0).alias("bound"))
    return out.join(free, "event_id").select("event_id", rounded("a", 4).alias("a"), rounded("b", 4).alias("b"), "bound", F.round("residual", 4).alias("residual"))


# --- embeddings and clusterings ----------------------------------------------


@query("C12_pca")
def pca(spark, sf_dir):
    scored, shares = em.pca(vectors(spark, sf_dir).select("vec_id", "x"), 4)
    return scored.select("vec_id", *[F.round(F.abs(F.col("pc")[i]), 5).alias(f"pc{i + 1}") for i in range(4)])


@query("C13_batch_correction")
def batch_correction(spark, sf_dir):
    """Share of variance between files' sites before and after correction."""
    shifted = cells(spark, sf_dir).select(
        "event_id", (F.col("patient_id") % 3).alias("batch"), (F.col("SSC_A") + (F.col("patient_id") % 3) * 6).alias("SSC_A"), "HLA_DR")
    fixed = staged(em.correct_batches(shifted, ["SSC_A"], "batch", clusters=6), "corrected")
    before = em.batch_spread(shifted, ["SSC_A"], "batch").withColumn("stage", F.lit("before"))
    return before.unionByName(em.batch_spread(fixed, ["SSC_A"], "batch").withColumn("stage", F.lit("after")))


@query("L5_density_sample", f"""WITH {VEC}, pair AS (SELECT a.vec_id, list_distance(a.x, b.x) AS d FROM v a, v b WHERE a.vec_id <> b.vec_id),
nn AS (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d) <= 4),
w AS (SELECT vec_id, avg(d) AS w FROM nn GROUP BY 1),
u AS (SELECT vec_id, w, (('0x' || substr(md5(concat_ws('|', '42', vec_id)), 1, 12))::BIGINT + 1) / (pow(16, 12) + 1) AS u FROM w)
SELECT vec_id, label AS population FROM u JOIN embeddings USING (vec_id) ORDER BY -ln(u) / w LIMIT 200""")
def density_sample(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", "population", "x")
    return em.density_sample(v, "vec_id", 200, hash_order("vec_id")).select("vec_id", "population")


@query("L5_density_weights", f"""WITH {VEC}, pair AS (SELECT a.vec_id, list_distance(a.x, b.x) AS d FROM v a, v b WHERE a.vec_id <> b.vec_id),
nn AS (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d) <= 4)
SELECT vec_id, round(avg(d), 6) AS weight FROM nn GROUP BY 1""")
def density_weights(spark, sf_dir):
    return em.density_weights(vectors(spark, sf_dir), "vec_id").withColumn("weight", F.round("weight", 6))


@query("C11_density_clusters")
def density_clusters(spark, sf_dir):
    points = vectors(spark, sf_dir).select("vec_id", "x")
    out = em.density_clusters(points, "vec_id", 6, -(-points.count() // 10), hash_order("vec_id"))
    return out.groupBy("cluster").agg(F.count("*").alias("n"))


@query("C15_noise_reassignment", f"""WITH {POPS}, kn AS (SELECT population, marker, avg(val) AS m FROM e WHERE vec_id % 4 <> 0 GROUP BY 1, 2),
ck AS (SELECT population, list(m ORDER BY marker) AS code FROM kn GROUP BY 1),
d AS (SELECT vec_id, ck.population, list_distance(x, code) AS d FROM v, ck WHERE vec_id % 4 = 0)
SELECT vec_id, arg_min(population, d) AS label FROM d GROUP BY 1 UNION ALL SELECT vec_id, population FROM v WHERE vec_id % 4 <> 0""")
def noise_reassignment(spark, sf_dir):
    label = F.when(F.col("vec_id") % 4 == 0, -1).otherwise(F.col("population"))
    return em.reassign_noise(vectors(spark, sf_dir).select("vec_id", "x", label.alias("label")), "label")


@query("A22_silhouette", f"""WITH {VEC},
c AS (SELECT population, marker, avg(val) AS m, avg(val * val) AS s, count(*) AS n FROM e GROUP BY 1, 2),
cd AS (SELECT v.vec_id, v.population AS own, c.population AS other, any_value(c.n) AS n, sum(e.val * e.val - 2 * e.val * c.m + c.s) AS d
       FROM v JOIN e USING (vec_id) JOIN c USING (marker) GROUP BY 1, 2, 3),
s AS (SELECT vec_id, max(CASE WHEN own = other THEN d * n / (n - 1) END) AS a, min(CASE WHEN own <> other THEN d END) AS b FROM cd GROUP BY 1)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s""")
def silhouette(spark, sf_dir):
    score = em.silhouette_score(vectors(spark, sf_dir), "population")
    return spark.range(1).select(F.round(F.lit(score), 6).alias("silhouette"))


@query("C9_kmeans_codebook")
def kmeans_codebook(spark, sf_dir):
    events = marker_vectors(spark, sf_dir)
    model = som.fit_kmeans_codebook(events, xdim=5, ydim=5)
    return model.transform(events).groupBy("node_id").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 4).alias("mean_distance"))


@query("T6_lasso_importance")
def lasso(spark, sf_dir):
    from marrowgrid.operators.aggregates import sample_features

    feats = sample_features(cells(spark, sf_dir), "file_origin", "metacluster", range(10), ["HLA_DR"])
    ends = cells(spark, sf_dir).groupBy("file_origin").agg(F.avg((F.col("condition") == "Sain").cast("double")).alias("share"))
    joined = staged(feats.join(ends, "file_origin"), "features")
    return em.lasso_importance(joined, [c for c in joined.columns if c not in ("file_origin", "share")], "share", continuous=True)


@query("T7_stratifying_clusters")
def stratifying(spark, sf_dir):
    events = cells(spark, sf_dir).withColumn("endpoint", (F.xxhash64("file_origin") % 2 == 0).cast("int"))
    scaled = events.select("event_id", "file_origin", "endpoint", (F.col("CD45") / 10).alias("CD45"), (F.col("HLA_DR") / 2000).alias("HLA_DR"))
    return em.stratifying_clusters(scaled, "file_origin", "endpoint", ["CD45", "HLA_DR"], order(), clusters=8)


# --- files -------------------------------------------------------------------


BROKEN = b"FCS3.1 but nothing after it"


def fcs_folder(spark, sf_dir):
    """FCS files written by Spark from the events, one per patient, and one broken file."""
    from marrowgrid.sources.fcs import _file_system, _qualified

    folder = scratch_path(spark, "fcs")
    source = cells(spark, sf_dir).withColumn("file", F.concat(F.lit("P"), "patient_id")).select("file", "event_id", *MARKERS)
    report = fcs.write_fcs(source, folder, "file", key=["event_id"])
    system, path = _file_system(_qualified(spark, folder))
    with system.open_output_stream(f"{path}/broken.fcs") as out:
        out.write(BROKEN)
    return folder, report


@query("K5_fcs_export", f"WITH {CELLS} SELECT 'P' || patient_id AS file, count(*) AS n_events FROM cells GROUP BY 1")
def fcs_export(spark, sf_dir):
    """Rows that the committed files hold, by their own headers."""
    folder, report = fcs_folder(spark, sf_dir)
    held = fcs.headers(spark, folder).where("error IS NULL").select(F.concat(F.lit("P"), F.regexp_extract("sample_id", r"P(.*)\.fcs", 1)).alias("file"), "n_events")
    return held.join(report.select("file").distinct(), "file", "left_semi").groupBy("file").agg(F.sum("n_events").alias("n_events"))


@query("S1_discover_fcs", "SELECT DISTINCT 'P' || (l_suppkey % 10) || '.fcs' AS name FROM lineitem UNION ALL SELECT 'broken.fcs'")
def discover_fcs(spark, sf_dir):
    folder, _ = fcs_folder(spark, sf_dir)
    return fcs.discover(spark, folder).select("name")


@query("S2_load_fcs", f"""WITH {CELLS} SELECT 'P' || patient_id || '.fcs' AS sample_id, count(*) AS n, round(sum(CAST(FSC_A AS FLOAT)::DOUBLE), 2) AS fsc,
   round(sum(CAST(CD34 AS FLOAT)::DOUBLE), 4) AS cd34, max(CAST(HLA_DR AS FLOAT))::DOUBLE AS top, 'Pathologique' AS condition FROM cells GROUP BY 1""")
def load_fcs(spark, sf_dir):
    folder, _ = fcs_folder(spark, sf_dir)
    events, _ = fcs.read_events(spark, folder, "Pathologique")
    return events.groupBy("sample_id", "condition").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("FSC_A").cast("double")), 2).alias("fsc"),
        F.round(F.sum(F.col("CD34").cast("double")), 4).alias("cd34"), F.max("HLA_DR").cast("double").alias("top"))


@query("S2_ingest_errors", f"""WITH {CELLS} SELECT 'P' || patient_id || '.fcs' AS sample_id, count(*) AS n, false AS failed FROM cells GROUP BY 1
   UNION ALL SELECT 'broken.fcs', 0, true""")
def ingest_errors(spark, sf_dir):
    """Every file of the folder with its events; one that cannot be read is told, not fatal."""
    folder, _ = fcs_folder(spark, sf_dir)
    events, errors = fcs.read_events(spark, folder, names=["CD45"])
    good = events.groupBy("sample_id").agg(F.count("*").alias("n"), F.lit(False).alias("failed"))
    return good.unionByName(errors.select("sample_id", F.lit(0).cast("long").alias("n"), F.col("error").isNotNull().alias("failed")))


@query("S2_split_files", f"""WITH {CELLS} SELECT 'P' || patient_id || '.fcs' AS sample_id, count(*) AS n, CAST(ceil(count(*) / 1000) AS BIGINT) AS tasks,
   count(*) - 1 AS last_event, round(sum(CAST(CD45 AS FLOAT)::DOUBLE), 4) AS cd45 FROM cells GROUP BY 1""")
def split_files(spark, sf_dir):
    """One file is read by several tasks, here one per thousand events."""
    folder, _ = fcs_folder(spark, sf_dir)
    events, _ = fcs.read_events(spark, folder, names=["CD45"], split_bytes=1000 * 4 * len(MARKERS))
    return events.withColumn("task", F.spark_partition_id()).groupBy("sample_id").agg(
        F.count("*").alias("n"), F.countDistinct("task").alias("tasks"), F.max("event_id").alias("last_event"),
        F.round(F.sum(F.col("CD45").cast("double")), 4).alias("cd45"))


@query("F7_compensation_from_metadata", f"""WITH {CELLS}, f AS (
   SELECT patient_id, CAST(CD45 AS FLOAT)::DOUBLE AS x, CAST(CD34 AS FLOAT)::DOUBLE AS y, 0.02 * patient_id AS a, 0.01 * patient_id AS b FROM cells)
 SELECT 'P' || patient_id || '.fcs' AS sample_id, count(*) AS n,
   round(sum(CASE WHEN patient_id < 9 THEN (x - b * y) / (1 - a * b) ELSE x END), 3) + 0.0 AS cd45,
   round(sum(CASE WHEN patient_id < 9 THEN (y - a * x) / (1 - a * b) ELSE y END), 3) + 0.0 AS cd34,
   round(max(CASE WHEN patient_id < 9 THEN (x - b * y) / (1 - a * b) ELSE x END), 6) + 0.0 AS top,
   patient_id = 8 AS failed
 FROM (SELECT * REPLACE (CASE WHEN patient_id = 8 THEN 0 ELSE a END AS a, CASE WHEN patient_id = 8 THEN 0 ELSE b END AS b) FROM f)
 GROUP BY patient_id""")
def compensation_from_metadata(spark, sf_dir):
    """Each file records its own matrix; one file none (9) and one a matrix without inverse (8)."""
    from marrowgrid.operators.gating import compensate_recorded

    folder = scratch_path(spark, "spill")
    source = cells(spark, sf_dir).withColumn("file", F.concat(F.lit("P"), "patient_id")).select("file", "event_id", "patient_id", "CD45", "CD34")
    p = F.col("patient_id")
    # fixed form of the keyword: number of detectors, names, matrix row by row
    value = F.when(p == 8, F.lit("2,CD45,CD34,1,1,1,1")).otherwise(F.concat(
        F.lit("2,CD45,CD34,1.0,"), (p * F.lit(0.02)).cast("string"), F.lit(","), (p * F.lit(0.01)).cast("string"), F.lit(",1.0")))
    words = source.where(p < 9).select("file", value.alias("v")).distinct().select("file", F.create_map(F.lit("$SPILLOVER"), "v").alias("keywords"))
    fcs.write_fcs(source.drop("patient_id"), folder, "file", key=["event_id"], keywords=words)
    events, _ = fcs.read_events(spark, folder)
    out, errors = compensate_recorded(events, fcs.spillovers(spark, folder))
    failed = errors.select("sample_id", F.lit(True).alias("failed"))
    return out.groupBy("sample_id").agg(
        F.count("*").alias("n"), rounded(F.sum("CD45"), 3).alias("cd45"), rounded(F.sum("CD34"), 3).alias("cd34"),
        rounded(F.max("CD45"), 6).alias("top")).join(failed, "sample_id", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))


@query("K11_gate_export", f"""WITH {CELLS} SELECT 'P' || patient_id || '.fcs' AS sample_id, count(*) AS n FROM cells WHERE CD45 >= 2.5 AND CD45 < 8.5 GROUP BY 1""")
def gate_export(spark, sf_dir):
    from marrowgrid.functions.gates import in_range
    from marrowgrid.operators.gating import GateTree

    folder = scratch_path(spark, "gate_fcs")
    tree = GateTree().add("bright", in_range("CD45", 2.5, 8.5))
    inside = tree.rows(cells(spark, sf_dir), "bright").withColumn("file", F.concat(F.lit("P"), "patient_id"))
    fcs.write_fcs(inside.select("file", "event_id", *MARKERS), folder, "file", key=["event_id"])
    events, _ = fcs.read_events(spark, folder)
    return events.groupBy("sample_id").agg(F.count("*").alias("n"))


@query("S3_events_csv", f"WITH {CELLS} SELECT event_id, CD45, HLA_DR FROM cells")
def events_csv(spark, sf_dir):
    path = scratch_path(spark, "events")
    sinks.write_csv(cells(spark, sf_dir), path, ["event_id", "CD45", "HLA_DR"])
    return readers.read_events_csv(spark, path, "event_id string, CD45 double, HLA_DR double")


@query("S4_reference_csv", f"""WITH {CELLS} SELECT 'pop' || metacluster AS population, count(*) AS n_cells, round(avg(asinh(CD45 / 5)), 6) AS "CD45",
   round(avg(asinh(HLA_DR / 5)), 6) AS "HLA_DR" FROM cells WHERE CD34 > 0 GROUP BY 1""")
def reference_csv(spark, sf_dir):
    """Decimal-comma files with gaps, written first, then read as the reference."""
    path = scratch_path(spark, "reference")
    comma = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.", ",")
    gap = F.when(F.col("CD34") > 0, comma("CD45"))
    cells(spark, sf_dir).select(
        F.concat(F.lit("pop"), "metacluster").alias("population"), gap.alias("CD45"), comma("HLA_DR").alias("HLA_DR")
    ).write.option("sep", ";").csv(path, header=True)
    found = readers.read_reference_csv(spark, path, ["CD45", "HLA_DR"], lambda c: F.asinh(c / 5))
    means = readers.reference_means(found, ["CD45", "HLA_DR"])
    return means.withColumns({"CD45": F.round("CD45", 6), "HLA_DR": F.round("HLA_DR", 6)})


@query("S4_reference_latin1", f"""WITH {CELLS} SELECT CASE WHEN metacluster < 5 THEN 'Éosinophiles' ELSE 'Lymphocytes mûrs' END AS population,
   count(*) AS n_cells, round(avg(CD45), 6) AS "CD45" FROM cells GROUP BY 1""")
def reference_latin1(spark, sf_dir):
    """Files in two encodings, found out file by file."""
    path = scratch_path(spark, "encodings")
    comma = F.regexp_replace(F.col("CD45").cast("string"), r"\.", ",").alias("CD45")
    for kind, rule, name in (("UTF-8", "metacluster < 5", "Éosinophiles"), ("ISO-8859-1", "metacluster >= 5", "Lymphocytes mûrs")):
        cells(spark, sf_dir).where(rule).select(F.lit(name).alias("population"), comma).write.mode("append") \
            .options(sep=";", encoding=kind).csv(path, header=True)
    means = readers.reference_means(readers.read_reference_csv(spark, path, ["CD45"]), ["CD45"])
    return means.withColumn("CD45", F.round("CD45", 6))


@query("K9_analysis_metadata", f"""WITH {CELLS} SELECT 'condition' AS section, condition AS name, count(*) AS n, NULL::DOUBLE AS pct FROM cells GROUP BY 2
   UNION ALL SELECT 'file', file_origin, count(*), NULL FROM cells GROUP BY 2
   UNION ALL SELECT 'metacluster', m::VARCHAR, count(metacluster), round(100.0 * count(metacluster) / (SELECT count(*) FROM cells), 3)
             FROM range(12) r(m) LEFT JOIN cells ON metacluster = m GROUP BY 2
   UNION ALL SELECT 'total', 'cells', count(*), NULL FROM cells
   UNION ALL SELECT 'total', 'files', count(DISTINCT file_origin), NULL FROM cells""")
def metadata_json(spark, sf_dir):
    """Written as JSON, read back and laid out in rows; two of twelve metaclusters have no cell."""
    path = scratch_path(spark, "metadata")
    sinks.analysis_metadata(
        cells(spark, sf_dir), sample="file_origin", condition="condition", metacluster="metacluster", n_metaclusters=12, markers=MARKERS,
        used=["CD45", "CD34"], config={"xdim": 10}).write.json(path)
    held = spark.read.schema(
        "data_summary struct<total_cells: long, cells_per_condition: map<string,long>, cells_per_file: map<string,long>>, "
        "input_files struct<total_files: long>, metacluster_summary map<string,struct<n_cells: long, pct_total: double>>").json(path)

    def laid(kind, column, n, pct):
        return held.select(F.lit(kind).alias("section"), F.explode(column).alias("name", "v")).select("section", "name", n.alias("n"), pct.alias("pct"))

    none = F.lit(None).cast("double")
    totals = F.explode(F.create_map(F.lit("cells"), F.col("data_summary.total_cells"), F.lit("files"), F.col("input_files.total_files")))
    return laid("condition", "data_summary.cells_per_condition", F.col("v"), none) \
        .unionByName(laid("file", "data_summary.cells_per_file", F.col("v"), none)) \
        .unionByName(laid("metacluster", "metacluster_summary", F.col("v.n_cells"), F.col("v.pct_total"))) \
        .unionByName(held.select(F.lit("total").alias("section"), totals.alias("name", "n")).withColumn("pct", none))


@query("K4_json_payload", f"""WITH {CELLS} SELECT 'run' AS name, count(*) AS n_cells, count(DISTINCT file_origin) AS n_files FROM cells""")
def json_payload(spark, sf_dir):
    """A small document written as JSON and read back."""
    row = cells(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("file_origin").alias("f")).first()
    path = scratch_path(spark, "payload")
    sinks.write_payload(spark, {"name": "run", "n_cells": row["n"], "n_files": row["f"], "at": np.datetime64("2024-01-01")}, path)
    return spark.read.json(path).select("name", "n_cells", "n_files")


@query("S7_pool_cache", f"WITH {CELLS} SELECT file_origin, count(*) AS n, round(sum(CD45), 4) AS total FROM cells WHERE condition = 'Sain' GROUP BY 1")
def pool_cache(spark, sf_dir):
    pool = cells(spark, sf_dir).where("condition = 'Sain'").select("event_id", "CD45", "file_origin")
    root = scratch_path(spark, "pool")
    listing = pool.groupBy("file_origin").agg(F.count("*").alias("length"))
    version = readers.pool_version(listing, {"transform": "arcsinh", "cofactor": 5}, ["file_origin", "length"])
    assert readers.load_pool(spark, root, version) is None
    readers.save_pool(pool, root, version)
    back = readers.load_pool(spark, root, version)
    return back.groupBy(F.col("file_origin").cast("string").alias("file_origin")).agg(
        F.count("*").alias("n"), F.round(F.sum("CD45"), 4).alias("total"))


@query("S13_model_input", f"WITH {CELLS} SELECT event_id, round(CD45, 8) AS cd45, round(HLA_DR, 8) AS hla FROM cells")
def model_input(spark, sf_dir):
    ready = cells(spark, sf_dir).withColumnsRenamed({"CD45": "cd45", "HLA_DR": "hla"}).select("event_id", vector(["cd45", "hla"]).alias("x"))
    return ready.select("event_id", F.round(F.col("x")[0], 8).alias("cd45"), F.round(F.col("x")[1], 8).alias("hla"))


@query("K15_mapping_csv", MAP_NEAREST)
def mapping_csv(spark, sf_dir):
    from marrowgrid.operators.mapping import map_nearest

    path = scratch_path(spark, "mapping")
    out = map_nearest(nodes_long(spark, sf_dir), populations_long(spark, sf_dir))
    sinks.write_csv(out, path)
    back = spark.read.schema(out.schema).csv(path, header=True)
    return back.withColumns({"best_dist": F.round("best_dist", 5), "threshold": F.round("threshold", 5)})


@query("P10_output_columns", f"""WITH {CELLS} SELECT node_id + 1 AS node, max(metacluster) + 1 AS metacluster, count(*) AS size,
   count(*) FILTER (condition = 'Sain') AS code1, count(*) FILTER (condition <> 'Sain') AS code2, TRUE AS in_disc FROM cells GROUP BY 1""")
def output_columns(spark, sf_dir):
    from marrowgrid.plans.outputs import flow_columns

    out = flow_columns(cells(spark, sf_dir), xdim=11)
    return out.groupBy("node").agg(
        F.max("metacluster").alias("metacluster"), F.max("size").alias("size"), F.count_if(F.col("condition_code") == 1).alias("code1"),
        F.count_if(F.col("condition_code") == 2).alias("code2"),
        F.bool_and(F.sqrt(F.pow(F.col("x_grid") - F.col("x_center"), 2) + F.pow(F.col("y_grid") - F.col("y_center"), 2)) <= 0.4501).alias("in_disc"))


# --- full runs ---------------------------------------------------------------

SETTINGS = run.Settings(("CD45", "CD34", "HLA_DR"), xdim=5, ydim=5, epochs=10, metaclusters=6)


@query("M16_patient_runs", stm.patient_runs(NODES, _SUMMARY, 10))
def patient_runs(spark, sf_dir):
    _, summary = run.patient_runs(cells(spark, sf_dir).drop("node_id", "metacluster"), SETTINGS, order())
    return _rounded(summary)


@query("C16_combined_run")
def combined_run(spark, sf_dir):
    return run.combined_run(cells(spark, sf_dir), SETTINGS, order(), ["conditions"])["conditions"]


@query("B8_mapping_service", f"""WITH {CELLS}, {MED}, {OTSU}
SELECT patient_id, scored.node_id, round(score, 4) AS blast_score,
   CASE WHEN score >= 6 THEN 'BLAST_HIGH' WHEN score >= 2 THEN 'BLAST_MODERATE' WHEN score > 0 THEN 'BLAST_WEAK' ELSE 'NON_BLAST_UNK' END AS blast_category,
   best_pop, round(asg.d, 6) AS best_dist, coalesce(assigned_pop, 'Unknown') AS assigned_pop
FROM scored LEFT JOIN asg ON asg.node_id = scored.node_id AND method = 'M12'""")
def mapping_service(spark, sf_dir):
    """Every node of every patient; nodes that no population distance exists for stay Unknown."""
    out = run.map_and_score(
        nodes_long(spark, sf_dir), populations_long(spark, sf_dir), node_sizes(spark, sf_dir), {m: F.col(f"z_{m}") for m in SCORED},
        node_z(spark, sf_dir), keys=["patient_id"])
    return out.select(
        "patient_id", "node_id", F.round("blast_score", 4).alias("blast_score"), "blast_category", "best_pop",
        F.round("best_dist", 6).alias("best_dist"), "assigned_pop")


# --- streams -----------------------------------------------------------------


@query("X1_acquisition_drift", """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS sample_id, count(*) AS n,
   round(avg(value), 9) AS mean, quantile_disc(value, 0.5) AS median, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2)
SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, sample_id, n, mean, median, low, high FROM w""")
def acquisition_drift(spark, sf_dir):
    batch = table(spark, sf_dir, "events")
    stream = jobs.open_files(spark, sf_dir, batch.schema, "events.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("sample_id"), F.col("value").alias("signal"))
    path = scratch_path(spark, "drift")
    windows = jobs.drift(stream, "ts", "sample_id", "signal")
    jobs.run_updates(windows, path, scratch_path(spark, "drift_ck"))
    return jobs.latest(spark.read.parquet(path), ["start", "sample_id"]).select(
        F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "sample_id", "n", F.round("mean", 9).alias("mean"), "median", "low", "high")


#: rows of one arriving file at most
ARRIVAL_ROWS = 1_000_000


def arriving(spark, sf_dir, batches: int = 3) -> int:
    """Files that arrive at once, so that all of them come in three batches and none holds too many rows for a task."""
    return max(1, -(-cells(spark, sf_dir).count() // (batches * ARRIVAL_ROWS)))


@query("X2_score_arrivals", f"WITH {CELLS}, {NODES} {_SUMMARY}")
def score_arrivals(spark, sf_dir):
    """Events arrive as several files and are counted per node, batch by batch."""
    folder, once = scratch_path(spark, "arrivals"), arriving(spark, sf_dir)
    cells(spark, sf_dir).select("event_id", "patient_id", "node_id", "condition").repartition(3 * once).write.parquet(folder)
    stream = jobs.open_files(spark, folder, spark.read.parquet(folder).schema, "*.parquet", per_trigger=once)
    path = scratch_path(spark, "scored")
    jobs.score_arrivals(stream, lambda b: mrd.node_counts(b), path, scratch_path(spark, "scored_ck"))
    return _rounded(jobs.merge_counts(spark.read.parquet(path), ["patient_id"]))


@query("X2_score_on_map", f"""WITH {CELLS.replace("cells AS (", "raw AS (", 1)}, v AS (
  SELECT *, [CD45 / 10, CD34 / 8, HLA_DR / 2000, SSC_A / 50] AS x FROM raw),
code AS (SELECT metacluster AS node, [avg(CD45 / 10), avg(CD34 / 8), avg(HLA_DR / 2000), avg(SSC_A / 50)] AS c
         FROM raw WHERE condition = 'Sain' GROUP BY 1),
cells AS (SELECT v.* EXCLUDE (node_id), placed AS node_id FROM v JOIN (
  SELECT event_id, arg_min(node, list_distance(x, c)) AS placed FROM v, code GROUP BY 1) USING (event_id)), {NODES}
SELECT patient_id, node_id, n_total, n_sain, n_patho, is_mrd_jf, is_mrd_flo, is_mrd_eln FROM nodes""")
def score_on_map(spark, sf_dir):
    """Vectors arrive file by file, are placed on a frozen map inside the stream, counted in its state and flagged."""
    events = marker_vectors(spark, sf_dir)
    mean = [F.avg(F.col("x")[i]).alias(f"c{i}") for i in range(4)]
    groups = cells(spark, sf_dir).select("event_id", "metacluster").join(events, "event_id")
    book = sorted(groups.where("condition = 'Sain'").groupBy("metacluster").agg(*mean).collect())
    folder, once = scratch_path(spark, "vectors"), arriving(spark, sf_dir)
    events.select("event_id", "patient_id", "condition", "x").repartition(3 * once, "event_id").write.parquet(folder)
    stream = jobs.open_files(spark, folder, spark.read.parquet(folder).schema, "*.parquet", per_trigger=once)
    path = scratch_path(spark, "map_scores")
    jobs.score_on_map(stream, np.array([r[1:] for r in book]), path, scratch_path(spark, "map_ck"), labels=[r[0] for r in book])
    return jobs.scored_nodes(spark, path).select("patient_id", "node_id", "n_total", "n_sain", "n_patho", "is_mrd_jf", "is_mrd_flo", "is_mrd_eln")
