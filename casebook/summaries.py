"""Aggregations, joins, sampling, statistics, exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from casebook.base import CELLS, NODES, query, rounded
from casebook.gates import FLAGS
from marrowgrid.operators import aggregates as agg
from marrowgrid.operators import cohort as co
from marrowgrid.operators import gating as g
from marrowgrid.operators import mrd
from marrowgrid.operators import stats as st
from marrowgrid.operators.normalize import zscore
from marrowgrid.operators.quantiles import medians
from marrowgrid.operators.selection import hash_order, smallest, take
from marrowgrid.operators.sizing import as_model
from marrowgrid.session import scratch_path
from marrowgrid.sources import sinks
from marrowgrid.sources.tables import MARKERS, cells, table

M3 = ["CD45", "CD34", "HLA_DR"]
MED3 = "median(CD45) AS \"CD45\", median(CD34) AS \"CD34\", round(median(HLA_DR), 6) AS \"HLA_DR\""


def _r(df, columns, digits=6):
    return df.withColumns({c: rounded(c, digits) for c in columns})


@query("A1_mfi_matrix", f"WITH {CELLS} SELECT metacluster, {MED3} FROM cells GROUP BY 1")
def mfi_matrix(spark, sf_dir):
    return _r(agg.mfi(cells(spark, sf_dir), ["metacluster"], M3), ["HLA_DR"])


@query("A2_cluster_marker_mean", f"""WITH {CELLS} SELECT node_id, round(avg(CD45), 6) AS "CD45", round(avg(CD34), 6) AS "CD34",
   round(avg(HLA_DR), 6) AS "HLA_DR" FROM cells GROUP BY 1""")
def cluster_marker_mean(spark, sf_dir):
    return _r(agg.mfi(cells(spark, sf_dir), ["node_id"], M3, how="mean"), M3)


@query("A3_describe", " UNION ALL ".join(
    f"""SELECT patient_id, '{m}' AS marker, count({m}) AS n, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std, round(min({m}), 6) AS min,
 round(quantile_cont({m}, 0.25), 6) AS q25, round(median({m}), 6) AS median, round(quantile_cont({m}, 0.75), 6) AS q75, round(max({m}), 6) AS max
 FROM (WITH {CELLS} SELECT * FROM cells) GROUP BY 1""" for m in ("CD45", "HLA_DR")))
def describe(spark, sf_dir):
    out = agg.describe(cells(spark, sf_dir), ["patient_id"], ["CD45", "HLA_DR"])
    return _r(out, ["mean", "std", "min", "q25", "median", "q75", "max"])


@query("A4_cluster_statistics", f"""WITH {CELLS}
SELECT metacluster, count(*) AS n_cells, round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS pct_total,
       median(CD45) AS "median_CD45", median(SSC_A) AS "median_SSC_A" FROM cells GROUP BY 1""")
def cluster_statistics(spark, sf_dir):
    return agg.cluster_statistics(cells(spark, sf_dir), "metacluster", ["CD45", "SSC_A"])


@query("A5_node_statistics", f"""WITH {CELLS},
l AS (SELECT node_id, 'CD45' AS marker, CD45 AS v FROM cells UNION ALL SELECT node_id, 'HLA_DR', HLA_DR FROM cells),
m AS (SELECT node_id, marker, count(*) AS n, median(v) AS median, stddev_pop(v) AS sd FROM l GROUP BY 1, 2)
SELECT node_id, marker, any_value(n) AS n, round(any_value(median), 6) AS median, round(any_value(sd), 6) AS sd,
       round(any_value(sd) / nullif(abs(any_value(median)), 0), 6) AS cv, round(median(abs(v - median)), 6) + 0.0 AS mad
FROM l JOIN m USING (node_id, marker) GROUP BY 1, 2""")
def node_statistics(spark, sf_dir):
    out = agg.node_statistics(cells(spark, sf_dir), ["node_id"], ["CD45", "HLA_DR"])
    return _r(out, ["median", "sd", "cv", "mad"])


@query("A6_counts_with_empty", f"""WITH {CELLS}, codes AS (SELECT DISTINCT p_partkey % 130 AS node_id FROM part)
SELECT node_id, count(event_id) AS n, round(100.0 * count(event_id) / sum(count(event_id)) OVER (), 6) AS pct
FROM codes LEFT JOIN cells USING (node_id) GROUP BY 1""")
def counts_with_empty(spark, sf_dir):
    codes = as_model(table(spark, sf_dir, "part").select((F.col("p_partkey") % 130).alias("node_id")).distinct())
    return _r(agg.counts_with_empty(cells(spark, sf_dir), codes, "node_id"), ["pct"])


@query("A7_percent_positive", f"""WITH {CELLS} SELECT node_id, round(avg((CD45 > 5.5)::INT), 8) AS "pos_CD45",
   round(avg((HLA_DR > 1000)::INT), 8) AS "pos_HLA_DR" FROM cells GROUP BY 1""")
def percent_positive(spark, sf_dir):
    out = agg.percent_positive(cells(spark, sf_dir), ["node_id"], {"CD45": 5.5, "HLA_DR": 1000.0})
    return _r(out, ["pos_CD45", "pos_HLA_DR"], 8)


@query("A8_abundance", f"""WITH {CELLS} SELECT file_origin, {', '.join(
    f'round((count(*) FILTER (metacluster = {k})) / count(*), 8) AS c{k}' for k in range(10))} FROM cells GROUP BY 1""")
def abundance(spark, sf_dir):
    out = agg.abundance(cells(spark, sf_dir), "file_origin", "metacluster", range(10), normalize=True)
    return _r(out, [f"c{k}" for k in range(10)], 8)


_DIST = """round(n_total / sum(n_total) OVER () * 100, 6) AS pct_total, round(n_sain / n_total * 100, 6) AS pct_sain_in_cluster,
       round(n_sain / greatest(sum(n_sain) OVER (), 1) * 100, 6) AS pct_sain_of_sain,
       round(n_patho / n_total * 100, 6) AS pct_patho_in_cluster,
       round(n_patho / greatest(sum(n_patho) OVER (), 1) * 100, 6) AS pct_patho_of_patho"""
_COUNT = """count(*) AS n_total, count(*) FILTER (condition = 'Sain') AS n_sain,
          count(*) FILTER (condition = 'Pathologique') AS n_patho"""


@query("A9_condition_distribution", f"""WITH {CELLS}, a AS (SELECT *, l % 7 AS grp FROM (SELECT *, CAST(round(CD45) AS INT) AS l FROM cells)),
f AS (SELECT node_id, grp, count(*) AS c FROM a GROUP BY 1, 2),
d AS (SELECT node_id, grp FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY c DESC, grp) AS k FROM f) WHERE k = 1),
n AS (SELECT node_id, {_COUNT} FROM a GROUP BY 1)
SELECT node_id, n_total, n_sain, n_patho, grp AS metacluster, {_DIST} FROM n JOIN d USING (node_id)""")
def condition_distribution(spark, sf_dir):
    # a label that varies inside a node, so that the dominant one matters
    grp = F.round("CD45").cast("int") % 7
    return agg.condition_distribution(cells(spark, sf_dir).withColumn("grp", grp), "node_id", "grp")


@query("L7_sorted_distribution", f"""WITH {CELLS}, n AS (SELECT metacluster, {_COUNT} FROM cells GROUP BY 1)
SELECT metacluster, n_total, row_number() OVER (ORDER BY n_patho / n_total DESC, metacluster) AS rank FROM n""")
def sorted_distribution(spark, sf_dir):
    out = agg.condition_distribution(cells(spark, sf_dir), "metacluster")
    ranked = out.withColumn("rank", F.row_number().over(
        Window.partitionBy(F.lit(0)).orderBy(F.desc("pct_patho_in_cluster"), "metacluster")))
    return ranked.select("metacluster", "n_total", "rank").orderBy("rank")


@query("W6_share_of_total", f"""WITH {CELLS}
SELECT condition, metacluster, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY condition), 6) AS pct FROM cells GROUP BY 1, 2""")
def share_of_total(spark, sf_dir):
    n = cells(spark, sf_dir).groupBy("condition", "metacluster").agg(F.count("*").alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("condition"))
    return n.select("condition", "metacluster", F.round(share, 6).alias("pct"))


@query("A10_exclusive_clusters", f"""WITH {CELLS}
SELECT file_origin || '/' || metacluster AS cluster, count(*) AS n, CASE WHEN bool_and(condition = 'Pathologique') THEN 'patho_only'
   WHEN bool_and(condition = 'Sain') THEN 'sain_only' ELSE 'mixed' END AS kind FROM cells GROUP BY 1""")
def exclusive_clusters(spark, sf_dir):
    named = cells(spark, sf_dir).withColumn("cluster", F.concat_ws("/", "file_origin", "metacluster"))
    return agg.exclusive_clusters(named, "cluster")


@query("A11_file_features", f"""WITH {CELLS},
n AS (SELECT file_origin, 'node' AS level, node_id AS cluster, count(*) AS count, avg((CD45 > 5.5)::INT) AS p, median(CD34) AS m FROM cells GROUP BY 1, 3
      UNION ALL SELECT file_origin, 'metacluster', metacluster, count(*), avg((CD45 > 5.5)::INT), median(CD34) FROM cells GROUP BY 1, 3)
SELECT file_origin, level, cluster, count, round(count / sum(count) OVER (PARTITION BY file_origin, level), 8) AS pct,
       round(p, 8) AS "pos_CD45", round(m, 8) + 0.0 AS "mfi_CD34" FROM n""")
def file_features(spark, sf_dir):
    out = agg.features(cells(spark, sf_dir), "file_origin", "node_id", "metacluster", ["CD34"], {"CD45": 5.5})
    return _r(out, ["pct", "pos_CD45", "mfi_CD34"], 8)


@query("A12_sample_features", f"""WITH {CELLS} SELECT file_origin, {', '.join(
    f'round((count(*) FILTER (metacluster = {k})) / count(*), 8) AS c{k}, round(coalesce(median(HLA_DR) FILTER (metacluster = {k}), 0), 6) AS "c{k}_HLA_DR"'
    for k in range(10))} FROM cells GROUP BY 1""")
def sample_features(spark, sf_dir):
    out = agg.sample_features(cells(spark, sf_dir), "file_origin", "metacluster", range(10), ["HLA_DR"])
    return _r(_r(out, [f"c{k}" for k in range(10)], 8), [f"c{k}_HLA_DR" for k in range(10)])


@query("A14_sample_summary", f"""WITH {CELLS} SELECT file_origin, count(*) AS n_events, 6 AS n_channels,
   count(*) FILTER (CD45 > 5.5) AS n_bright, count(*) FILTER (condition = 'Sain') AS n_healthy FROM cells GROUP BY 1""")
def sample_summary(spark, sf_dir):
    marked = cells(spark, sf_dir).withColumns({"bright": F.col("CD45") > 5.5, "healthy": F.col("condition") == "Sain"})
    return co.summarize_samples(marked, "file_origin", ["bright", "healthy"], MARKERS)


@query("A17_density_grid", f"""WITH {CELLS},
q AS (SELECT quantile_cont(FSC_A, 0.005) AS x0, quantile_cont(FSC_A, 0.995) AS x1, quantile_cont(HLA_DR, 0.005) AS y0,
             quantile_cont(HLA_DR, 0.995) AS y1 FROM cells),
p AS (SELECT least(floor((least(greatest(FSC_A, x0), x1) - x0) / ((x1 - x0) / 120)), 119)::BIGINT AS bx,
             least(floor((least(greatest(HLA_DR, y0), y1) - y0) / ((y1 - y0) / 120)), 119)::BIGINT AS "by" FROM cells, q)
SELECT bx, "by", count(*) AS n FROM p GROUP BY 1, 2""")
def density_grid(spark, sf_dir):
    events = cells(spark, sf_dir)
    cut = g.learn_limits(events, {"x0": ("FSC_A", 0.5), "x1": ("FSC_A", 99.5), "y0": ("HLA_DR", 0.5), "y1": ("HLA_DR", 99.5)})
    return agg.histogram2d(events, "FSC_A", "HLA_DR", [cut["x0"], cut["x1"], cut["y0"], cut["y1"]], 120)


@query("A18_histogram", f"""WITH {CELLS}
SELECT condition, least(floor(FSC_A / (100000.0 / 200)), 199)::BIGINT AS bin, count(*) AS n FROM cells
WHERE FSC_A BETWEEN 0 AND 100000 GROUP BY 1, 2""")
def histogram(spark, sf_dir):
    return agg.histogram(cells(spark, sf_dir), "FSC_A", 0.0, 100000.0, 200, ["condition"])


@query("A19_weighted_profile", f"""WITH {CELLS},
n AS (SELECT metacluster, node_id, count(*) AS size, median(CD45) AS a, median(HLA_DR) AS b FROM cells GROUP BY 1, 2)
SELECT metacluster, round(sum(size * a) / sum(size), 6) AS "CD45", round(sum(size * b) / sum(size), 6) AS "HLA_DR" FROM n GROUP BY 1""")
def weighted_profile(spark, sf_dir):
    events = cells(spark, sf_dir)
    size = events.groupBy("metacluster", "node_id").agg(F.count("*").alias("size"))
    nodes = medians(events, ["metacluster", "node_id"], {"CD45": "CD45", "HLA_DR": "HLA_DR"}).join(size, ["metacluster", "node_id"])
    return _r(agg.weighted_profile(nodes, ["metacluster"], ["CD45", "HLA_DR"], "size"), ["CD45", "HLA_DR"])


@query("A20_node_centroids", f"""WITH {CELLS} SELECT node_id, max(metacluster) AS metacluster, count(*) AS n,
   round(avg(asinh(CD45 / 5)), 8) AS "CD45", round(avg(asinh(HLA_DR / 5)), 8) AS "HLA_DR" FROM cells GROUP BY 1""")
def node_centroids(spark, sf_dir):
    from marrowgrid.functions.transforms import transform_markers

    scaled = transform_markers(cells(spark, sf_dir), ["CD45", "HLA_DR"], "arcsinh")
    out = scaled.groupBy("node_id").agg(
        F.max("metacluster").alias("metacluster"), F.count("*").alias("n"), F.avg("CD45").alias("CD45"), F.avg("HLA_DR").alias("HLA_DR"))
    return _r(out, ["CD45", "HLA_DR"], 8)


@query("A23_distinct", f"""WITH {CELLS} SELECT count(DISTINCT condition) AS conditions, count(DISTINCT file_origin) AS files,
   count(DISTINCT patient_id) AS patients, count(DISTINCT node_id) AS nodes FROM cells""")
def distinct(spark, sf_dir):
    c = F.count_distinct
    # one small pre-aggregation instead of an expand over every event
    keys = cells(spark, sf_dir).select("condition", "file_origin", "patient_id", "node_id").distinct()
    return keys.agg(c("condition").alias("conditions"), c("file_origin").alias("files"),
                    c("patient_id").alias("patients"), c("node_id").alias("nodes"))


@query("A24_profile_z", f"""WITH {CELLS}, m AS (SELECT metacluster, median(CD45) AS a, median(SSC_A) AS b, median(HLA_DR) AS c FROM cells GROUP BY 1)
SELECT metacluster, round((b - avg(b) OVER ()) / CASE WHEN stddev_pop(b) OVER () = 0 THEN 1 ELSE stddev_pop(b) OVER () END, 6) + 0.0 AS "SSC_A",
       round((c - avg(c) OVER ()) / stddev_pop(c) OVER (), 5) + 0.0 AS "HLA_DR" FROM m""")
def profile_z(spark, sf_dir):
    nodes = as_model(agg.mfi(cells(spark, sf_dir), ["metacluster"], ["SSC_A", "HLA_DR"]))
    out = zscore(nodes, ["SSC_A", "HLA_DR"])
    return out.select("metacluster", rounded("SSC_A", 6).alias("SSC_A"), rounded("HLA_DR", 5).alias("HLA_DR"))


# --- joins -------------------------------------------------------------------


@query("J1_node_labels", f"""WITH {CELLS}, {NODES}
SELECT event_id, node_id, is_mrd_jf, is_mrd_eln FROM cells JOIN nodes USING (patient_id, node_id)""")
def node_labels(spark, sf_dir):
    events = cells(spark, sf_dir)
    flags = as_model(mrd.mrd_nodes(events).select("patient_id", "node_id", "is_mrd_jf", "is_mrd_eln"))
    return events.join(flags, ["patient_id", "node_id"], "left").select("event_id", "node_id", "is_mrd_jf", "is_mrd_eln")


@query("J2_reattach_results", f"""WITH {CELLS}
SELECT event_id, CASE WHEN CD45 > 5.5 THEN CD45 * 2 END AS corrected, CASE WHEN CD45 > 5.5 THEN node_id % 5 ELSE -1 END AS label FROM cells""")
def reattach_results(spark, sf_dir):
    events = cells(spark, sf_dir)
    done = events.where("CD45 > 5.5").select(
        "event_id", (F.col("CD45") * 2).alias("corrected"), (F.col("node_id") % 5).alias("label"))
    return co.reattach(events.select("event_id"), done, ["event_id"], {"label": -1})


@query("J3_cohort_metadata", f"""WITH {CELLS}
SELECT r_name AS batch, n_name AS site, count(*) AS n FROM cells
JOIN supplier ON file_origin = 'F' || s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def cohort_metadata(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    meta = (
        table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.concat(F.lit("F"), "s_suppkey").alias("file_origin"), F.col("n_name").alias("site"), "r_name"))
    out = co.with_metadata(cells(spark, sf_dir), meta, "file_origin", ["r_name", "site"])
    return out.groupBy("batch", "site").agg(F.count("*").alias("n"))


@query("J8_semi_anti", f"""WITH {CELLS}, s AS (SELECT file_origin, count(*) AS n FROM cells GROUP BY 1)
SELECT 'kept' AS side, count(*) AS n FROM cells SEMI JOIN (SELECT * FROM s WHERE n >= 600) k USING (file_origin)
UNION ALL SELECT 'dropped', count(*) FROM cells ANTI JOIN (SELECT * FROM s WHERE n >= 600) k USING (file_origin)""")
def semi_anti(spark, sf_dir):
    events = cells(spark, sf_dir)
    large = as_model(events.groupBy("file_origin").count().where("count >= 600").select("file_origin"))
    kept = events.join(large, "file_origin", "left_semi").agg(F.count("*").alias("n")).select(F.lit("kept").alias("side"), "n")
    dropped = events.join(large, "file_origin", "left_anti").agg(F.count("*").alias("n")).select(F.lit("dropped").alias("side"), "n")
    return kept.unionByName(dropped)


# --- sampling ----------------------------------------------------------------

KEY = "md5(concat_ws('|', '42', event_id))"


@query("L1_downsample", f"WITH {CELLS} SELECT event_id, CD45 FROM cells ORDER BY {KEY} LIMIT 5000")
def downsample(spark, sf_dir):
    return take(cells(spark, sf_dir), 5000, hash_order("event_id")).select("event_id", "CD45")


@query("L2_cap_per_file", f"""WITH {CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY file_origin ORDER BY {KEY}) AS k FROM cells)
SELECT event_id, file_origin FROM r WHERE k <= 250""")
def cap_per_file(spark, sf_dir):
    return smallest(cells(spark, sf_dir), ["file_origin"], 250, hash_order("event_id")).select("event_id", "file_origin")


@query("W8_random_quota", f"""WITH {CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY {KEY}) AS k FROM cells)
SELECT node_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM r WHERE k <= 40 GROUP BY 1""")
def random_quota(spark, sf_dir):
    out = smallest(cells(spark, sf_dir), ["node_id"], 40, hash_order("event_id"))
    return out.groupBy("node_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("L6_preview_sample", f"WITH {CELLS} SELECT event_id FROM (SELECT * FROM cells WHERE CD45 > 5.5) ORDER BY {KEY} LIMIT 2000")
def preview_sample(spark, sf_dir):
    return take(cells(spark, sf_dir).where("CD45 > 5.5"), 2000, hash_order("event_id")).select("event_id")


@query("S8_aggregate_files", f"""WITH {CELLS}, f AS (SELECT ceil(20000 / count(DISTINCT file_origin)) AS quota FROM cells),
r AS (SELECT *, row_number() OVER (PARTITION BY file_origin ORDER BY {KEY}) AS k FROM cells)
SELECT event_id AS original_id, file_origin AS file, CD45, CD34 FROM r, f WHERE k <= quota""")
def aggregate_files(spark, sf_dir):
    events = cells(spark, sf_dir)
    quota = -(-20000 // events.select("file_origin").distinct().count())
    out = smallest(events, ["file_origin"], quota, hash_order("event_id"))
    return out.select(F.col("event_id").alias("original_id"), F.col("file_origin").alias("file"), "CD45", "CD34")


BAL = f"""q AS (SELECT ceil(round((count(*) FILTER (condition = 'Pathologique')) * 0.5)
   / count(DISTINCT file_origin) FILTER (condition <> 'Pathologique')) AS quota FROM cells),
r AS (SELECT *, row_number() OVER (PARTITION BY file_origin ORDER BY {KEY}) AS k, count(*) OVER (PARTITION BY file_origin) AS size
      FROM cells WHERE condition <> 'Pathologique')"""


@query("L3_balanced_pool", f"""WITH {CELLS}, {BAL}
SELECT event_id, condition FROM cells WHERE condition = 'Pathologique' UNION ALL SELECT event_id, condition FROM r, q WHERE k <= quota""")
def balanced_pool(spark, sf_dir):
    return co.balanced_pool(cells(spark, sf_dir), hash_order("event_id"), ratio=0.5).select("event_id", "condition")


@query("L3_balanced_pool_replace", f"""WITH {CELLS}, {BAL.replace('* 0.5', '* 2.5')}
SELECT file_origin, count(*) AS n FROM (
  SELECT file_origin FROM r, q, range(0, 1000) t(i) WHERE k + i * size <= quota
  UNION ALL SELECT file_origin FROM cells WHERE condition = 'Pathologique') GROUP BY 1""")
def balanced_pool_replace(spark, sf_dir):
    out = co.balanced_pool(cells(spark, sf_dir), hash_order("event_id"), ratio=2.5, replace=True)
    return out.groupBy("file_origin").agg(F.count("*").alias("n"))


@query("L4_pool_per_patient", f"""WITH {CELLS},
q AS (SELECT patient_id AS pid, CAST(floor(count(*) * 0.8) AS BIGINT) AS target FROM cells WHERE condition = 'Pathologique' GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY file_origin ORDER BY {KEY}) AS k, count(*) OVER () AS pool_rows FROM cells WHERE condition = 'Sain'),
fs AS (SELECT count(DISTINCT file_origin) AS files FROM r)
SELECT pid AS patient_id, file_origin, event_id FROM r JOIN fs ON TRUE JOIN q ON target >= pool_rows OR k <= greatest(1, target // files)""")
def pool_per_patient(spark, sf_dir):
    events = cells(spark, sf_dir)
    out = co.pool_per_patient(
        events.where("condition = 'Pathologique'"), events.where("condition = 'Sain'"), hash_order("event_id"), ratio=0.8)
    return out.select("patient_id", "file_origin", "event_id")


# --- set operations ----------------------------------------------------------


@query("U1_stack_samples", f"""WITH {CELLS} SELECT sample, count(*) AS n, round(sum(CD34), 4) AS total FROM (
  SELECT 'a' AS sample, CD34 FROM cells WHERE condition = 'Sain' UNION ALL SELECT 'b', 0.0 FROM cells WHERE condition <> 'Sain') GROUP BY 1""")
def stack_samples(spark, sf_dir):
    events = cells(spark, sf_dir)
    a = events.where("condition = 'Sain'").select(F.lit("a").alias("sample"), "CD45", "CD34")
    b = events.where("condition <> 'Sain'").select(F.lit("b").alias("sample"), "CD45")
    return co.stack([a, b]).groupBy("sample").agg(F.count("*").alias("n"), F.round(F.sum("CD34"), 4).alias("total"))


@query("S12_stack_cohort", f"""WITH {CELLS} SELECT patient_id AS "__sample__", 'CD45,SSC_A' AS columns, count(*) AS n, round(avg(CD45), 6) AS mean,
   round(avg(SSC_A), 6) AS ssc FROM cells GROUP BY 1""")
def stack_cohort(spark, sf_dir):
    """Patients 3 and 7 lack a marker each; the stacked table has what all share."""
    lacks = lambda c, p: F.when(F.col("patient_id") != p, F.col(c)).alias(c)
    events = cells(spark, sf_dir).select("patient_id", "CD45", lacks("CD34", 3), "SSC_A", lacks("HLA_DR", 7))
    stacked = co.stack_cohort(events, "patient_id", ["CD45", "CD34", "SSC_A", "HLA_DR"])
    return stacked.groupBy("__sample__").agg(
        F.lit(",".join(stacked.columns[1:])).alias("columns"), F.count("*").alias("n"), F.round(F.avg("CD45"), 6).alias("mean"),
        F.round(F.avg("SSC_A"), 6).alias("ssc"))


# --- statistics --------------------------------------------------------------

LONG = """long AS (SELECT metacluster, condition, 'CD45' AS marker, CD45 AS v FROM cells
  UNION ALL SELECT metacluster, condition, 'SSC_A', SSC_A FROM cells UNION ALL SELECT metacluster, condition, 'HLA_DR', HLA_DR FROM cells)"""
RANK = f"""{LONG},
rk AS (SELECT *, rank() OVER (PARTITION BY metacluster, marker ORDER BY v) + (count(*) OVER (PARTITION BY metacluster, marker, v) - 1) / 2 AS r,
              count(*) OVER (PARTITION BY metacluster, marker, v) AS t FROM long),
u AS (SELECT metacluster, marker, count(*) FILTER (condition = 'Pathologique') AS n1, count(*) FILTER (condition = 'Sain') AS n2,
             sum(r) FILTER (condition = 'Pathologique') AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM rk GROUP BY 1, 2),
mw AS (SELECT metacluster, marker, n1, n2, r1 - n1 * (n1 + 1) / 2 AS u,
          (greatest(r1 - n1 * (n1 + 1) / 2, n1 * n2 - r1 + n1 * (n1 + 1) / 2) - n1 * n2 / 2 - 0.5)
          / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u)"""


def counted(spark, sf_dir):
    long = st.to_long(cells(spark, sf_dir), ["metacluster", "condition"], ["CD45", "SSC_A", "HLA_DR"])
    patho, sain = F.col("condition") == "Pathologique", F.col("condition") == "Sain"
    return st.value_counts(long, ["metacluster", "marker"], patho, sain)


# both tails of the normal distribution as an integral over an angle
TAIL = f"""{RANK},
pv AS (SELECT metacluster, marker, any_value(n1) AS n1, any_value(n2) AS n2, any_value(u) AS u, any_value(z) AS z,
              CASE WHEN any_value(z) < 0 THEN 1.0 ELSE least(1.0, avg(exp(-z * z / (2 * pow(sin((i + 0.5) / 20000 * pi() / 2), 2))))) END AS p
       FROM mw, range(0, 20000) t(i) GROUP BY 1, 2)"""


@query("T1_mann_whitney", f"WITH {CELLS}, {TAIL} SELECT metacluster, marker, n1, n2, u, round(z, 5) AS z, round(p, 6) AS p FROM pv")
def mann_whitney(spark, sf_dir):
    out = st.mann_whitney(counted(spark, sf_dir), ["metacluster", "marker"])
    return out.select("metacluster", "marker", "n1", "n2", "u", F.round("z", 5).alias("z"), F.round("p", 6).alias("p"))


@query("W4_mid_ranks", f"""WITH {CELLS}, {RANK} SELECT metacluster, marker, round(sum(r) FILTER (condition = 'Pathologique'), 1) AS rank_sum FROM rk GROUP BY 1, 2""")
def mid_ranks(spark, sf_dir):
    mid = F.col("ca") + F.col("cb") + (F.col("a") + F.col("b") + 1) / 2
    return counted(spark, sf_dir).groupBy("metacluster", "marker").agg(F.round(F.sum(F.col("a") * mid), 1).alias("rank_sum"))


KS = f"""{LONG},
vc AS (SELECT metacluster, marker, v, count(*) FILTER (condition = 'Pathologique') AS a, count(*) FILTER (condition = 'Sain') AS b FROM long GROUP BY 1, 2, 3),
cu AS (SELECT metacluster, marker, sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p AS gap FROM vc
       WINDOW w AS (PARTITION BY metacluster, marker ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY metacluster, marker))"""


@query("T2_kolmogorov_smirnov", f"""WITH {CELLS}, {KS},
sz AS (SELECT metacluster, marker, sum(a) AS n1, sum(b) AS n2 FROM vc GROUP BY 1, 2),
ds AS (SELECT metacluster, marker, any_value(n1) AS n1, any_value(n2) AS n2, max(abs(gap)) AS d FROM cu JOIN sz USING (metacluster, marker) GROUP BY 1, 2)
SELECT metacluster, marker, round(any_value(d), 8) AS d,
       round(least(1, greatest(0, sum(2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * pow(k * d, 2) * n1 * n2 / (n1 + n2))))), 6) AS p
FROM ds, range(1, 2000) t(k) GROUP BY 1, 2""")
def kolmogorov(spark, sf_dir):
    out = st.kolmogorov_smirnov(counted(spark, sf_dir), ["metacluster", "marker"])
    return out.select("metacluster", "marker", F.round("d", 8).alias("d"), F.round("p", 6).alias("p"))


@query("W5_ecdf_gap", f"WITH {CELLS}, {KS} SELECT marker, round(max(gap), 8) AS above, round(min(gap), 8) AS below FROM cu GROUP BY 1")
def ecdf_gap(spark, sf_dir):
    frame = Window.partitionBy("metacluster", "marker")
    gap = (F.col("ca") + F.col("a")) / F.sum("a").over(frame) - (F.col("cb") + F.col("b")) / F.sum("b").over(frame)
    return counted(spark, sf_dir).withColumn("gap", gap).groupBy("marker").agg(
        F.round(F.max("gap"), 8).alias("above"), F.round(F.min("gap"), 8).alias("below"))


@query("T3_compare_conditions", f"""WITH {CELLS}, {RANK},
md AS (SELECT metacluster, marker, median(v) FILTER (condition = 'Pathologique') AS mp, median(v) FILTER (condition = 'Sain') AS ms FROM long GROUP BY 1, 2)
SELECT metacluster, marker, n1, n2, round(mp, 6) AS median_patho, round(ms, 6) AS median_sain, round(mp / greatest(ms, 1e-6), 6) AS fold_change,
       u, abs(z) >= 1.959963984540054 AS significant FROM mw JOIN md USING (metacluster, marker) WHERE n1 >= 5 AND n2 >= 5""")
def compare_conditions(spark, sf_dir):
    out = st.compare_conditions(cells(spark, sf_dir), "metacluster", ["CD45", "SSC_A", "HLA_DR"])
    out = _r(out, ["median_patho", "median_sain", "fold_change"])
    return out.select("metacluster", "marker", "n1", "n2", "median_patho", "median_sain", "fold_change", "u", "significant")


@query("T4_benjamini_hochberg", f"""WITH {CELLS}, {TAIL},
r AS (SELECT metacluster, marker, p, row_number() OVER (ORDER BY p, metacluster, marker) AS k, count(*) OVER () AS m FROM pv)
SELECT metacluster, marker, round(p, 6) AS p, round(least(1, min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) AS q,
       round(-log10(greatest(p, 1e-300)), 4) + 0.0 AS neg_log10_p FROM r""")
def bh(spark, sf_dir):
    """The correction of the rank tests over all clusters and markers."""
    tests = st.mann_whitney(counted(spark, sf_dir), ["metacluster", "marker"])
    out = st.benjamini_hochberg(tests, "p", order=["metacluster", "marker"])
    return out.select(
        "metacluster", "marker", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), rounded("neg_log10_p", 4).alias("neg_log10_p"))


@query("T5_spearman", f"""WITH {CELLS},
f AS (SELECT metacluster, file_origin, count(*) AS x, round(avg(CD34), 9) AS y FROM cells GROUP BY 1, 2),
k AS (SELECT *, rank() OVER (PARTITION BY metacluster ORDER BY x) + (count(*) OVER (PARTITION BY metacluster, x) - 1) / 2 AS rx,
             rank() OVER (PARTITION BY metacluster ORDER BY y) + (count(*) OVER (PARTITION BY metacluster, y) - 1) / 2 AS ry FROM f),
c AS (SELECT metacluster, corr(rx, ry) AS rho, count(*) AS n FROM k GROUP BY 1),
g AS (SELECT *, atan(abs(rho) / sqrt(1 - rho * rho)) AS low FROM c)
SELECT metacluster, round(any_value(rho), 8) AS rho, any_value(n) AS n, round(any_value(rho * sqrt((n - 2) / (1 - rho * rho))), 6) AS t,
       round(sum(pow(cos(low + (i + 0.5) / 20000 * (pi() / 2 - low)), n - 3)) * any_value(1 - low / (pi() / 2))
             / sum(pow(cos((i + 0.5) / 20000 * pi() / 2), n - 3)), 6) AS p
FROM g, range(0, 20000) t(i) GROUP BY 1""")
def spearman(spark, sf_dir):
    features = cells(spark, sf_dir).groupBy("metacluster", "file_origin").agg(
        F.count("*").alias("x"), F.round(F.avg("CD34"), 9).alias("y"))
    return _r(st.spearman(features, ["metacluster"], "x", "y").withColumns(
        {"rho": F.round("rho", 8), "t": F.round("t", 6)}), ["p"], 6)


# --- exports -----------------------------------------------------------------


@query("K1_events_csv", f"WITH {CELLS} SELECT event_id, CD45, CD34 FROM cells WHERE condition = 'Pathologique'")
def events_csv(spark, sf_dir):
    path = scratch_path(spark, "events_csv")
    sinks.write_csv(cells(spark, sf_dir).where("condition = 'Pathologique'"), path, ["event_id", "CD45", "CD34"])
    return spark.read.schema("event_id string, CD45 double, CD34 double").csv(path, header=True)


@query("K2_per_file_csv", f"WITH {CELLS} SELECT file_origin, count(*) AS n, round(sum(CD45), 4) AS total FROM cells GROUP BY 1")
def per_file_csv(spark, sf_dir):
    path = scratch_path(spark, "per_file")
    sinks.write_per_key(cells(spark, sf_dir).select("event_id", "CD45", "file_origin"), path, "file_origin")
    back = spark.read.schema("event_id string, CD45 double, file_origin string").csv(path, header=True)
    return back.groupBy("file_origin").agg(F.count("*").alias("n"), F.round(F.sum("CD45"), 4).alias("total"))


@query("K3_mfi_csv", f"WITH {CELLS} SELECT metacluster, {MED3} FROM cells GROUP BY 1")
def mfi_csv(spark, sf_dir):
    path = scratch_path(spark, "mfi")
    out = _r(agg.mfi(cells(spark, sf_dir), ["metacluster"], M3), ["HLA_DR"])
    sinks.write_csv(out, path)
    return spark.read.schema(out.schema).csv(path, header=True)


@query("K4_named_tables", f"""WITH {CELLS} SELECT 'abundance' AS name, count(DISTINCT file_origin) AS n FROM cells
   UNION ALL SELECT 'mfi', count(DISTINCT metacluster) FROM cells""")
def named_tables(spark, sf_dir):
    events = cells(spark, sf_dir)
    paths = sinks.write_tables({
        "abundance": agg.abundance(events, "file_origin", "metacluster", range(10)),
        "mfi": agg.mfi(events, ["metacluster"], M3)}, scratch_path(spark, "tables"))
    parts = [spark.read.parquet(p).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, p in paths.items()]
    return parts[0].unionByName(parts[1])


@query("K6_cluster_export", f"""WITH {CELLS}, c AS (SELECT CASE WHEN node_id < 5 THEN -1 ELSE node_id END AS cluster, count(*) AS n_cells FROM cells GROUP BY 1)
SELECT cluster, n_cells, CASE WHEN cluster = -1 THEN 'noise' WHEN n_cells < 530 THEN 'too_small' ELSE 'exported' END AS status,
       CASE WHEN cluster <> -1 AND n_cells >= 530 THEN n_cells ELSE 0 END AS n_written FROM c""")
def cluster_export(spark, sf_dir):
    path = scratch_path(spark, "clusters")
    labelled = cells(spark, sf_dir).select(
        "event_id", "CD45", F.when(F.col("node_id") < 5, -1).otherwise(F.col("node_id")).alias("cluster"))
    report = sinks.cluster_export(labelled, path, "cluster", min_cells=530)
    written = spark.read.schema("event_id string, CD45 double, cluster long").parquet(path).groupBy("cluster").agg(F.count("*").alias("n_written"))
    return report.join(written, "cluster", "left").na.fill(0)


@query("K7_patient_export", f"""WITH {CELLS}, {NODES}, {FLAGS}
SELECT event_id, CASE WHEN is_mrd_flo THEN 1.0 ELSE 0.0 END::DOUBLE AS is_mrd, cd45_status, cd34_status, debris_flag, doublet_flag
FROM flags JOIN nodes USING (patient_id, node_id)""")
def patient_export(spark, sf_dir):
    from marrowgrid.plans.exports import patient_table

    events = cells(spark, sf_dir)
    path = scratch_path(spark, "patient")
    patient_table(events, mrd.mrd_nodes(events), "flo").write.parquet(path)
    return spark.read.parquet(path).select("event_id", "is_mrd", "cd45_status", "cd34_status", "debris_flag", "doublet_flag")


@query("K8_distribution_csv", f"""WITH {CELLS}, n AS (SELECT metacluster, {_COUNT} FROM cells GROUP BY 1)
SELECT metacluster, n_total, n_sain, n_patho, {_DIST} FROM n""")
def distribution_csv(spark, sf_dir):
    path = scratch_path(spark, "distribution")
    out = agg.condition_distribution(cells(spark, sf_dir), "metacluster")
    sinks.write_csv(out, path)
    return spark.read.schema(out.schema).csv(path, header=True)


@query("S6_column_scan", f"WITH {CELLS} SELECT event_id, CD45 FROM cells WHERE FSC_A BETWEEN 20000 AND 30000 AND SSC_A > 25")
def column_scan(spark, sf_dir):
    events = cells(spark, sf_dir)
    return events.where(F.col("FSC_A").between(20000, 30000) & (F.col("SSC_A") > 25)).select("event_id", "CD45")


@query("P11_cells_table", f"""WITH {CELLS}, {NODES}
SELECT event_id, condition, file_origin, node_id, metacluster, CD45, is_mrd_eln FROM cells JOIN nodes USING (patient_id, node_id)""")
def cells_table(spark, sf_dir):
    events = cells(spark, sf_dir)
    raw = events.select("event_id", "patient_id", "condition", "file_origin", "CD45", "node_id")
    labels = as_model(events.select("node_id", "metacluster").distinct())
    flags = as_model(mrd.mrd_nodes(events).select("patient_id", "node_id", "is_mrd_eln"))
    return raw.join(labels, "node_id").join(flags, ["patient_id", "node_id"]).drop("patient_id")


@query("P12_metacluster_subset", f"WITH {CELLS} SELECT event_id, node_id FROM cells WHERE metacluster = 3")
def metacluster_subset(spark, sf_dir):
    return cells(spark, sf_dir).where("metacluster = 3").select("event_id", "node_id")


@query("A21_population_summary", f"""WITH {CELLS}, m AS (SELECT node_id, CASE WHEN median(HLA_DR) > 990 THEN 'bright' ELSE 'dim' END AS population FROM cells GROUP BY 1)
SELECT population, count(*) AS n_nodes FROM m GROUP BY 1""")
def population_summary(spark, sf_dir):
    nodes = medians(cells(spark, sf_dir), ["node_id"], {"m": "HLA_DR"})
    return nodes.groupBy(F.when(F.col("m") > 990, "bright").otherwise("dim").alias("population")).agg(F.count("*").alias("n_nodes"))
