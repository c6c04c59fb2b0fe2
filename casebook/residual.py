"""Residual disease and phenotype scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.base import CELLS, NODES, query, rounded
from marrowgrid.functions import blast
from marrowgrid.operators import mrd
from marrowgrid.operators.gating import gate_singlets, gate_viable
from marrowgrid.operators.quantiles import medians
from marrowgrid.operators.reference import reference_covariance, reference_stats
from marrowgrid.operators.sizing import as_model
from marrowgrid.sources.tables import cells, table

GATED = f"""{CELLS.replace('cells AS', 'all_cells AS')},
limits AS (
  SELECT quantile_cont(FSC_A, 0.02) AS f_lo, quantile_cont(FSC_A, 0.98) AS f_hi,
         quantile_cont(SSC_A, 0.02) AS s_lo, quantile_cont(SSC_A, 0.98) AS s_hi FROM all_cells),
cells AS (
  SELECT all_cells.* FROM all_cells, limits
  WHERE FSC_A BETWEEN f_lo AND f_hi AND SSC_A BETWEEN s_lo AND s_hi
    AND FSC_H > 100 AND FSC_A / FSC_H BETWEEN 0.6 AND 1.5)"""


def gated(spark, sf_dir):
    events = cells(spark, sf_dir)
    return events.where(gate_viable(events, "FSC_A", "SSC_A") & gate_singlets("FSC_A", "FSC_H"))


@query("M1_node_counts", f"WITH {CELLS}, {NODES} SELECT * FROM counts")
def node_counts(spark, sf_dir):
    return mrd.node_counts(cells(spark, sf_dir))


@query("M2_M4_node_flags", f"""WITH {CELLS}, {NODES}
SELECT patient_id, node_id, n_total, n_sain, n_patho, total_sain, total_patho, round(pct_sain, 6) AS pct_sain,
       round(pct_patho, 6) AS pct_patho, round(pct_sain_global, 6) AS pct_sain_global,
       round(node_purity, 8) AS node_purity, is_mrd_jf, is_mrd_flo, is_mrd_eln FROM nodes""")
def node_flags(spark, sf_dir):
    out = mrd.mrd_nodes(cells(spark, sf_dir))
    rounded = {c: F.round(c, 6) for c in ("pct_sain", "pct_patho", "pct_sain_global")}
    return out.withColumns({**rounded, "node_purity": F.round("node_purity", 8)})


_SUMMARY = """SELECT patient_id, total_patho, total_sain, denominator, mrd_cells_jf, mrd_cells_flo, mrd_cells_eln,
       n_nodes_jf, n_nodes_flo, n_nodes_eln, round(mrd_pct_jf, 6) AS mrd_pct_jf, round(mrd_pct_flo, 6) AS mrd_pct_flo,
       round(mrd_pct_eln, 6) AS mrd_pct_eln, eln_positive, eln_low_level FROM summary"""


def _rounded(summary):
    return summary.withColumns({f"mrd_pct_{m}": F.round(f"mrd_pct_{m}", 6) for m in mrd.METHODS})


@query("M5_mrd_summary", f"WITH {GATED}, {NODES} {_SUMMARY}")
def summary(spark, sf_dir):
    return _rounded(mrd.mrd_summary(gated(spark, sf_dir)))


@query("M5_mrd_cd45_denominator", f"""WITH {CELLS}, {NODES},
dim AS (SELECT patient_id, count(*) FILTER (condition = 'Pathologique' AND CD45 > 3.5) AS d FROM cells GROUP BY 1)
SELECT patient_id, CASE WHEN d > 0 THEN d ELSE total_patho END AS denominator,
       round(100.0 * mrd_cells_eln / CASE WHEN d > 0 THEN d ELSE total_patho END, 6) AS mrd_pct_eln
FROM summary JOIN dim USING (patient_id)""")
def summary_cd45(spark, sf_dir):
    out = mrd.mrd_summary(cells(spark, sf_dir), cd45_mask=F.col("CD45") > 3.5)
    return out.select("patient_id", "denominator", F.round("mrd_pct_eln", 6).alias("mrd_pct_eln"))


@query("M14_flagged_nodes", f"""WITH {CELLS}, {NODES}
SELECT patient_id, node_id, n_total, n_patho, round(pct_patho, 6) AS pct_patho,
       row_number() OVER (PARTITION BY patient_id ORDER BY pct_patho DESC, node_id) AS rank
FROM nodes WHERE is_mrd_flo""")
def flagged_nodes(spark, sf_dir):
    out = mrd.flagged_view(mrd.mrd_nodes(cells(spark, sf_dir)), "flo")
    return out.withColumn("pct_patho", F.round("pct_patho", 6))


@query("L8_top_nodes", f"""WITH {CELLS}, {NODES}
SELECT patient_id, node_id, n_patho, round(pct_patho, 6) AS pct_patho FROM nodes
ORDER BY nodes.pct_patho DESC, patient_id, node_id LIMIT 20""")
def top_nodes(spark, sf_dir):
    nodes = mrd.mrd_nodes(cells(spark, sf_dir)).orderBy(F.desc("pct_patho"), "patient_id", "node_id").limit(20)
    return nodes.select("patient_id", "node_id", "n_patho", F.round("pct_patho", 6).alias("pct_patho"))


@query("P13_node_review", f"""WITH {CELLS}, {NODES}
SELECT patient_id, node_id, n_patho, CASE WHEN is_mrd_jf OR is_mrd_flo THEN 'KEEP' ELSE 'DISCARD' END AS review
FROM nodes WHERE is_mrd_jf OR is_mrd_flo OR is_mrd_eln""")
def node_review(spark, sf_dir):
    nodes = mrd.mrd_nodes(cells(spark, sf_dir)).where("is_mrd_jf OR is_mrd_flo OR is_mrd_eln")
    return mrd.initial_review(nodes, "both").select("patient_id", "node_id", "n_patho", "review")


CURATED = """curated AS (
  SELECT patient_id, CAST(sum(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE n_patho END) AS BIGINT) AS curated_cells,
         max(total_patho) AS total_patho, count(*) FILTER (p_partkey IS NULL OR p_partkey % 7 <> 0) AS n_kept,
         round(100.0 * curated_cells / greatest(max(total_patho), 1), 6) AS curated_pct
  FROM nodes LEFT JOIN (SELECT DISTINCT p_partkey % 110 AS p_partkey FROM part WHERE p_size < 25) r
       ON node_id = p_partkey
  WHERE is_mrd_eln GROUP BY patient_id)"""


def curated_rows(spark, sf_dir, nodes):
    """Reviewed nodes come from the part table; every seventh is rejected."""
    node = F.col("p_partkey") % 110
    reviewed = table(spark, sf_dir, "part").where("p_size < 25").select(node.alias("node_id")).distinct()
    reviewed = reviewed.withColumn("decision", F.when(F.col("node_id") % 7 == 0, "DISCARD").otherwise("KEEP"))
    flagged = nodes.where("is_mrd_eln")
    decisions = flagged.select("patient_id", "node_id").join(as_model(reviewed), "node_id")
    return mrd.curated(flagged, decisions)


@query("M15_curated_mrd", f"WITH {CELLS}, {NODES}, {CURATED} SELECT * FROM curated")
def curated(spark, sf_dir):
    return curated_rows(spark, sf_dir, mrd.mrd_nodes(cells(spark, sf_dir)))


@query("K13_mrd_dashboard", f"""WITH {CELLS}, {NODES}, {CURATED}
SELECT patient_id, round(greatest(mrd_pct_jf, mrd_pct_flo, mrd_pct_eln), 6) AS best_pct,
       CASE WHEN mrd_pct_jf >= greatest(mrd_pct_flo, mrd_pct_eln) THEN 'jf'
            WHEN mrd_pct_flo >= mrd_pct_eln THEN 'flo' ELSE 'eln' END AS best_method, curated_pct
FROM summary LEFT JOIN curated USING (patient_id)""")
def dashboard(spark, sf_dir):
    nodes = as_model(mrd.mrd_nodes(cells(spark, sf_dir)))
    out = mrd.dashboard(mrd.summarize(nodes), curated_rows(spark, sf_dir, nodes))
    return out.select("patient_id", F.round("best_pct", 6).alias("best_pct"), "best_method", "curated_pct")


@query("K12_cohort_synthesis", f"""WITH {CELLS}, {NODES},
samples AS (SELECT s_suppkey % 10 AS patient_id, count(*) AS n_files, min(n_name) AS site, max(r_name) AS region
            FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT patient_id, n_files, site, region, total_patho, total_sain, round(mrd_pct_jf, 6) AS mrd_pct_jf,
       round(mrd_pct_flo, 6) AS mrd_pct_flo, round(mrd_pct_eln, 6) AS mrd_pct_eln, eln_positive
FROM samples LEFT JOIN summary USING (patient_id)""")
def cohort_synthesis(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    samples = (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy((F.col("s_suppkey") % 10).alias("patient_id"))
        .agg(F.count("*").alias("n_files"), F.min("n_name").alias("site"), F.max("r_name").alias("region"))
    )
    out = mrd.synthesis(_rounded(mrd.mrd_summary(cells(spark, sf_dir))), samples)
    return out.select(
        "patient_id", "n_files", "site", "region", "total_patho", "total_sain",
        "mrd_pct_jf", "mrd_pct_flo", "mrd_pct_eln", "eln_positive",
    )


# --- phenotype scores -------------------------------------------------------

SCORED = ["SSC_A", "CD45", "CD34", "HLA_DR"]
WEIGHTS = blast.marker_weights(SCORED)

MED = """med AS (
  SELECT patient_id, node_id, median(SSC_A) AS SSC_A, median(CD45) AS CD45, median(CD34) AS CD34, median(HLA_DR) AS HLA_DR
  FROM cells GROUP BY 1, 2),
ref AS (
  SELECT median(SSC_A) AS m1, greatest((quantile_cont(SSC_A, 0.75) - quantile_cont(SSC_A, 0.25)) / 1.35, 0.01) AS s1,
         median(CD45) AS m2, greatest((quantile_cont(CD45, 0.75) - quantile_cont(CD45, 0.25)) / 1.35, 0.01) AS s2,
         median(CD34) AS m3, greatest((quantile_cont(CD34, 0.75) - quantile_cont(CD34, 0.25)) / 1.35, 0.01) AS s3,
         median(HLA_DR) AS m4, greatest((quantile_cont(HLA_DR, 0.75) - quantile_cont(HLA_DR, 0.25)) / 1.35, 0.01) AS s4
  FROM cells WHERE condition = 'Sain'),
z AS (
  SELECT patient_id, node_id, (SSC_A - m1) / s1 AS z1, (CD45 - m2) / s2 AS z2, (CD34 - m3) / s3 AS z3, (HLA_DR - m4) / s4 AS z4
  FROM med, ref),
scored AS (
  SELECT *, greatest(0, least(10, greatest(0,
      1.0 * (greatest(0, -z1 - 0.5) - greatest(0, z1)) + 1.0 * (greatest(0, -z2 - 0.5) - greatest(0, z2))
      + 3.0 * greatest(0, z3 - 0.5) + 1.5 * greatest(0, z4 - 0.5)) / 6.5 * 10)) AS score
  FROM z)"""

COV = """dev AS (
  SELECT covar_samp(SSC_A, SSC_A) + 1e-4 AS aa, covar_samp(HLA_DR, HLA_DR) + 1e-4 AS bb, covar_samp(SSC_A, HLA_DR) AS ab
  FROM cells WHERE condition = 'Sain')"""


def node_z(spark, sf_dir):
    """Node medians and their z-values against the healthy events."""
    events = cells(spark, sf_dir)
    center, spread = reference_stats(events.where(F.col("condition") == "Sain"), SCORED)
    nodes = medians(events, ["patient_id", "node_id"], {m: m for m in SCORED})
    return nodes.withColumns({f"z_{m}": (F.col(m) - center[m]) / spread[m] for m in SCORED})


@query("M7_linear_score", f"WITH {CELLS}, {MED} SELECT patient_id, node_id, round(score, 5) AS blast_score FROM scored")
def linear_score(spark, sf_dir):
    score = blast.linear_score({m: f"z_{m}" for m in SCORED}, WEIGHTS)
    return node_z(spark, sf_dir).select("patient_id", "node_id", F.round(score, 5).alias("blast_score"))


@query("M11_marker_weights", """SELECT p_name AS marker, CASE
    WHEN contains(upper(p_name), 'RING') THEN 2.0 WHEN contains(upper(p_name), 'WIDGET') THEN -1.0
    WHEN contains(upper(p_name), 'CD34') THEN 3.0 ELSE 0.0 END AS weight, count(*) AS n
FROM part GROUP BY 1, 2""")
def weights_of_markers(spark, sf_dir):
    """Custom patterns first, defaults after; resolved for every name in use."""
    names = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("marker")).agg(F.count("*").alias("n"))
    weight = blast.marker_weight("marker", {"RING": 2.0, "WIDGET": -1.0})
    return names.select("marker", weight.alias("weight"), "n")


@query("M12_score_table", f"""WITH {CELLS}, {MED},
n AS (SELECT patient_id, node_id, count(*) AS n_cells FROM cells GROUP BY 1, 2)
SELECT patient_id, node_id, round(score, 2) AS blast_score,
       CASE WHEN score >= 6 THEN 'BLAST_HIGH' WHEN score >= 2 THEN 'BLAST_MODERATE' WHEN score > 0 THEN 'BLAST_WEAK'
            ELSE 'NON_BLAST_UNK' END AS blast_category, n_cells,
       round(z1, 3) + 0.0 AS "SSC_A_M8", round(z2, 3) + 0.0 AS "CD45_M8", round(z3, 3) + 0.0 AS "CD34_M8",
       round(z4, 3) + 0.0 AS "HLA_DR_M8",
       row_number() OVER (PARTITION BY patient_id ORDER BY round(score, 2) DESC, node_id) AS rank
FROM scored JOIN n USING (patient_id, node_id)""")
def score_table(spark, sf_dir):
    from pyspark.sql import Window

    score = blast.linear_score({m: f"z_{m}" for m in SCORED}, WEIGHTS)
    counts = cells(spark, sf_dir).groupBy("patient_id", "node_id").agg(F.count("*").alias("n_cells"))
    order = Window.partitionBy("patient_id").orderBy(F.desc("blast_score"), "node_id")
    return (
        node_z(spark, sf_dir).join(counts, ["patient_id", "node_id"])
        .select(
            "patient_id", "node_id", F.round(score, 2).alias("blast_score"),
            blast.category(score).alias("blast_category"), "n_cells",
            *[rounded(f"z_{m}", 3).alias(f"{m}_M8") for m in SCORED],
        )
        .withColumn("rank", F.row_number().over(order))
    )


@query("F11_blast_category", f"""WITH {CELLS}, {MED}
SELECT CASE WHEN score >= 6 THEN 'BLAST_HIGH' WHEN score >= 2 THEN 'BLAST_MODERATE' WHEN score > 0 THEN 'BLAST_WEAK'
            ELSE 'NON_BLAST_UNK' END AS blast_category, count(*) AS n FROM scored GROUP BY 1""")
def blast_category(spark, sf_dir):
    score = blast.linear_score({m: f"z_{m}" for m in SCORED}, WEIGHTS)
    return node_z(spark, sf_dir).groupBy(blast.category(score).alias("blast_category")).agg(F.count("*").alias("n"))


# two markers keep the inverse writable by hand in SQL
D2 = """d AS (
  SELECT scored.*, node_purity, n_patho, pct_patho,
         greatest(0, ((x * x * bb) - 2 * x * y * ab + (y * y * aa)) / (aa * bb - ab * ab)) AS d2
  FROM (SELECT med.patient_id, med.node_id, SSC_A - m1 AS x, HLA_DR - m4 AS y FROM med, ref) p
  JOIN scored USING (patient_id, node_id) JOIN nodes USING (patient_id, node_id), dev),
h AS (
  SELECT *, least(10, d2 * pow(node_purity, 0.98) / 109.28 * 10) AS mscore,
         least(10, greatest(0, 0.56 * least(10, d2 * pow(node_purity, 0.98) / 109.28 * 10)
             + 0.17 * least(10, CASE WHEN d2 > 109.28 THEN score * 1.03 ELSE score END))) AS hybrid
  FROM d)"""


def hybrid_nodes(spark, sf_dir):
    healthy = cells(spark, sf_dir).where(F.col("condition") == "Sain")
    center, _ = reference_stats(healthy, ["SSC_A", "HLA_DR"])
    _, inverse = reference_covariance(healthy, ["SSC_A", "HLA_DR"])
    nodes = mrd.mrd_nodes(cells(spark, sf_dir))
    d2 = blast.mahalanobis(["SSC_A", "HLA_DR"], [center["SSC_A"], center["HLA_DR"]], inverse)
    linear = blast.linear_score({m: f"z_{m}" for m in SCORED}, WEIGHTS)
    scored = node_z(spark, sf_dir).join(nodes, ["patient_id", "node_id"]).withColumns({"d2": d2, "linear": linear})
    scored = scored.withColumn("d2_mod", blast.purity_modulated(F.col("d2"), F.col("node_purity"), 0.98))
    return scored.withColumns({
        "mahal_score": blast.mahalanobis_score(F.col("d2_mod"), 109.28),
        "hybrid_score": blast.hybrid_score(F.col("d2"), F.col("d2_mod"), F.col("linear")),
    })


@query("M8_mahalanobis", f"""WITH {CELLS}, {NODES}, {MED}, {COV}, {D2}
SELECT patient_id, node_id, round(d2, 5) AS d2, round(d2 * pow(node_purity, 0.98), 5) AS d2_mod FROM h""")
def mahalanobis(spark, sf_dir):
    return hybrid_nodes(spark, sf_dir).select(
        "patient_id", "node_id", F.round("d2", 5).alias("d2"), F.round("d2_mod", 5).alias("d2_mod"))


@query("M9_hybrid_score", f"""WITH {CELLS}, {NODES}, {MED}, {COV}, {D2}
SELECT patient_id, node_id, round(hybrid, 5) AS hybrid_score FROM h""")
def hybrid_score(spark, sf_dir):
    return hybrid_nodes(spark, sf_dir).select(
        "patient_id", "node_id", F.round("hybrid_score", 5).alias("hybrid_score"))


@query("M10_score_router", f"""WITH {CELLS}, {NODES}, {MED}, {COV}, {D2}
SELECT patient_id, node_id, 10.0 AS score_none, round(score, 5) AS score_linear,
       round(mscore, 5) AS score_mahalanobis, round(hybrid, 5) AS score_hybrid FROM h""")
def score_router(spark, sf_dir):
    healthy = cells(spark, sf_dir).where(F.col("condition") == "Sain")
    center, _ = reference_stats(healthy, ["SSC_A", "HLA_DR"])
    _, inverse = reference_covariance(healthy, ["SSC_A", "HLA_DR"])
    nodes = node_z(spark, sf_dir).join(mrd.mrd_nodes(cells(spark, sf_dir)), ["patient_id", "node_id"])
    given = dict(
        z={m: f"z_{m}" for m in SCORED}, values=["SSC_A", "HLA_DR"], center=[center["SSC_A"], center["HLA_DR"]], inverse=inverse,
        purity=F.col("node_purity"))
    return nodes.select("patient_id", "node_id", *[
        F.round(blast.node_score(m, **given)[0], 5).alias(f"score_{m}") for m in ("none", "linear", "mahalanobis", "hybrid")])


@query("M6_phenotype_gate", f"""WITH {CELLS}, {NODES}, {MED}, {COV}, {D2},
g AS (
  SELECT patient_id, node_id, hybrid >= CASE WHEN node_purity >= 0.6
           THEN greatest(0.5 * (1 - 0.5 * least((node_purity - 0.6) / 0.4, 1)), 0.1) ELSE 0.5 END AS pass_hybrid,
         score >= 2.2 AS pass_linear FROM h)
SELECT patient_id, count(*) FILTER (is_mrd_jf AND pass_hybrid) AS jf_hybrid,
       count(*) FILTER (is_mrd_flo AND pass_hybrid) AS flo_hybrid,
       count(*) FILTER (is_mrd_eln AND pass_hybrid) AS eln_hybrid,
       count(*) FILTER (is_mrd_jf AND pass_linear) AS jf_linear
FROM nodes JOIN g USING (patient_id, node_id) GROUP BY 1""")
def gate(spark, sf_dir):
    scored = hybrid_nodes(spark, sf_dir).drop("is_mrd_jf", "is_mrd_flo", "is_mrd_eln")
    hybrid = mrd.phenotype_gate(
        "hybrid", F.col("hybrid_score"), F.col("node_purity"), high=0.5, moderate=0.1, strict=0.6, relax=0.5)
    linear = mrd.phenotype_gate("linear", F.col("linear"), F.col("node_purity"))
    by_hybrid = mrd.flag_nodes(scored, gates={m: hybrid for m in mrd.METHODS})
    by_linear = mrd.flag_nodes(scored, gates={m: linear for m in mrd.METHODS})
    counts = by_hybrid.groupBy("patient_id").agg(
        *[F.count_if(f"is_mrd_{m}").alias(f"{m}_hybrid") for m in mrd.METHODS])
    return counts.join(by_linear.groupBy("patient_id").agg(F.count_if("is_mrd_jf").alias("jf_linear")), "patient_id")


@query("F12_directional_score", f"""WITH {CELLS}, {MED}
SELECT patient_id, round(avg(score), 5) AS mean_score, round(max(score), 5) AS max_score FROM scored GROUP BY 1""")
def directional_score(spark, sf_dir):
    score = blast.linear_score({m: f"z_{m}" for m in SCORED}, WEIGHTS)
    return node_z(spark, sf_dir).groupBy("patient_id").agg(
        F.round(F.avg(score), 5).alias("mean_score"), F.round(F.max(score), 5).alias("max_score"))


@query("A16_reference_stats", f"""WITH {CELLS}, {MED}, {COV}
SELECT round(m1, 6) AS med_ssc, round(s1, 6) AS spread_ssc, round(m4, 6) AS med_hla, round(s4, 6) AS spread_hla,
       round(bb / (aa * bb - ab * ab), 9) AS inv_aa, round(-ab / (aa * bb - ab * ab), 9) AS inv_ab,
       round(aa / (aa * bb - ab * ab), 9) AS inv_bb FROM ref, dev""")
def reference(spark, sf_dir):
    healthy = cells(spark, sf_dir).where(F.col("condition") == "Sain")
    center, spread = reference_stats(healthy, ["SSC_A", "HLA_DR"])
    _, inverse = reference_covariance(healthy, ["SSC_A", "HLA_DR"])
    values = {
        "med_ssc": (center["SSC_A"], 6), "spread_ssc": (spread["SSC_A"], 6), "med_hla": (center["HLA_DR"], 6),
        "spread_hla": (spread["HLA_DR"], 6), "inv_aa": (inverse[0][0], 9), "inv_ab": (inverse[0][1], 9),
        "inv_bb": (inverse[1][1], 9),
    }
    return spark.range(1).select(*[F.round(F.lit(float(v)), d).alias(k) for k, (v, d) in values.items()])


TRACE = """per_file AS (SELECT node_id, file_origin, count(*) AS n FROM cells GROUP BY 1, 2),
files AS (SELECT node_id, string_agg(file_origin || ':' || n, ', ' ORDER BY n DESC, file_origin) AS sources, count(*) AS n_files
          FROM per_file GROUP BY 1),
tot AS (SELECT node_id, count(*) AS n_cells, 100.0 * count(*) FILTER (condition = 'Pathologique') / count(*) AS pct_patho
        FROM cells GROUP BY 1),
cand AS (SELECT node_id, max(score) AS score FROM scored GROUP BY 1)"""


@query("J7_blast_source_trace", f"""WITH {CELLS}, {MED}, {TRACE}
SELECT node_id, n_cells, n_files, sources, round(pct_patho, 6) AS pct_patho, round(score, 2) AS blast_score,
       score >= 6 AND pct_patho >= 50 AS alert FROM cand JOIN files USING (node_id) JOIN tot USING (node_id)
WHERE score > 0""")
def source_trace(spark, sf_dir):
    from marrowgrid.operators.aggregates import source_trace as trace

    score = blast.linear_score({m: f"z_{m}" for m in SCORED}, WEIGHTS)
    candidates = node_z(spark, sf_dir).groupBy("node_id").agg(F.max(score).alias("blast_score"))
    out = trace(cells(spark, sf_dir), candidates.where("blast_score > 0"), "node_id")
    return out.withColumns({"pct_patho": F.round("pct_patho", 6), "blast_score": F.round("blast_score", 2)})
