"""Transforms, normalisers, names, validation, quality control."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from casebook.base import ACQ, CELLS, query, rounded
from marrowgrid.functions import names as nm
from marrowgrid.functions import numeric as num
from marrowgrid.functions import transforms as tr
from marrowgrid.operators import normalize as nz
from marrowgrid.operators import qc
from marrowgrid.operators import validate as va
from marrowgrid.sources.tables import acquisition, cells, table


@query("F1_arcsinh", f"""WITH {CELLS}
SELECT event_id, round(asinh(FSC_A / 150.0), 8) AS y, round(sinh(asinh(CD45 / 5.0)) * 5.0, 8) + 0.0 AS back FROM cells""")
def arcsinh(spark, sf_dir):
    return cells(spark, sf_dir).select(
        "event_id", F.round(tr.arcsinh("FSC_A", 150.0), 8).alias("y"),
        rounded(tr.arcsinh_inverse(tr.arcsinh("CD45")), 8).alias("back"))


@query("F2_logicle_closed", f"""WITH {CELLS}
SELECT event_id, round(asinh((FSC_A - 30000) / (262144.0 / pow(10, 4.5))) * (4.5 / ln(10)), 6) + 0.0 AS y FROM cells""")
def logicle_closed(spark, sf_dir):
    return cells(spark, sf_dir).select("event_id", rounded(tr.logicle_closed(F.col("FSC_A") - 30000), 6).alias("y"))


@query("F2_logicle_exact", f"""WITH {CELLS}
SELECT event_id, round(FSC_A - 30000, 3) + 0.0 AS recovered, FSC_A >= 30000 AS positive FROM cells""")
def logicle_exact(spark, sf_dir):
    """Exact scale and its closed inverse must give the intensity back."""
    y = tr.logicle(F.col("FSC_A") - 30000)
    scaled = cells(spark, sf_dir).select("event_id", y.alias("y"))
    zero = tr.logicle_parameters(tr.TOP, tr.DECADES, tr.LINEAR_WIDTH, tr.EXTRA)["x1"]
    return scaled.select(
        "event_id", rounded(tr.logicle_inverse("y"), 3).alias("recovered"), (F.col("y") >= zero).alias("positive"))


@query("F6_hyperlog_exact", f"""WITH {CELLS}
SELECT event_id, round(FSC_A - 30000, 3) + 0.0 AS recovered FROM cells""")
def hyperlog_exact(spark, sf_dir):
    scaled = cells(spark, sf_dir).select("event_id", tr.hyperlog(F.col("FSC_A") - 30000).alias("y"))
    return scaled.select("event_id", rounded(tr.hyperlog_inverse("y"), 3).alias("recovered"))


@query("F6_display_scales", f"""WITH {CELLS}
SELECT event_id, round((FSC_A + 100.0) / (262144.0 + 100.0), 9) AS lin,
       round((asinh(FSC_A * sinh(4.5 * ln(10)) / 262144.0) + 0.5 * ln(10)) / (5.0 * ln(10)), 8) AS ash FROM cells""")
def display_scales(spark, sf_dir):
    return cells(spark, sf_dir).select(
        "event_id", F.round(tr.linear_scale("FSC_A", 262144.0, 100.0), 9).alias("lin"),
        F.round(tr.arcsinh_scale("FSC_A", 262144.0, 4.5, 0.5), 8).alias("ash"))


@query("F3_floored_log", f"WITH {CELLS} SELECT event_id, round(ln(greatest(CD45, 1)) / ln(10), 8) + 0.0 AS y FROM cells")
def floored_log(spark, sf_dir):
    return cells(spark, sf_dir).select("event_id", rounded(tr.floored_log("CD45"), 8).alias("y"))


@query("F4_transform_markers", f"""WITH {CELLS}
SELECT event_id, FSC_A, SSC_A, round(asinh(CD45 / 5), 8) + 0.0 AS CD45, round(asinh(CD34 / 5), 8) + 0.0 AS CD34,
       round(asinh(HLA_DR / 5), 8) AS HLA_DR FROM cells""")
def transform_markers(spark, sf_dir):
    markers = ["FSC_A", "SSC_A", "CD45", "CD34", "HLA_DR"]
    out = tr.transform_markers(cells(spark, sf_dir).select("event_id", *markers), markers, "arcsinh")
    return out.withColumns({m: rounded(m, 8) for m in ("CD45", "CD34", "HLA_DR")})


@query("F5_transform_columns", f"""WITH {CELLS}
SELECT event_id, round(asinh(CD45 / 150), 9) + 0.0 AS CD45, round(ln(greatest(HLA_DR, 1)) / ln(2), 8) AS HLA_DR, SSC_A FROM cells""")
def transform_columns(spark, sf_dir):
    base = cells(spark, sf_dir).select("event_id", "CD45", "HLA_DR", "SSC_A")
    out = tr.transform_columns(base, {
        "CD45": {"method": "arcsinh", "cofactor": 150.0}, "HLA_DR": {"method": "log", "base": 2.0},
        "ABSENT": {"method": "arcsinh"}})
    return out.withColumns({"CD45": rounded("CD45", 9), "HLA_DR": F.round("HLA_DR", 8)})


@query("F9_fold_change", f"""WITH {CELLS}
SELECT node_id, round((count(*) FILTER (condition = 'Pathologique') / count(*))
   / greatest(count(*) FILTER (condition = 'Sain') / count(*), 1e-6), 6) AS fold FROM cells GROUP BY 1""")
def fold_change(spark, sf_dir):
    from marrowgrid.operators.stats import fold_change as fold

    share = cells(spark, sf_dir).groupBy("node_id").agg(
        F.avg((F.col("condition") == "Pathologique").cast("double")).alias("p"),
        F.avg((F.col("condition") == "Sain").cast("double")).alias("s"))
    return share.select("node_id", F.round(fold("p", "s"), 6).alias("fold"))


@query("F10_mrd_status", f"""WITH {CELLS},
f AS (SELECT patient_id, file_origin, (count(*) FILTER (CD34 >= 7.5 AND condition = 'Pathologique')) / count(*) AS fu,
             (count(*) FILTER (CD34 >= 7.5 AND condition = 'Sain')) / count(*) AS nbm FROM cells GROUP BY 1, 2)
SELECT file_origin, round(fu, 8) AS freq, round(fu / greatest(nbm, 1e-6), 6) AS fold,
       CASE WHEN fu < 0.02 THEN 'MRD_NEGATIVE' WHEN fu < 0.03 THEN 'MRD_DETECTABLE_BELOW_LOQ'
            WHEN fu / greatest(nbm, 1e-6) >= 1.9 THEN 'MRD_POSITIVE'
            WHEN fu > 0.05 THEN 'MRD_INDETERMINATE' ELSE 'MRD_NEGATIVE' END AS status FROM f""")
def mrd_status(spark, sf_dir):
    from marrowgrid.operators.stats import fold_change as fold
    from marrowgrid.operators.stats import mrd_status as status

    high = F.col("CD34") >= 7.5
    freq = cells(spark, sf_dir).groupBy("file_origin").agg(
        F.avg((high & (F.col("condition") == "Pathologique")).cast("double")).alias("fu"),
        F.avg((high & (F.col("condition") == "Sain")).cast("double")).alias("nbm"))
    made = status("fu", fold("fu", "nbm"), lod=0.02, loq=0.03, nbm_max=0.05)
    return freq.select(
        "file_origin", F.round("fu", 8).alias("freq"), F.round(fold("fu", "nbm"), 6).alias("fold"), made.alias("status"))


@query("F14_strings", """SELECT DISTINCT p_name, upper(split_part(p_name, ' ', 1)) AS first_word,
   contains(lower(p_name), 'ring') AS has_ring, regexp_extract(p_type || '-A', '-(A|H)$', 1) AS suffix,
   regexp_replace(p_name || '#' || p_type, '[^A-Za-z0-9._-]', '_', 'g') AS safe, lower(trim(p_name)) AS norm FROM part""")
def strings(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    return part.select(
        "p_name", F.upper(F.split("p_name", " ")[0]).alias("first_word"),
        F.lower("p_name").contains("ring").alias("has_ring"),
        F.regexp_extract(F.concat("p_type", F.lit("-A")), "-(A|H)$", 1).alias("suffix"),
        nm.safe_file_name(F.concat("p_name", F.lit("#"), "p_type")).alias("safe"),
        nm.normalized_name("p_name").alias("norm")).distinct()


@query("F15_condition_class", """SELECT CASE WHEN upper(o_orderpriority || c_mktsegment) SIMILAR TO '.*(URGENT|HIGH).*' THEN 'Pathologique'
   WHEN o_orderpriority LIKE '%LOW%' THEN 'Sain' ELSE 'Unknown' END AS condition, count(*) AS n
FROM (SELECT replace(replace(o_orderpriority, 'URGENT', 'DIAG URGENT'), 'HIGH', 'AML NBM HIGH') AS o_orderpriority, c_mktsegment
      FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1""")
def condition_class(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    # a patient word wins over a healthy one
    label = F.replace(F.replace("o_orderpriority", F.lit("URGENT"), F.lit("DIAG URGENT")), F.lit("HIGH"), F.lit("AML NBM HIGH"))
    label = F.replace(label, F.lit("LOW"), F.lit("nbm low"))
    name = F.concat(label, F.col("c_mktsegment"))
    return orders.groupBy(nm.condition_of(name).alias("condition")).agg(F.count("*").alias("n"))


@query("F16_finite", f"""WITH {CELLS}, w AS (SELECT event_id, CASE WHEN CD45 = 0 THEN NULL WHEN CD34 = 0 THEN 'inf'::DOUBLE
   WHEN SSC_A = 1 THEN '-inf'::DOUBLE ELSE HLA_DR END AS v FROM cells)
SELECT event_id, CASE WHEN v IS NULL THEN 0 WHEN v = 'inf'::DOUBLE THEN 1e6 WHEN v = '-inf'::DOUBLE THEN 0 ELSE v END AS v FROM w""")
def finite(spark, sf_dir):
    raw = (F.when(F.col("CD45") == 0, F.lit(None).cast("double")).when(F.col("CD34") == 0, F.lit(float("inf")))
           .when(F.col("SSC_A") == 1, F.lit(float("-inf"))).otherwise(F.col("HLA_DR")))
    return cells(spark, sf_dir).select("event_id", num.finite_or(raw, 0.0, 1e6, 0.0).alias("v"))


# --- normalisers -------------------------------------------------------------


@query("N1_zscore", f"""WITH {CELLS}
SELECT event_id, round((FSC_A - avg(FSC_A) OVER ()) / stddev_pop(FSC_A) OVER (), 6) + 0.0 AS FSC_A,
       round((CD45 - avg(CD45) OVER ()) / stddev_pop(CD45) OVER (), 6) + 0.0 AS CD45 FROM cells""")
def zscore(spark, sf_dir):
    out = nz.zscore(cells(spark, sf_dir).select("event_id", "FSC_A", "CD45"), ["FSC_A", "CD45"])
    return out.withColumns({m: rounded(m, 6) for m in ("FSC_A", "CD45")})


@query("N1_zscore_by_sample", f"""WITH {CELLS}
SELECT event_id, file_origin, round((FSC_A - avg(FSC_A) OVER w) / stddev_samp(FSC_A) OVER w, 6) + 0.0 AS FSC_A
FROM cells WINDOW w AS (PARTITION BY file_origin)""")
def zscore_by_sample(spark, sf_dir):
    out = nz.zscore(cells(spark, sf_dir).select("event_id", "file_origin", "FSC_A"), ["FSC_A"], ["file_origin"], ddof=1)
    return out.withColumn("FSC_A", rounded("FSC_A", 6))


@query("N2_minmax", f"""WITH {CELLS}
SELECT event_id, round((FSC_A - min(FSC_A) OVER ()) / (max(FSC_A) OVER () - min(FSC_A) OVER ()), 8) + 0.0 AS FSC_A,
       round((SSC_A - min(SSC_A) OVER ()) / (max(SSC_A) OVER () - min(SSC_A) OVER ()), 8) + 0.0 AS SSC_A FROM cells""")
def minmax(spark, sf_dir):
    out = nz.minmax(cells(spark, sf_dir).select("event_id", "FSC_A", "SSC_A"), ["FSC_A", "SSC_A"])
    return out.withColumns({m: rounded(m, 8) for m in ("FSC_A", "SSC_A")})


@query("N3_normalize_dispatch", f"""WITH {CELLS}
SELECT event_id, patient_id, round((SSC_A - min(SSC_A) OVER w) / (max(SSC_A) OVER w - min(SSC_A) OVER w), 8) + 0.0 AS SSC_A
FROM cells WINDOW w AS (PARTITION BY patient_id)""")
def normalize_dispatch(spark, sf_dir):
    base = cells(spark, sf_dir).select("event_id", "patient_id", "SSC_A")
    return nz.normalize(base, ["SSC_A"], "minmax", "sample", "patient_id").withColumn("SSC_A", rounded("SSC_A", 8))


@query("N4_robust_scale", f"""WITH {CELLS},
q AS (SELECT quantile_cont(FSC_A, 0.1) AS lo, quantile_cont(FSC_A, 0.9) AS hi FROM cells WHERE condition = 'Sain')
SELECT event_id, round((FSC_A - lo) / (hi - lo), 7) + 0.0 AS FSC_A FROM cells, q""")
def robust_scale(spark, sf_dir):
    base = cells(spark, sf_dir)
    healthy = base.where(F.col("condition") == "Sain")
    out = nz.robust(base.select("event_id", "FSC_A"), ["FSC_A"], fit_on=healthy)
    return out.withColumn("FSC_A", rounded("FSC_A", 7))


@query("N5_reference_normalization", f"""WITH {CELLS},
q AS (SELECT median(HLA_DR) AS m, greatest((quantile_cont(HLA_DR, 0.75) - quantile_cont(HLA_DR, 0.25)) / 1.35, 0.01) AS s
      FROM cells WHERE condition = 'Sain')
SELECT event_id, round((HLA_DR - m) / s, 6) + 0.0 AS HLA_DR FROM cells, q""")
def reference_normalization(spark, sf_dir):
    base = cells(spark, sf_dir)
    healthy = base.where(F.col("condition") == "Sain")
    out = nz.against_reference(base.select("event_id", "HLA_DR"), ["HLA_DR"], healthy)
    return out.withColumn("HLA_DR", rounded("HLA_DR", 6))


# --- channel names -----------------------------------------------------------

CHANNELS = """channels AS (
  SELECT p_partkey % 7 AS sample_id, p_partkey AS position,
         CASE p_size % 6 WHEN 0 THEN 'FSC' WHEN 1 THEN 'SSC' WHEN 2 THEN 'Time' ELSE 'CD' || (p_size % 40) END
         || CASE WHEN p_partkey % 4 = 3 THEN '' ELSE ' ' || replace(p_brand, '#', '') END
         || CASE WHEN p_partkey % 3 = 0 THEN '-H' WHEN p_partkey % 3 = 1 THEN '-A' ELSE '' END AS name FROM part)"""


def channels(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    head = (F.when(size % 6 == 0, "FSC").when(size % 6 == 1, "SSC").when(size % 6 == 2, "Time")
            .otherwise(F.concat(F.lit("CD"), size % 40)))
    dye = F.when(key % 4 == 3, "").otherwise(F.concat(F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit(""))))
    tail = F.when(key % 3 == 0, "-H").when(key % 3 == 1, "-A").otherwise("")
    return part.select((key % 7).alias("sample_id"), key.alias("position"), F.concat(head, dye, tail).alias("name"))


CANON = """CASE WHEN regexp_matches(name, '-(A|H)\\b') AND NOT regexp_matches(split_part(name, ' ', 1), '-(A|H)$')
   THEN split_part(name, ' ', 1) || '-' || upper(regexp_extract(name, '-(A|H)\\b', 1)) ELSE split_part(name, ' ', 1) END"""


@query("P7_canonical_names", f"WITH {CHANNELS} SELECT sample_id, name, {CANON} AS canonical FROM channels")
def canonical_names(spark, sf_dir):
    return channels(spark, sf_dir).select("sample_id", "name", nm.canonical_marker("name").alias("canonical"))


TARGETS = ["FSC-A", "FSC-H", "SSC-A", "CD3", "CD34", "CD34-A", "CD15-H", "CD21"]


@query("P7_harmonize", f"""WITH {CHANNELS}, d AS (SELECT DISTINCT sample_id, name FROM channels),
s AS (SELECT *, regexp_extract(name, '-(A|H)\\b', 1) AS suf FROM d),
m AS (SELECT sample_id, name, suf, CASE
    WHEN name IN ('FSC-A', 'FSC-H', 'SSC-A', 'CD3', 'CD34', 'CD34-A', 'CD15-H', 'CD21') THEN name
    WHEN regexp_matches(name, '^FSC([^a-zA-Z0-9]|$)') AND suf = 'A' THEN 'FSC-A'
    WHEN regexp_matches(name, '^FSC([^a-zA-Z0-9]|$)') AND suf = 'H' THEN 'FSC-H'
    WHEN regexp_matches(name, '^SSC([^a-zA-Z0-9]|$)') AND suf = 'A' THEN 'SSC-A'
    WHEN regexp_matches(name, '^CD3([^a-zA-Z0-9]|$)') THEN 'CD3'
    WHEN regexp_matches(name, '^CD34([^a-zA-Z0-9]|$)') THEN 'CD34'
    WHEN regexp_matches(name, '^CD15([^a-zA-Z0-9]|$)') AND suf = 'H' THEN 'CD15-H'
    WHEN regexp_matches(name, '^CD21([^a-zA-Z0-9]|$)') THEN 'CD21' END AS t FROM s),
r AS (SELECT sample_id, name, CASE WHEN t = 'CD34' AND suf = 'A' THEN 'CD34-A' ELSE t END AS target FROM m WHERE t IS NOT NULL)
SELECT *, count(*) OVER (PARTITION BY sample_id, target) > 1 AS conflict FROM r""")
def harmonize(spark, sf_dir):
    return nm.harmonize_channels(channels(spark, sf_dir), TARGETS)


@query("P6_drop_height_twins", f"""WITH {CHANNELS}
SELECT sample_id, position, name FROM channels c WHERE NOT (name LIKE '%-H' AND EXISTS (
  SELECT 1 FROM channels o WHERE o.sample_id = c.sample_id AND o.name = left(c.name, length(c.name) - 2) || '-A'))""")
def height_twins(spark, sf_dir):
    return nm.drop_height_twins(channels(spark, sf_dir)).select("sample_id", "position", "name")


@query("P4_resolve_roles", f"""WITH {CHANNELS},
hit AS (SELECT sample_id, name, position, 'scatter' AS role, CASE WHEN contains(upper(name), 'FSC') THEN 0
               WHEN contains(upper(name), 'SSC') THEN 1 END AS p FROM channels
        UNION ALL SELECT sample_id, name, position, 'blast', CASE WHEN contains(upper(name), 'CD34') THEN 0
               WHEN contains(upper(name), 'CD3') THEN 1 WHEN contains(upper(name), 'CD') THEN 2 END FROM channels)
SELECT sample_id, role, name FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, role ORDER BY p, position) AS k
  FROM hit WHERE p IS NOT NULL) WHERE k = 1""")
def roles(spark, sf_dir):
    return nm.resolve_roles(channels(spark, sf_dir), {"scatter": ["FSC", "SSC"], "blast": ["CD34", "CD3", "CD"]})


@query("P5_select_markers", f"WITH {CELLS} SELECT event_id, CD34, HLA_DR FROM cells")
def chosen_markers(spark, sf_dir):
    events = cells(spark, sf_dir)
    keep = nm.select_markers(["FSC_A", "FSC_H", "SSC_A", "CD45", "CD34", "HLA_DR"], blacklist=["CD45"])
    return events.select("event_id", *keep)


@query("P8_virtual_channel", f"WITH {CELLS} SELECT event_id, round(CD34 / (CD45 + 1), 8) + 0.0 AS ratio FROM cells")
def virtual_channel(spark, sf_dir):
    events = cells(spark, sf_dir).withColumn("ratio", F.col("CD34") / (F.col("CD45") + 1))
    return events.select("event_id", rounded("ratio", 8).alias("ratio"))


@query("S10_column_names", f"""WITH {CELLS} SELECT patient_id AS "patient_id_x", count(*) AS "n_events", round(avg(CD45), 6) AS "cd45_mean" FROM cells GROUP BY 1""")
def column_names(spark, sf_dir):
    raw = cells(spark, sf_dir).groupBy("patient_id").agg(F.count("*"), F.avg("CD45"))
    tuples = [("patient", "id", "x"), ("n", "events"), ("cd45", "mean")]
    renamed = raw.toDF(*["_".join(t) for t in tuples])
    return renamed.withColumn("cd45_mean", F.round("cd45_mean", 6))


@query("U2_common_channels", f"""WITH {CHANNELS}, c AS (SELECT DISTINCT sample_id, {CANON} AS name FROM channels)
SELECT name FROM c GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT sample_id) FROM c)""")
def common_channels(spark, sf_dir):
    from marrowgrid.operators.cohort import common_channels as common

    named = channels(spark, sf_dir).withColumn("name", nm.canonical_marker("name"))
    return common(named)


@query("U3_all_channels", f"WITH {CHANNELS} SELECT DISTINCT {CANON} AS name FROM channels")
def all_channels(spark, sf_dir):
    return channels(spark, sf_dir).select(nm.canonical_marker("name").alias("name")).distinct()


@query("U4_missing_channels", f"""WITH {CHANNELS}, c AS (SELECT DISTINCT sample_id, {CANON} AS name FROM channels)
SELECT s.sample_id, n.name FROM (SELECT DISTINCT sample_id FROM c) s, (SELECT DISTINCT name FROM c) n
EXCEPT SELECT sample_id, name FROM c""")
def missing_channels(spark, sf_dir):
    from marrowgrid.operators.cohort import missing_channels as missing

    named = channels(spark, sf_dir).withColumn("name", nm.canonical_marker("name"))
    return missing(named)


# --- validation --------------------------------------------------------------

GAPPY = """gappy AS (SELECT event_id, file_origin, condition, CASE WHEN l_tax = 0 THEN NULL ELSE CD34 END AS CD34, CD45, HLA_DR
  FROM (SELECT *, CD34 / 100 AS l_tax FROM cells))"""


def gappy(spark, sf_dir):
    return cells(spark, sf_dir).select(
        "event_id", "file_origin", "condition", F.when(F.col("CD34") != 0, F.col("CD34")).alias("CD34"), "CD45", "HLA_DR")


@query("V1_missing_values", f"""WITH {CELLS}, {GAPPY}
SELECT file_origin, count(*) FILTER (CD34 IS NULL) AS "nan_CD34", count(*) FILTER (CD45 IS NULL) AS "nan_CD45",
       count(*) FILTER (CD34 IS NULL OR CD45 IS NULL) AS rows_with_nan FROM gappy GROUP BY 1""")
def missing_values(spark, sf_dir):
    return va.missing_values(gappy(spark, sf_dir), ["CD34", "CD45"], ["file_origin"])


@query("V1_drop_or_fill", f"""WITH {CELLS}, {GAPPY}
SELECT 'drop' AS how, count(*) AS n, round(sum(CD34), 4) AS total FROM gappy WHERE CD34 IS NOT NULL
UNION ALL SELECT 'fill', count(*), round(sum(coalesce(CD34, 0)), 4) FROM gappy""")
def drop_or_fill(spark, sf_dir):
    def part(how):
        out = va.drop_or_fill(gappy(spark, sf_dir), ["CD34"], how)
        return out.agg(F.count("*").alias("n"), F.round(F.sum("CD34"), 4).alias("total")).select(
            F.lit(how).alias("how"), "n", "total")

    return part("drop").unionByName(part("fill"))


@query("V2_min_cells", f"""WITH {CELLS} SELECT event_id, file_origin FROM cells
WHERE file_origin IN (SELECT file_origin FROM cells GROUP BY 1 HAVING count(*) >= 600)""")
def min_cells(spark, sf_dir):
    return va.large_samples(cells(spark, sf_dir), "file_origin", 600).select("event_id", "file_origin")


@query("V3_missing_markers", f"""WITH {CHANNELS}, r AS (SELECT unnest(['CD34', 'CD45', 'FSC', 'CD9']) AS marker)
SELECT s.sample_id, r.marker FROM (SELECT DISTINCT sample_id FROM channels) s, r
WHERE NOT EXISTS (SELECT 1 FROM channels c WHERE c.sample_id = s.sample_id AND contains(upper(c.name), r.marker))""")
def missing_markers(spark, sf_dir):
    return va.missing_markers(channels(spark, sf_dir), ["CD34", "CD45", "FSC", "CD9"])


@query("V4_untransformed", f"""WITH {CELLS}
SELECT 'a' AS marker, round(avg((FSC_A - 20000 < -500)::INT), 8) AS share, avg((FSC_A - 20000 < -500)::INT) > 0.05 AS needs_transform FROM cells
UNION ALL SELECT 'b', round(avg((CD45 < -500)::INT), 8), avg((CD45 < -500)::INT) > 0.05 FROM cells""")
def untransformed(spark, sf_dir):
    raw = cells(spark, sf_dir).select((F.col("FSC_A") - 20000).alias("a"), F.col("CD45").alias("b"))
    return va.untransformed(raw, ["a", "b"]).withColumn("share", F.round("share", 8))


@query("V5_compensation_keyword", """SELECT event_id, event_type IN ('click', 'error') AS compensated FROM events""")
def compensation_keyword(spark, sf_dir):
    spill = F.col("event_type").isin("click", "error")
    events = table(spark, sf_dir, "events").select(
        "event_id", F.create_map(F.when(spill, "$SPILLOVER").otherwise("$DATE"), F.col("props")).alias("metadata"))
    return va.compensation_present(events).select("event_id", "compensated")


@query("V6_scatter_in_markers", f"""WITH {CHANNELS}
SELECT sample_id, name FROM channels WHERE (upper(name) LIKE '%FSC%' OR upper(name) LIKE '%SSC%' OR upper(name) LIKE '%TIME%')
  AND name IN (SELECT name FROM channels WHERE position % 5 = 0)""")
def scatter_in_markers(spark, sf_dir):
    named = channels(spark, sf_dir)
    chosen = named.where("position % 5 = 0").select("name").distinct()
    return va.scatter_among(named, chosen).select("sample_id", "name")


@query("V7_condition_balance", f"""WITH {CELLS}, c AS (SELECT condition, count(*) AS n FROM cells GROUP BY 1)
SELECT round(max(n) / min(n), 8) AS ratio, max(n) / min(n) <= 10 AS balanced FROM c""")
def condition_balance(spark, sf_dir):
    return va.condition_balance(cells(spark, sf_dir)).withColumn("ratio", F.round("ratio", 8))


@query("V8_all_checks", f"""WITH {CELLS}, {GAPPY},
c AS (SELECT condition, count(*) AS n FROM cells GROUP BY 1), r AS (SELECT max(n) / min(n) AS ratio FROM c)
SELECT 'nan_rows' AS "check", count(*) FILTER (CD34 IS NULL)::DOUBLE AS value, count(*) FILTER (CD34 IS NULL) = 0 AS passed FROM gappy
UNION ALL SELECT 'min_cells', count(*), count(*) >= 1000 FROM gappy
UNION ALL SELECT 'transformation', 0.0, TRUE UNION ALL SELECT 'no_scatter', 0.0, TRUE
UNION ALL SELECT 'balance', round(ratio, 8), ratio <= 10 FROM r""")
def all_checks(spark, sf_dir):
    markers = ["CD34", "CD45", "HLA_DR"]
    return va.run_checks(gappy(spark, sf_dir), markers, markers).withColumn("value", F.round("value", 8))


# --- quality control ---------------------------------------------------------

QC = f"""{ACQ},
med AS (SELECT sample_id, median(signal) AS m FROM acq GROUP BY 1),
mad AS (SELECT sample_id, m, median(abs(signal - m)) AS d FROM acq JOIN med USING (sample_id) GROUP BY 1, 2),
z AS (SELECT acq.*, m, d, CASE WHEN d > 0 THEN abs(signal - m) / (1.4826 * d) ELSE 0 END AS z FROM acq JOIN mad USING (sample_id)),
b AS (SELECT *, ntile(200) OVER (PARTITION BY sample_id ORDER BY time, event_id) AS bin,
             count(*) OVER (PARTITION BY sample_id) AS total FROM z),
v AS (SELECT sample_id, bin, NOT ((abs(median(signal) - max(m)) > 0.8 * 1.4826 * greatest(max(d), 1e-9) OR count(*) < 5)
             AND max(total) >= 10) AS qc_time FROM b GROUP BY 1, 2),
qc AS (SELECT event_id, sample_id, qc_time, z <= 3 AS qc_dispersion, qc_time AND z <= 3 AS qc_pass FROM b JOIN v USING (sample_id, bin))"""


def masked(spark, sf_dir):
    acq = acquisition(spark, sf_dir)
    center = qc.robust_center(acq, "sample_id", ["signal"])
    timed = qc.temporal_mask(acq, "sample_id", ["time", "event_id"], ["signal"], limit=0.8, min_rows=5, center=center)
    both = qc.dispersion_mask(timed, "sample_id", ["signal"], 3.0, center)
    return both.withColumn("qc_pass", F.col("qc_time") & F.col("qc_dispersion"))


@query("Q1_robust_z", f"WITH {QC} SELECT event_id, round(z, 6) AS z_signal FROM z")
def robust_z(spark, sf_dir):
    out = qc.robust_z(acquisition(spark, sf_dir), "sample_id", ["signal"])
    return out.select("event_id", F.round("z_signal", 6).alias("z_signal"))


@query("Q2_dispersion_mask", f"WITH {QC} SELECT event_id, z <= 5 AS qc_dispersion FROM z")
def dispersion(spark, sf_dir):
    return qc.dispersion_mask(acquisition(spark, sf_dir), "sample_id", ["signal"]).select("event_id", "qc_dispersion")


@query("Q3_temporal_mask", f"WITH {QC} SELECT event_id, qc_time FROM qc")
def temporal(spark, sf_dir):
    out = qc.temporal_mask(
        acquisition(spark, sf_dir), "sample_id", ["time", "event_id"], ["signal"], limit=0.8, min_rows=5)
    return out.select("event_id", "qc_time")


@query("Q4_qc_mask", f"WITH {QC} SELECT event_id, qc_pass FROM qc")
def qc_mask(spark, sf_dir):
    return masked(spark, sf_dir).select("event_id", "qc_pass")


@query("Q5_qc_report", f"""WITH {QC}
SELECT sample_id, count(*) AS n_events, count(*) FILTER (qc_pass) AS n_pass, round(avg(qc_time::INT), 8) AS frac_time,
       round(avg(qc_dispersion::INT), 8) AS frac_dispersion, round(avg(qc_pass::INT), 8) AS frac_pass,
       avg(qc_pass::INT) < 0.5 AS warn FROM qc GROUP BY 1""")
def qc_report(spark, sf_dir):
    out = qc.quality_report(masked(spark, sf_dir), "sample_id")
    return out.withColumns({c: F.round(c, 8) for c in ("frac_time", "frac_dispersion", "frac_pass")})


@query("W1_equal_count_bins", f"""WITH {ACQ}
SELECT event_id, ntile(200) OVER (PARTITION BY sample_id ORDER BY time, event_id) - 1 AS bin FROM acq""")
def equal_count_bins(spark, sf_dir):
    return qc.equal_count_bins(acquisition(spark, sf_dir), "sample_id", ["time", "event_id"], 200).select("event_id", "bin")


# --- timepoints --------------------------------------------------------------

FILES = """files AS (
  SELECT DISTINCT o_custkey % 10 AS patient_id, 'C' || o_custkey || 'x' || CASE o_custkey % 5
     WHEN 0 THEN '_' || strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '_' || strftime(o_orderdate, '%d.%m.%Y')
     WHEN 2 THEN ' ' || strftime(o_orderdate, '%d_%m_%y') WHEN 3 THEN '-' || strftime(o_orderdate, '%Y%m%d') ELSE '' END
     || '.fcs' AS file_origin,
     CASE WHEN o_custkey % 5 < 4 THEN CAST(o_orderdate AS DATE) END AS d
  FROM orders)"""


def files(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_custkey")
    stamp = (
        F.when(key % 5 == 0, F.concat(F.lit("_"), F.date_format("o_orderdate", "yyyy-MM-dd")))
        .when(key % 5 == 1, F.concat(F.lit("_"), F.date_format("o_orderdate", "dd.MM.yyyy")))
        .when(key % 5 == 2, F.concat(F.lit(" "), F.date_format("o_orderdate", "dd_MM_yy")))
        .when(key % 5 == 3, F.concat(F.lit("-"), F.date_format("o_orderdate", "yyyyMMdd"))).otherwise(F.lit("")))
    return orders.select((key % 10).alias("patient_id"), F.concat(F.lit("C"), key, F.lit("x"), stamp, F.lit(".fcs")).alias("file_origin"))


@query("S11_timepoints", f"""WITH {FILES}
SELECT patient_id, file_origin, coalesce(strftime(d, '%Y-%m-%d'), 'Unknown') AS timepoint,
       CASE WHEN d IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY patient_id, d IS NULL ORDER BY d, file_origin) END AS timepoint_num
FROM files""")
def timepoints(spark, sf_dir):
    return nm.timepoints(files(spark, sf_dir), by=["patient_id"])


@query("W2_file_rank", f"""WITH {FILES}
SELECT patient_id, max(n) AS last_rank, count(*) AS n_files FROM (
  SELECT patient_id, CASE WHEN d IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY patient_id, d IS NULL ORDER BY d, file_origin) END AS n
  FROM files) GROUP BY 1""")
def file_rank(spark, sf_dir):
    return nm.timepoints(files(spark, sf_dir), by=["patient_id"]).groupBy("patient_id").agg(
        F.max("timepoint_num").alias("last_rank"), F.count("*").alias("n_files"))
