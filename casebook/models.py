"""Vectors: nearest codes, neighbours, maps, metaclusters, population mapping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from casebook import statements as stm
from casebook.base import CELLS, query, rounded
from marrowgrid.functions import vectors as vec
from marrowgrid.operators import graph
from marrowgrid.operators import mapping as mp
from marrowgrid.operators import metacluster as mc
from marrowgrid.operators import neighbors as nb
from marrowgrid.operators import som
from marrowgrid.operators.selection import hash_order
from marrowgrid.operators.sizing import folded, model_rows
from marrowgrid.sources.tables import cells, vectors

VEC = """v AS (SELECT vec_id, embedding::DOUBLE[] AS x, label AS population FROM embeddings),
e AS (SELECT vec_id, population, unnest(x) AS val, generate_subscripts(x, 1) - 1 AS marker FROM v)"""
POPS = f"""{VEC},
p AS (SELECT population, marker, avg(val) AS v, var_samp(val) AS var, count(*) AS n_cells FROM e GROUP BY 1, 2),
c AS (SELECT population, list(v ORDER BY marker) AS code FROM p GROUP BY 1)"""


def population_codes(spark, sf_dir):
    """Mean vector of every population: a small codebook."""
    long = vectors(spark, sf_dir).select("population", F.posexplode("x").alias("i", "v"))
    means = long.groupBy("population", "i").agg(F.avg("v").alias("v"))
    rows = sorted(map(tuple, model_rows(means)))
    names = sorted({r[0] for r in rows})
    return names, np.array([[r[2] for r in rows if r[0] == n] for n in names])


@query("J4_nearest_code", f"""WITH {POPS}, d AS (SELECT vec_id, c.population, list_distance(x, code) AS d FROM v, c)
SELECT vec_id, arg_min(population, d)::BIGINT AS node_id, round(min(d), 6) AS distance FROM d GROUP BY 1""")
def nearest_code(spark, sf_dir):
    names, codes = population_codes(spark, sf_dir)
    out = nb.nearest_code(vectors(spark, sf_dir).select("vec_id", "x"), codes, names)
    return out.withColumn("distance", F.round("distance", 6))


@query("C3_project_frozen", f"""WITH {POPS}, d AS (SELECT vec_id, v.population, c.population AS node, list_distance(x, code) AS d FROM v, c),
a AS (SELECT vec_id, population, arg_min(node, d) AS node, min(d) AS d FROM d GROUP BY 1, 2)
SELECT node::BIGINT AS node_id, count(*) AS n, count(*) FILTER (node = population) AS n_own, round(avg(d), 6) AS mean_distance FROM a GROUP BY 1""")
def project_frozen(spark, sf_dir):
    names, codes = population_codes(spark, sf_dir)
    model = som.SomModel(len(names), 1, {None: codes})
    out = model.transform(vectors(spark, sf_dir))
    return out.groupBy("node_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("node_id") == F.col("population")).alias("n_own"),
        F.round(F.avg("distance"), 6).alias("mean_distance"))


@query("F17_vector_distances", f"""WITH {POPS}
SELECT vec_id, round(list_distance(x, code), 6) AS euclidean, round(list_sum([abs(a[1] - a[2]) FOR a IN list_zip(x, code)]), 6) AS manhattan,
       round(list_max([abs(a[1] - a[2]) FOR a IN list_zip(x, code)]), 6) AS chebyshev, round(1 - list_cosine_similarity(x, code), 6) + 0.0 AS cosine
FROM v JOIN c USING (population)""")
def vector_distances(spark, sf_dir):
    names, codes = population_codes(spark, sf_dir)
    book = spark.createDataFrame([(n, [float(v) for v in c]) for n, c in zip(names, codes)], "population int, code array<double>")
    pair = vectors(spark, sf_dir).join(book, "population")
    return pair.select("vec_id", *[rounded(fn("x", "code"), 6).alias(n) for n, fn in vec.DISTANCES.items()])


KNN = """pair AS (SELECT a.vec_id AS query_id, b.vec_id AS base_id, list_distance(a.x, b.x) AS d FROM v a, v b WHERE a.vec_id <> b.vec_id),
nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, base_id) AS rank FROM pair QUALIFY rank <= 15)"""


@query("J6_knn", f"WITH {VEC}, {KNN} SELECT query_id, base_id, round(d, 6) AS distance, rank FROM nn")
def knn(spark, sf_dir):
    v = vectors(spark, sf_dir)
    out = nb.knn(v.withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "base_id"), 15)
    return out.withColumn("distance", F.round("distance", 6))


@query("J6_knn_by_cells", f"WITH {VEC}, {KNN} SELECT query_id, base_id, round(d, 6) AS distance, rank FROM nn WHERE rank <= 5")
def knn_by_cells(spark, sf_dir):
    """The path for a base too large to ship, forced by a tiny limit."""
    v = vectors(spark, sf_dir)
    out = nb.knn(v.withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "base_id"), 5, shipped_numbers=640, block_rows=64, cell_share=2.0)
    return out.withColumn("distance", F.round("distance", 6))


@query("J6_knn_by_rounds", f"WITH {VEC}, {KNN} SELECT query_id, base_id, round(d, 6) AS distance, rank FROM nn WHERE rank <= 5")
def knn_by_rounds(spark, sf_dir):
    """The path for a large base in many dimensions: cells would leave nearly all pairs, so base blocks go round."""
    v = vectors(spark, sf_dir)
    out = nb.knn(v.withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "base_id"), 5, shipped_numbers=640, block_rows=64)
    return out.withColumn("distance", F.round("distance", 6))


@query("J6_index_recall", f"""WITH {VEC} SELECT count(*) FILTER (vec_id % 100 = 0) AS queries, 15 * count(*) FILTER (vec_id % 100 = 0) AS neighbours,
   true AS reached FROM v""")
def index_recall(spark, sf_dir):
    """Every hundredth row against all rows: neighbours of the index held against exact ones, 0.9 or more must be reached."""
    v = vectors(spark, sf_dir).select("vec_id", "x")
    asked, base = v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "base_id")
    index, exact = nb.Index(base), nb.knn(asked, base, 15)
    probes, _ = index.tuned(asked, exact, 15)
    got = nb.recall(index.search(asked, 15, probes), exact)
    return got.select("queries", "neighbours", (F.col("recall") >= 0.9).alias("reached"))


def marker_vectors(spark, sf_dir):
    """Scaled marker vectors of all events."""
    scaled = [F.col("CD45") / 10, F.col("CD34") / 8, F.col("HLA_DR") / 2000, F.col("SSC_A") / 50]
    return cells(spark, sf_dir).select("event_id", "patient_id", "condition", F.array(*scaled).alias("x"))


@query("C1_som_train", stm.SOM_TRAIN)
def som_train(spark, sf_dir):
    model = som.fit_som(marker_vectors(spark, sf_dir), xdim=7, ydim=7, epochs=3)
    out = model.transform(marker_vectors(spark, sf_dir))
    return out.groupBy("node_id").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 4).alias("quantization"))


@query("C4_outliers", f"""WITH {POPS}, d AS (SELECT vec_id, c.population, list_distance(x, code) AS d FROM v, c),
a AS (SELECT vec_id, arg_min(population, d) AS node, min(d) AS d FROM d GROUP BY 1),
m AS (SELECT node, median(d) AS m FROM a WHERE vec_id % 2 = 0 GROUP BY 1),
l AS (SELECT a.node, any_value(m) + 1.5 * median(abs(d - m)) AS t FROM a JOIN m USING (node) WHERE vec_id % 2 = 0 GROUP BY 1)
SELECT node::BIGINT AS node_id, round(any_value(t), 6) AS threshold, count(*) AS n, count(*) FILTER (d > t) AS n_outliers, round(max(d), 6) AS max_distance
FROM a JOIN l USING (node) WHERE vec_id % 2 = 1 GROUP BY 1""")
def outliers(spark, sf_dir):
    """Even rows are the reference acquisition, odd rows the follow-up."""
    names, codes = population_codes(spark, sf_dir)
    placed = nb.nearest_code(vectors(spark, sf_dir).select("vec_id", "x"), codes, names)
    out = som.flag_outliers(placed.where("vec_id % 2 = 0"), placed.where("vec_id % 2 = 1"), factor=1.5)
    return out.withColumns({"threshold": F.round("threshold", 6), "max_distance": F.round("max_distance", 6)})


@query("C4_channel_outliers", f"""WITH {CELLS}, code AS (
  SELECT metacluster AS node, avg(CD45) AS c45, avg(HLA_DR) AS hla FROM cells WHERE condition = 'Sain' GROUP BY 1),
e AS (SELECT file_origin, condition, metacluster AS node, unnest(['CD45', 'HLA_DR']) AS channel, unnest([abs(CD45 - c45), abs(HLA_DR - hla)]) AS d
      FROM cells JOIN code ON node = metacluster),
m AS (SELECT node, channel, median(d) AS m FROM e WHERE condition = 'Sain' AND node > 0 GROUP BY 1, 2),
l AS (SELECT node, channel, any_value(m) + 2 * median(abs(d - m)) AS t FROM e JOIN m USING (node, channel) WHERE condition = 'Sain' GROUP BY 1, 2)
SELECT node AS metacluster, channel, round(coalesce(any_value(t), 0), 6) AS threshold, count(*) AS n, count(*) FILTER (d > coalesce(t, 0)) AS n_outliers
FROM e LEFT JOIN l USING (node, channel) WHERE condition <> 'Sain' GROUP BY 1, 2""")
def channel_outliers(spark, sf_dir):
    """Healthy events give the limits of each channel; one node is unknown to them and has limit zero."""
    events = cells(spark, sf_dir)
    healthy = events.where("condition = 'Sain'")
    codes = healthy.groupBy("metacluster").agg(F.avg("CD45").alias("CD45"), F.avg("HLA_DR").alias("HLA_DR"))
    out = som.channel_outliers(
        healthy.where("metacluster > 0"), events.where("condition <> 'Sain'"), codes, ["CD45", "HLA_DR"], node="metacluster", factor=2.0)
    return out.withColumn("threshold", F.round("threshold", 6))


@query("A11_outlier_grid", f"""WITH {POPS}, d AS (SELECT vec_id, c.population, list_distance(x, code) AS d FROM v, c),
a AS (SELECT vec_id, vec_id % 7 AS file, arg_min(population, d) AS node, min(d) AS d FROM d GROUP BY 1, 2),
m AS (SELECT node, median(d) AS m FROM a WHERE file < 3 AND node <> 4 GROUP BY 1),
l AS (SELECT a.node, any_value(m) + 1.5 * median(abs(d - m)) AS t FROM a JOIN m USING (node) WHERE file < 3 GROUP BY 1),
n AS (SELECT file, a.node, count(*) AS n, count(*) FILTER (d > coalesce(t, 0)) AS n_outliers FROM a LEFT JOIN l USING (node) WHERE file >= 3 GROUP BY 1, 2)
SELECT f.file, g.node::BIGINT AS node_id, coalesce(n, 0) AS n, coalesce(n_outliers, 0) AS n_outliers
FROM (SELECT DISTINCT file FROM a WHERE file >= 3) f, range(12) g(node) LEFT JOIN n ON n.file = f.file AND n.node = g.node""")
def outlier_grid(spark, sf_dir):
    """Every file by every node of a map of twelve, of which ten are ever reached and one is unknown to the reference."""
    names, codes = population_codes(spark, sf_dir)
    placed = nb.nearest_code(vectors(spark, sf_dir).select("vec_id", "x", (F.col("vec_id") % 7).alias("file")), codes, names)
    return som.outlier_grid(placed.where("file < 3 AND node_id <> 4"), placed.where("file >= 3"), "file", 12, factor=1.5).select("file", "node_id", "n", "n_outliers")


def patient_codebooks(spark, sf_dir):
    """Node mean vectors of every patient as codebooks of equal layout."""
    return marker_vectors(spark, sf_dir).join(
        cells(spark, sf_dir).select("event_id", "node_id"), "event_id").groupBy(
        F.col("patient_id").cast("string").alias("model_id"), "node_id").agg(
        F.array(*[F.avg(F.col("x")[i]) for i in range(4)]).alias("code"))


@query("C5_metaclusters")
def metaclusters(spark, sf_dir):
    return mc.metacluster(patient_codebooks(spark, sf_dir), 8)


@query("C5_consensus_metaclusters")
def consensus(spark, sf_dir):
    return mc.consensus_metacluster(patient_codebooks(spark, sf_dir), 8)


TREE = f"""{POPS}, pts AS (SELECT population AS n, code FROM c),
w AS (SELECT a.n AS a, b.n AS b, list_distance(a.code, b.code) AS d FROM pts a, pts b WHERE a.n < b.n)"""


@query("C7_spanning_tree", f"""WITH RECURSIVE {TREE},
-- an edge belongs to the tree unless its ends are linked by shorter edges
reach AS (SELECT a AS src, b AS dst, d AS lim, a AS at FROM w UNION
          SELECT r.src, r.dst, r.lim, CASE WHEN w.a = r.at THEN w.b ELSE w.a END FROM reach r JOIN w ON (w.a = r.at OR w.b = r.at) AND w.d < r.lim)
SELECT 'all' AS model_id, a::BIGINT AS src, b::BIGINT AS dst, round(d, 6) AS weight FROM w
WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.src = w.a AND r.dst = w.b AND r.at = w.b)""")
def spanning_tree(spark, sf_dir):
    names, codes = population_codes(spark, sf_dir)
    book = spark.createDataFrame([("all", int(n), [float(v) for v in c]) for n, c in zip(names, codes)], "model_id string, node_id long, code array<double>")
    return mc.spanning_tree(book).withColumn("weight", F.round("weight", 6))


@query("C6_choose_k")
def choose_k(spark, sf_dir):
    events = marker_vectors(spark, sf_dir)
    kinds = folded(events.select("x"))
    try:
        codes = som.fit_som(events, xdim=6, ydim=6, rows=kinds).codes[None]
        best, scores = mc.choose_k(events, codes, range(3, 9), xdim=6, ydim=6, rows=kinds)
    finally:
        kinds.unpersist()
    rows = [(k, s, st, cp, k == best) for k, s, st, cp in scores]
    return spark.createDataFrame(rows, "k int, silhouette double, stability double, composite double, chosen boolean")


@query("C10_graph_communities", f"""WITH {VEC}, {KNN}, {stm.communities(40)}, sz AS (SELECT label, count(*) AS n FROM lab40 GROUP BY 1),
cm AS (SELECT label, row_number() OVER (ORDER BY n DESC, label) - 1 AS community FROM sz)
SELECT id AS vec_id, community FROM lab40 JOIN cm USING (label)""")
def graph_communities(spark, sf_dir):
    """Communities once no label moves any more; the statement goes on for forty steps, more than these graphs need."""
    return graph.graph_clusters(vectors(spark, sf_dir).select("vec_id", "x"), 15, node="vec_id")


# --- population mapping ------------------------------------------------------

NODE = f"""{POPS},
n AS (SELECT vec_id % 40 AS node_id, marker, avg(val) AS v FROM e GROUP BY 1, 2),
size AS (SELECT vec_id % 40 AS node_id, count(*) AS size FROM v GROUP BY 1),
nc AS (SELECT population, max(n_cells) AS n_cells FROM p GROUP BY 1),
s AS (SELECT marker, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.9) AS p90,
             min(asinh(v / 5)) AS alo, max(asinh(v / 5)) AS ahi FROM n GROUP BY 1),
rr AS (SELECT marker, max(v) - min(v) AS rr FROM p GROUP BY 1),
j AS (SELECT node_id, population, n.v, p.v AS p, p.var, (n.v - lo) / (hi - lo) AS xn, greatest((p.v - lo) / (hi - lo), 0) AS pn,
             (asinh(n.v / 5) - alo) / (ahi - alo) AS xa, greatest((asinh(p.v / 5) - alo) / (ahi - alo), 0) AS pa,
             p90 - p10 AS rob, rr, hi - lo AS unit FROM n JOIN p USING (marker) JOIN s USING (marker) JOIN rr USING (marker)),
dist AS (SELECT node_id, population, sqrt(sum((xn - pn) ** 2)) AS M1, sum(abs(xn - pn)) AS M2,
             1 - sum(greatest(xn, 0) * pn) / (sqrt(sum(greatest(xn, 0) ** 2)) * sqrt(sum(pn ** 2))) AS M3,
             sqrt(sum(((v - p) / rob) ** 2)) AS M4, sqrt(sum((xa - pa) ** 2)) AS M5, sqrt(sum((xn - pn) ** 2)) AS M6,
             sqrt(sum(((v - p) / rr) ** 2)) AS M8, sqrt(sum((xn - pn) ** 2 * unit * unit / var)) AS M10 FROM j GROUP BY 1, 2),
ranked AS (SELECT *, (row_number() OVER (w ORDER BY M2, population) + row_number() OVER (w ORDER BY M3, population)
             + row_number() OVER (w ORDER BY M8, population) - 3) / (count(*) OVER w - 1) AS M7,
             CASE WHEN size > n_cells / (SELECT sum(n_cells) FROM nc) * (SELECT sum(size) FROM size) * 5 THEN 'inf'::DOUBLE
                  ELSE M8 / log10(greatest(n_cells, 10)) END AS M9,
             CASE WHEN size > n_cells / (SELECT sum(n_cells) FROM nc) * (SELECT sum(size) FROM size) * 5 THEN 'inf'::DOUBLE
                  ELSE M3 / pow(log10(greatest(n_cells, 10)), 3) END AS M12
           FROM dist JOIN size USING (node_id) JOIN nc USING (population) WINDOW w AS (PARTITION BY node_id))"""


def nodes_long(spark, sf_dir):
    long = vectors(spark, sf_dir).select((F.col("vec_id") % 40).alias("node_id"), F.posexplode("x").alias("m", "value"))
    return long.groupBy("node_id", F.col("m").cast("string").alias("marker")).agg(F.avg("value").alias("v"))


def populations_long(spark, sf_dir):
    return mp.vector_reference(vectors(spark, sf_dir), "population")


def node_sizes(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy((F.col("vec_id") % 40).alias("node_id")).agg(F.count("*").alias("size"))


_WIDE = ["M1", "M2", "M3", "M4", "M5", "M6", "M8", "M10"]


@query("J5_node_population_distances", f"WITH {NODE} SELECT node_id, population::VARCHAR AS population, " + ", ".join(
    f"round({m}, 6) AS {m}" for m in _WIDE) + " FROM dist")
def node_population(spark, sf_dir):
    out = mp.node_distances(nodes_long(spark, sf_dir), populations_long(spark, sf_dir))
    return out.select("node_id", "population", *[F.round(m, 6).alias(m) for m in _WIDE])


MAP_NEAREST = f"""WITH {NODE}, b AS (SELECT node_id, arg_min(population, M1)::VARCHAR AS best_pop, min(M1) AS d FROM dist GROUP BY 1),
t AS (SELECT quantile_cont(d, 0.6) AS t FROM b)
SELECT node_id, best_pop, round(d, 5) AS best_dist, round(t, 5) AS threshold, CASE WHEN d <= t THEN best_pop ELSE 'Unknown' END AS assigned_pop FROM b, t"""


@query("B1_map_nearest", MAP_NEAREST)
def map_nearest(spark, sf_dir):
    out = mp.map_nearest(nodes_long(spark, sf_dir), populations_long(spark, sf_dir))
    return out.withColumns({"best_dist": F.round("best_dist", 5), "threshold": F.round("threshold", 5)})


@query("B3_prevalence_prior", f"WITH {NODE} SELECT node_id, population::VARCHAR AS population, round(M9, 6) AS M9, round(M12, 8) AS M12 FROM ranked")
def prevalence_prior(spark, sf_dir):
    out = mp.all_metrics(nodes_long(spark, sf_dir), populations_long(spark, sf_dir), node_sizes(spark, sf_dir))
    wide = out.where("method IN ('M9', 'M12')").groupBy("node_id", "population").pivot("method", ["M9", "M12"]).agg(F.first("dist"))
    return wide.select("node_id", "population", F.round("M9", 6).alias("M9"), F.round("M12", 8).alias("M12"))


@query("B3_linear_prior", f"""WITH {NODE} SELECT node_id, population::VARCHAR AS population,
   round(CASE WHEN isinf(M9) THEN M9 ELSE M8 / greatest(greatest(n_cells, 1) / greatest((SELECT avg(n_cells) FROM nc), 1), 1e-9) END, 6) AS dist FROM ranked""")
def linear_prior(spark, sf_dir):
    """The weight in proportion to a population's cells."""
    wide = mp.node_distances(nodes_long(spark, sf_dir), populations_long(spark, sf_dir)).join(node_sizes(spark, sf_dir), "node_id")
    out = wide.select("node_id", "population", mp.with_prior(F.col("M8"), "linear").alias("dist"))
    return out.withColumn("dist", F.round("dist", 6))


@query("W3_rank_normalized", f"WITH {NODE} SELECT node_id, population::VARCHAR AS population, round(M7, 8) AS M7 FROM ranked")
def rank_normalized(spark, sf_dir):
    out = mp.all_metrics(nodes_long(spark, sf_dir), populations_long(spark, sf_dir), node_sizes(spark, sf_dir))
    return out.where("method = 'M7'").select("node_id", "population", F.round("dist", 8).alias("M7"))


def pool(spark, sf_dir):
    return mp.stratified_pool(vectors(spark, sf_dir), "population", hash_order("vec_id"), total=300, minimum=20)


POOL = f"""sz AS (SELECT population, count(*) AS n, greatest(20, floor(300.0 * count(*) / sum(count(*)) OVER ())) AS quota FROM v GROUP BY 1),
pool AS (SELECT * FROM (SELECT v.*, quota, row_number() OVER (PARTITION BY population ORDER BY md5(concat_ws('|', '42', vec_id))) AS k
         FROM v JOIN sz USING (population)) WHERE k <= quota)"""


VOTE = """nv AS (SELECT node_id, list(v ORDER BY marker) AS x FROM n GROUP BY 1),
nd AS (SELECT node_id, vec_id, population, list_distance(nv.x, pool.x) AS d FROM nv, pool),
nn AS (SELECT * FROM nd QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY d, vec_id) <= 15),
vt AS (SELECT node_id, population, count(*) AS c, min(min(d)) OVER (PARTITION BY node_id) AS dist FROM nn GROUP BY 1, 2),
vote AS (SELECT node_id, population, dist FROM vt QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY c DESC, population::VARCHAR) = 1),
voted AS (SELECT ranked.*, coalesce(vote.dist, 'inf'::DOUBLE) AS M11 FROM ranked LEFT JOIN vote USING (node_id, population))"""


def votes(spark, sf_dir):
    nodes = nodes_long(spark, sf_dir).groupBy("node_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("marker").cast("int").alias("m"), "v"))).alias("_s"))
    nodes = nodes.select("node_id", F.transform("_s", lambda s: s["v"]).alias("x"))
    return mp.knn_vote(nodes, pool(spark, sf_dir).withColumnRenamed("vec_id", "pool_id"))


BEST = f"""{NODE}, {POOL}, {VOTE}, lng AS (""" + " UNION ALL ".join(
    f"SELECT node_id, population, '{m}' AS method, {m} AS dist FROM voted" for m in mp.METRICS) + """),
b AS (SELECT method, node_id, (min({'d': dist, 'p': population::VARCHAR})).p AS best_pop, min(dist) AS d FROM lng GROUP BY 1, 2)"""
OTSU = f"""{BEST},
hb AS (SELECT method, d, min(d) OVER (PARTITION BY method) AS lo, (max(d) OVER (PARTITION BY method) - min(d) OVER (PARTITION BY method)) / 64 AS w FROM b),
h AS (SELECT method, lo, w, least(floor((d - lo) / w), 63) AS bin, count(*) AS c FROM hb GROUP BY 1, 2, 3, 4),
cum AS (SELECT *, lo + (bin + 0.5) * w AS x, sum(c) OVER g AS n, sum(c * (lo + (bin + 0.5) * w)) OVER g AS nx,
               sum(c) OVER r AS cc, sum(c * (lo + (bin + 0.5) * w)) OVER r AS cx FROM h
        WINDOW g AS (PARTITION BY method), r AS (PARTITION BY method ORDER BY bin ROWS UNBOUNDED PRECEDING)),
vr AS (SELECT method, bin, x, CASE WHEN n > cc THEN round(cc / n * (1 - cc / n) * (cx / cc - (nx - cx) / (n - cc)) ** 2, 12) ELSE 0 END AS var FROM cum),
otsu AS (SELECT method, arg_min(x, bin) AS t FROM vr WHERE var = (SELECT max(var) FROM vr v2 WHERE v2.method = vr.method) GROUP BY 1),
stat AS (SELECT b.method, any_value(t) AS t, avg((d <= t)::INT) AS share, quantile_cont(d, 0.7) AS alt FROM b JOIN otsu USING (method) GROUP BY 1),
asg AS (SELECT b.*, CASE WHEN share < 0.3 THEN alt ELSE t END AS threshold,
               CASE WHEN d <= CASE WHEN share < 0.3 THEN alt ELSE t END THEN best_pop ELSE 'Unknown' END AS assigned_pop FROM b JOIN stat USING (method))"""


def metrics(spark, sf_dir):
    return mp.all_metrics(
        nodes_long(spark, sf_dir), populations_long(spark, sf_dir), node_sizes(spark, sf_dir), votes=votes(spark, sf_dir))


@query("B2_twelve_metrics", f"""WITH {OTSU}
SELECT method, node_id, best_pop, round(d, 5) AS best_dist, round(threshold, 5) AS threshold, assigned_pop FROM asg""")
def twelve_metrics(spark, sf_dir):
    out = mp.assign_populations(metrics(spark, sf_dir), ["method"])
    return out.withColumns({"best_dist": F.round("best_dist", 5), "threshold": F.round("threshold", 5)})


@query("B2_benchmark", f"""WITH {OTSU}, sc AS (SELECT method, count(DISTINCT assigned_pop) FILTER (assigned_pop <> 'Unknown') AS n_pops,
   avg((assigned_pop <> 'Unknown')::INT) AS fraction FROM asg GROUP BY 1)
SELECT method, n_pops, round(fraction, 8) AS fraction, round(n_pops * fraction, 8) AS score,
       row_number() OVER (ORDER BY n_pops * fraction DESC, CAST(method[2:] AS INT)) = 1 AS chosen FROM sc""")
def benchmark(spark, sf_dir):
    out = mp.benchmark(mp.assign_populations(metrics(spark, sf_dir), ["method"]))
    return out.withColumns({"fraction": F.round("fraction", 8), "score": F.round("score", 8)})


@query("B4_unknown_thresholds", f"""WITH {OTSU}, md AS (SELECT method, median(d) AS m FROM b GROUP BY 1)
SELECT method, round(any_value(t), 6) AS auto_otsu, round(quantile_cont(d, 0.7), 6) AS pct, round(avg(d) + stddev_pop(d), 6) AS mean_std,
       round(quantile_cont(d, 0.75) + 1.5 * (quantile_cont(d, 0.75) - quantile_cont(d, 0.25)), 6) AS median_iqr,
       round(any_value(m) + 2 * 1.4826 * median(abs(d - m)), 6) AS mad
FROM b JOIN otsu USING (method) JOIN md USING (method) WHERE isfinite(d) GROUP BY 1""")
def unknown_thresholds(spark, sf_dir):
    best = mp.best_population(metrics(spark, sf_dir), ["method", "node_id"])
    from marrowgrid.operators.sizing import as_model

    best = as_model(best)
    names = {"auto_otsu": "auto_otsu", "percentile": "pct", "mean_std": "mean_std", "median_iqr": "median_iqr", "mad": "mad"}
    out = None
    for mode, name in names.items():
        part = mp.unknown_threshold(best, ["method"], mode).select("method", F.round("threshold", 6).alias(name))
        out = part if out is None else out.join(part, "method")
    return out


@query("W7_otsu_running_sums", f"WITH {OTSU} SELECT method, round(t, 6) AS threshold FROM otsu")
def otsu_running(spark, sf_dir):
    best = mp.best_population(metrics(spark, sf_dir), ["method", "node_id"])
    return mp.otsu_threshold(best, ["method"], "best_dist").select("method", F.round("threshold", 6).alias("threshold"))


@query("B5_assignment_guarantee", f"""WITH {BEST}, t AS (SELECT method, quantile_cont(d, 0.05) AS t, quantile_cont(d, 0.7) AS alt FROM b GROUP BY 1),
g AS (SELECT b.method, any_value(t) AS t, any_value(alt) AS alt, avg((d <= t)::INT) AS share FROM b JOIN t USING (method) GROUP BY 1)
SELECT method, count(*) FILTER (d <= CASE WHEN share < 0.3 THEN alt ELSE t END) AS n_assigned FROM b JOIN g USING (method) GROUP BY 1""")
def assignment_guarantee(spark, sf_dir):
    # a first threshold at the 5th percentile leaves too few nodes
    out = mp.assign_populations(metrics(spark, sf_dir), ["method"], mode="percentile", percentile=5.0, fallback_percentile=70.0)
    return out.groupBy("method").agg(F.count_if(F.col("assigned_pop") != mp.UNKNOWN).alias("n_assigned"))


@query("B6_mahalanobis", f"WITH {NODE} SELECT node_id, arg_min(population, M10)::VARCHAR AS best_pop, round(min(M10), 6) AS best_dist FROM dist GROUP BY 1")
def mahalanobis(spark, sf_dir):
    wide = mp.node_distances(nodes_long(spark, sf_dir), populations_long(spark, sf_dir))
    best = mp.best_population(wide.withColumnRenamed("M10", "dist"), ["node_id"])
    return best.withColumn("best_dist", F.round("best_dist", 6))


@query("B7_stratified_pool", f"WITH {VEC}, {POOL} SELECT vec_id, population FROM pool")
def stratified_pool(spark, sf_dir):
    return pool(spark, sf_dir).select("vec_id", "population")


@query("B7_knn_vote", f"WITH {NODE}, {POOL}, {VOTE} SELECT node_id, population::VARCHAR AS population, round(dist, 6) AS dist FROM vote")
def knn_vote(spark, sf_dir):
    return votes(spark, sf_dir).withColumn("dist", F.round("dist", 6))


@query("S5_population_ridge", f"""WITH {CELLS}, t AS (SELECT metacluster AS population, event_id, asinh(CD45 / 5) AS a, asinh(HLA_DR / 5) AS b FROM cells),
m AS (SELECT population, count(*) AS n, avg(a) AS va, avg(b) AS vb, var_samp(a) AS sa, var_samp(b) AS sb FROM t GROUP BY 1),
s AS (SELECT population, count(*) AS n_sample, avg(a) AS ma, avg(b) AS mb FROM (
  SELECT *, row_number() OVER (PARTITION BY population ORDER BY md5(concat_ws('|', '42', event_id)), event_id) AS r FROM t) WHERE r <= 50 GROUP BY 1)
SELECT population::VARCHAR AS population, 'CD45' AS marker, n AS n_cells, round(va, 8) AS v, round(sa + 0.01 * greatest(sa, sb, 1), 8) AS var,
       n_sample, round(ma, 8) AS sample_mean FROM m JOIN s USING (population)
UNION ALL SELECT population::VARCHAR, 'HLA_DR', n, round(vb, 8), round(sb + 0.01 * greatest(sa, sb, 1), 8), n_sample, round(mb, 8) FROM m JOIN s USING (population)""")
def population_ridge(spark, sf_dir):
    """Mergeable moments with ridge, and a uniform sample of fifty cells of each population."""
    names = ["CD45", "HLA_DR"]
    reference, sample = mp.population_statistics(
        cells(spark, sf_dir), "metacluster", names, ["event_id"], ridge=0.01, sample_rows=50, transform=lambda c: F.asinh(c / 5))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("marker"), F.col(f"m_{m}").alias("sample_mean")) for m in names])).alias("s")
    means = sample.groupBy("population").agg(F.count("*").alias("n_sample"), *[F.round(F.avg(m), 8).alias(f"m_{m}") for m in names]) \
        .select("population", "n_sample", each).select("population", "n_sample", "s.*")
    return reference.join(means, ["population", "marker"]).withColumns({"v": F.round("v", 8), "var": F.round("var", 8)})


@query("S5_population_stats", f"""WITH {POPS} SELECT population::VARCHAR AS population, marker::VARCHAR AS marker, n_cells, round(v, 8) + 0.0 AS v, round(var, 8) AS var FROM p""")
def population_stats(spark, sf_dir):
    out = populations_long(spark, sf_dir)
    return out.select("population", "marker", "n_cells", rounded("v", 8).alias("v"), F.round("var", 8).alias("var"))
