"""Formulas restated in numpy, and fixtures of known outcome."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marrowgrid.functions import blast, gates, names, transforms
from marrowgrid.operators import aggregates as agg
from marrowgrid.operators import autogate as ag
from marrowgrid.operators import cohort, embed, gating, mapping, metacluster, mrd, qc, som, stats, unmix
from marrowgrid.operators.reference import robust_covariance
from marrowgrid.operators.selection import hash_order
from marrowgrid.plans.exports import effective_method
from marrowgrid.session import scratch_path
from marrowgrid.sources import fcs, sinks


@pytest.fixture(scope="module")
def matrix(spark):
    """1000 events, ten below and ten above the scatter range."""
    rng = np.random.default_rng(42)
    data = pd.DataFrame({
        "id": np.arange(1000), "FSC": rng.normal(50000, 8000, 1000), "SSC": rng.normal(30000, 5000, 1000),
        "CD45": rng.normal(1000, 200, 1000), "CD34": rng.normal(100, 20, 1000)})
    data.loc[:9, "FSC"] = 100.0
    data.loc[990:, "FSC"] = 200000.0
    return data, spark.createDataFrame(data)


# --- gates -------------------------------------------------------------------


def test_viable_gate_matches_numpy(matrix):
    data, df = matrix
    kept = {r["id"] for r in df.where(gating.gate_viable(df, "FSC", "SSC")).select("id").collect()}
    inside = np.ones(1000, dtype=bool)
    for c in ("FSC", "SSC"):
        lo, hi = np.percentile(data[c], [2, 98])
        inside &= (data[c] >= lo) & (data[c] <= hi)
    assert kept == set(data["id"][inside])
    assert not kept & set(range(10)) and not kept & set(range(990, 1000))


def test_missing_channel_is_not_tested(matrix):
    _, df = matrix
    assert df.where(gating.gate_viable(df, None, None)).count() == 1000
    assert df.where(gating.gate_singlets(None, "FSC")).count() == 1000


def test_gates_drop_nan_and_accept_empty(spark, matrix):
    _, df = matrix
    holes = df.withColumn("CD45", F.when(F.col("id") < 50, float("nan")).otherwise(F.col("CD45")))
    kept = holes.where(gating.gate_cd45(holes, "CD45"))
    assert kept.where("id < 50").count() == 0
    empty = df.where("id < 0")
    assert empty.where(gating.gate_viable(empty, "FSC", "SSC")).count() == 0


def test_polygon_is_even_odd(spark):
    star = [(0, 0), (4, 0), (4, 4), (2, 2), (0, 4)]
    pts = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0), (1.0, 2.5), (5.0, 1.0)], "x double, y double")
    got = [r[0] for r in pts.select(gates.in_polygon("x", "y", star)).collect()]
    assert got == [True, False, True, False]


def test_range_bounds(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    assert [r[0] for r in df.select(gates.in_range("x", 1.0, 3.0)).collect()] == [True, True, False]


def test_gate_tree_errors_and_inheritance(spark, matrix):
    _, df = matrix
    tree = gating.GateTree().add("a", F.col("FSC") > 1000).add("b", F.col("CD45") > 0, "a")
    assert df.where(tree.mask("b")).where("FSC <= 1000").count() == 0
    with pytest.raises(KeyError):
        tree.add("c", F.lit(True), "absent")
    with pytest.raises(ValueError):
        tree.population(df, "absent")
    tree.add("none", F.lit(False))
    with pytest.raises(ValueError):
        tree.population(df, "none")
    assert tree.population(df, "root").count() == 1000


def test_debris_mixture_removes_small_low_component(spark):
    rng = np.random.default_rng(0)
    main, low = rng.normal([60000, 30000], [5000, 4000], (4000, 2)), rng.normal([3000, 2000], [500, 500], (600, 2))
    df = spark.createDataFrame(pd.DataFrame(np.vstack([main, low]), columns=["f", "s"]))
    marked, report = ag.auto_debris_mixture(df, "f", "s")
    assert marked.where("f < 10000 AND not_debris").count() == 0
    assert marked.where("f > 30000 AND not_debris").count() > 3900
    assert report["components"] in (2, 3)


def test_debris_density_drops_outliers(spark):
    rng = np.random.default_rng(0)
    main, far = rng.normal([50, 50], [4, 4], (4000, 2)), rng.uniform(0, 200, (60, 2))
    df = spark.createDataFrame(pd.DataFrame(np.vstack([main, far]), columns=["f", "s"]))
    marked = ag.auto_debris_density(df, "f", "s")
    assert marked.where("f > 120 AND not_debris").count() == 0
    assert marked.where("abs(f - 50) < 4 AND abs(s - 50) < 4 AND NOT not_debris").count() == 0


def test_robust_singlets_flag_doublets(spark):
    rng = np.random.default_rng(0)
    h = rng.uniform(20000, 80000, 2000)
    a = h * 1.1 + rng.normal(0, 500, 2000)
    a[:100] *= 1.8
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(2000), "f": "x", "a": a, "h": h}))
    marked, report = ag.auto_singlets(df, "f", "a", "h", hash_order("id"))
    assert marked.where("id < 100 AND singlet").count() == 0
    assert marked.where("id >= 100 AND singlet").count() > 1800
    assert report.first()["method"] == "ransac"


def test_singlets_of_few_low_and_constant_rows(spark):
    few = spark.createDataFrame(pd.DataFrame({"id": np.arange(150), "f": "x", "a": 5000.0, "h": 4000.0}))
    marked, _ = ag.auto_singlets(few, "f", "a", "h", hash_order("id"))
    assert marked.where("singlet").count() == 150  # under 200 usable rows nothing is dropped
    flat = pd.DataFrame({"id": np.arange(600), "f": "x", "a": np.where(np.arange(600) < 40, 50.0, 5000.0), "h": 4000.0})
    flat = pd.concat([flat, pd.DataFrame({"id": np.arange(600, 610), "f": "small", "a": 9000.0, "h": 100.5})])
    marked, report = ag.auto_singlets(spark.createDataFrame(flat), "f", "a", "h", hash_order("id"))
    assert marked.where("a < 100 AND singlet").count() == 0
    assert marked.where("f = 'small' AND singlet").count() == 10
    assert {r["f"]: r["method"] for r in report.collect()}["small"] == "skip_too_few"


def test_feet_of_two_peaks(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(1, 0.2, 800), rng.normal(4, 0.4, 6000)])
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    left = ag.learn_threshold(df, F.col("v"), ag.left_foot).first()
    assert 1.8 < left["threshold"] < 3.4 and left["method"] == "kde_foot"
    u = np.concatenate([rng.normal(1, 0.3, 6000), rng.normal(5, 0.3, 500)])
    right = ag.learn_threshold(spark.createDataFrame(pd.DataFrame({"v": u})), F.col("v"), ag.right_foot).first()
    assert 1.5 < right["threshold"] < 4.5
    mixed = ag.learn_threshold(spark.createDataFrame(pd.DataFrame({"v": u})), F.col("v"), ag.mixture_cut).first()
    assert 2.0 < mixed["threshold"] < 4.5
    few = ag.learn_threshold(df.limit(50), F.col("v"), ag.left_foot).first()
    assert few["threshold"] is None


# --- residual disease ---------------------------------------------------------


def events_of(spark, counts):
    """{node: (n_sain, n_patho)} as events of one patient."""
    data = [(0, node, c) for node, (s, p) in counts.items() for c in ["Sain"] * s + ["Pathologique"] * p]
    return spark.createDataFrame(data, "patient_id long, node_id long, condition string")


def test_mrd_pure_nodes(spark):
    events = events_of(spark, {0: (0, 100), 1: (1000, 0)})
    nodes = {r["node_id"]: r for r in mrd.mrd_nodes(events).collect()}
    assert nodes[0]["is_mrd_jf"] and nodes[0]["is_mrd_flo"] and nodes[0]["is_mrd_eln"]
    assert not (nodes[1]["is_mrd_jf"] or nodes[1]["is_mrd_flo"] or nodes[1]["is_mrd_eln"])
    row = mrd.mrd_summary(events).first()
    assert row["mrd_pct_jf"] == 100.0 and row["eln_positive"] and not row["eln_low_level"]


def test_mrd_quantification_limit(spark):
    row = mrd.mrd_summary(events_of(spark, {0: (0, 49), 1: (1000, 951)})).first()
    assert row["mrd_cells_eln"] == 0 and row["mrd_cells_flo"] == 0
    strict = mrd.mrd_summary(events_of(spark, {0: (0, 49), 1: (1000, 951)}), mrd.MrdRules(min_cluster_events=10)).first()
    assert strict["mrd_cells_eln"] == 49


def test_mrd_low_level(spark):
    row = mrd.mrd_summary(events_of(spark, {0: (0, 60), 1: (200000, 100000)})).first()
    assert row["eln_low_level"] and not row["eln_positive"]


def test_mrd_one_sided_cohorts(spark):
    assert mrd.mrd_summary(events_of(spark, {0: (100, 0), 1: (50, 0)})).first()["mrd_pct_jf"] == 0.0
    assert mrd.mrd_summary(events_of(spark, {0: (0, 100), 1: (0, 500)})).first()["mrd_pct_eln"] == 100.0


def test_flow_multiplier_follows_imbalance(spark):
    # ten times more normal cells: the factor is 2 * 10
    events = events_of(spark, {0: (10, 150), 1: (10, 250), 2: (9980, 600)})
    flags = {r["node_id"]: r["is_mrd_flo"] for r in mrd.mrd_nodes(events).collect()}
    assert flags == {0: False, 1: True, 2: False}


def test_export_falls_back_to_the_other_method(spark):
    nodes = spark.createDataFrame([(1, False, True), (2, False, False)], "n int, is_mrd_flo boolean, is_mrd_jf boolean")
    assert effective_method(nodes, "flo", "jf") == "jf"
    assert effective_method(nodes, "jf", "flo") == "jf"


def test_linear_score_matches_numpy(spark):
    rng = np.random.default_rng(0)
    markers = ["CD34", "CD117", "CD45", "SSC_A"]
    z = rng.normal(0, 3, (200, 4))
    w = blast.marker_weights(markers)
    df = spark.createDataFrame(pd.DataFrame(z, columns=markers))
    got = np.array([r[0] for r in df.select(blast.linear_score({m: m for m in markers}, w)).collect()])
    weights = np.array([w[m] for m in markers])
    up = np.maximum(z - 0.5, 0) @ np.maximum(weights, 0)
    down = (np.maximum(-z - 0.5, 0) - np.maximum(z, 0)) @ np.maximum(-weights, 0)
    assert np.allclose(got, np.clip(np.maximum(up + down, 0) / np.abs(weights).sum() * 10, 0, 10))


def test_weight_priority():
    w = blast.marker_weights(["CD34-PE", "CD3-FITC", "HLA-DR", "XYZ"], custom={"CD34": 9.0}, panel={"CD34": 1.0, "HLA": 7.0})
    assert w == {"CD34-PE": 9.0, "CD3-FITC": -1.5, "HLA-DR": 7.0, "XYZ": 0.0}


def test_gate_threshold_bounds(spark):
    df = spark.createDataFrame([(0.5,), (0.93,), (1.0,)], "p double")
    got = [r[0] for r in df.select(blast.gate_threshold(F.col("p"))).collect()]
    assert np.allclose(got, [2.6, 2.6, 2.6 * 0.87])


def test_status_branches(spark):
    df = spark.createDataFrame([(1e-6, 1.0), (6e-5, 5.0), (1e-3, 2.0), (0.02, 1.0), (1e-3, 1.0)], "f double, fold double")
    got = [r[0] for r in df.select(stats.mrd_status("f", F.col("fold"))).collect()]
    assert got == ["MRD_NEGATIVE", "MRD_NEGATIVE", "MRD_POSITIVE", "MRD_INDETERMINATE", "MRD_NEGATIVE"]
    # with the limits swapped the branch between them is reached
    swapped = [r[0] for r in df.select(stats.mrd_status("f", F.col("fold"), lod=5e-5, loq=9e-5)).collect()]
    assert swapped[1] == "MRD_DETECTABLE_BELOW_LOQ"


# --- transforms, names --------------------------------------------------------


def test_logicle_reference_points(spark):
    df = spark.createDataFrame([(0.0,), (262144.0,), (-500.0,), (1000.0,)], "x double")
    y = [r[0] for r in df.select(transforms.logicle("x")).collect()]
    p = transforms.logicle_parameters(262144.0, 4.5, 0.5, 0.0)
    assert abs(y[0] - p["x1"]) < 1e-12 and abs(y[1] - 1.0) < 1e-9
    assert y[2] < y[0] < y[3] < y[1]


def test_transform_skips_scatter_and_unknown(spark):
    df = spark.createDataFrame([(10.0, 10.0)], "`FSC-A` double, CD3 double")
    row = transforms.transform_markers(df, ["FSC-A", "CD3"], "arcsinh").first()
    assert row["FSC-A"] == 10.0 and abs(row["CD3"] - np.arcsinh(2.0)) < 1e-12
    assert transforms.transform_columns(df, {"nope": {"method": "arcsinh"}}).first() == df.first()


def test_canonical_names(spark):
    cases = {"CD7+56 FITC-A": "CD7+56-A", "CD34 Cy55": "CD34", "FSC-A": "FSC-A", "CD13 BV421-H": "CD13-H", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert [r[0] for r in df.select(names.canonical_marker("n")).collect()] == list(cases.values())


def test_harmonize_prefers_exact_and_word_boundary(spark):
    targets = ["CD13", "CD34-A", "CD34"]
    cases = {"CD13 BV421": "CD13", "CD133 PE": None, "CD34 PE-A": "CD34-A", "CD34": "CD34", "CD34 PE": "CD34"}
    df = spark.createDataFrame([("s", k) for k in cases], "sample_id string, name string")
    got = {r["name"]: r["target"] for r in names.harmonize_channels(df, targets).collect()}
    assert got == {k: v for k, v in cases.items() if v}
    assert {r["conflict"] for r in names.harmonize_channels(df, targets).where("target = 'CD34'").collect()} == {True}


def test_file_dates(spark):
    cases = {"a_2024-03-15.fcs": "2024-03-15", "b 15.03.2024.fcs": "2024-03-15", "c_15_03_97.fcs": "1997-03-15",
             "d_15-03-24.fcs": "2024-03-15", "e20240315.fcs": "2024-03-15", "plain.fcs": None, "x_2024-13-45.fcs": None}
    df = spark.createDataFrame([(k,) for k in cases], "f string")
    got = [r[0] for r in df.select(F.date_format(names.file_date("f"), "yyyy-MM-dd")).collect()]
    assert got[:6] == list(cases.values())[:6]


# --- statistics, aggregates ----------------------------------------------------


def test_mann_whitney_small_case(spark):
    df = spark.createDataFrame([("p", float(v)) for v in (1, 2, 2, 5, 9)] + [("s", float(v)) for v in (2, 3, 4, 8)], "c string, value double")
    counted = stats.value_counts(df.withColumn("k", F.lit(1)), ["k"], F.col("c") == "p", F.col("c") == "s")
    row = stats.mann_whitney(counted, ["k"]).first()
    a, b = np.array([1, 2, 2, 5, 9.0]), np.array([2, 3, 4, 8.0])
    u = (a[:, None] > b[None]).sum() + 0.5 * (a[:, None] == b[None]).sum()
    assert row["u"] == u and 0 < row["p"] <= 1
    lone = stats.mann_whitney(stats.value_counts(df.where("c = 's' OR value = 9").withColumn("k", F.lit(1)), ["k"], F.col("c") == "p", F.col("c") == "s"), ["k"])
    assert lone.first()["u"] is None


def test_ks_equal_and_disjoint(spark):
    same = spark.createDataFrame([(c, float(v)) for c in "ps" for v in range(50)], "c string, value double").withColumn("k", F.lit(1))
    out = stats.kolmogorov_smirnov(stats.value_counts(same, ["k"], F.col("c") == "p", F.col("c") == "s"), ["k"]).first()
    assert out["d"] == 0 and out["p"] == 1.0
    apart = same.withColumn("value", F.when(F.col("c") == "p", F.col("value") + 100).otherwise(F.col("value")))
    out = stats.kolmogorov_smirnov(stats.value_counts(apart, ["k"], F.col("c") == "p", F.col("c") == "s"), ["k"]).first()
    assert out["d"] == 1 and out["p"] < 1e-6


def test_constant_marker_has_no_test_statistic(spark):
    df = spark.createDataFrame([(1, c, 5.0) for c in ["Sain"] * 9 + ["Pathologique"] * 7] + [(2, "Sain", 1.0)], "k int, condition string, m double")
    out = stats.compare_conditions(df, "k", ["m"]).collect()
    assert len(out) == 1 and out[0]["z"] is None and out[0]["p"] in (None, 1.0)
    assert out[0]["median_patho"] == 5.0 and out[0]["fold_change"] == 1.0
    assert agg.histogram(df, "m", 5.0, 5.0, 10).collect()[0]["n"] == 16
    assert agg.abundance(df, "condition", "k", [7], normalize=True).where("c7 = 0").count() == 2


def test_per_key_writer_splits_a_crowded_key(spark):
    import glob

    df = spark.range(1000).select(F.when(F.col("id") < 900, "big").otherwise("small").alias("k"), "id")
    path = scratch_path(spark, "per_key")
    sinks.write_per_key(df, path, "k", "parquet", rows_per_file=100)
    assert spark.read.parquet(path).count() == 1000
    assert len(glob.glob(f"{path}/k=big/*.parquet")) > 1 and len(glob.glob(f"{path}/k=small/*.parquet")) == 1


def test_cohort_tables(spark):
    df = spark.createDataFrame(
        [("a", 1, 1.0, 2.0), ("a", 1, 3.0, 4.0), ("a", 2, 5.0, 6.0), ("b", 1, 7.0, 8.0), ("b", 2, 9.0, 1.0), ("b", 2, 2.0, 3.0)],
        "sample_id string, cluster int, CD34 double, CD38 double")
    got = {r["cluster"]: (r["CD34"], r["CD38"]) for r in agg.mfi(df, ["cluster"], ["CD34", "CD38"]).collect()}
    assert got == {1: (3.0, 4.0), 2: (5.0, 3.0)}
    share = {r["sample_id"]: (r["c1"], r["c2"]) for r in agg.abundance(df, "sample_id", "cluster", [1, 2], normalize=True).collect()}
    assert np.allclose(share["a"], (2 / 3, 1 / 3)) and np.allclose(share["b"], (1 / 3, 2 / 3))


def test_strict_stack_raises(spark):
    a, b = spark.createDataFrame([(1.0,)], "x double"), spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    with pytest.raises(ValueError):
        cohort.stack([a, b], strict=True)
    assert cohort.stack([a, b]).where("y = 0").count() == 1
    assert cohort.common_columns([a, b]).columns == ["x"]


def test_drift_is_flagged(spark):
    rng = np.random.default_rng(42)
    data = rng.normal(100, 5, (5000, 3))
    data[2000:2500] *= 5
    frame = pd.DataFrame(data, columns=["d2", "d3", "d4"]).assign(id=np.arange(5000), t=np.linspace(0, 1000, 5000), s="x")
    marked = qc.quality_masks(spark.createDataFrame(frame), "s", ["t", "id"], ["d2", "d3", "d4"])
    assert marked.where("id BETWEEN 2000 AND 2499 AND qc_time").count() == 0
    assert marked.where("(id < 1990 OR id > 2510) AND NOT qc_time").count() == 0
    assert qc.quality_report(marked, "s").first()["frac_pass"] > 0.8


# --- models --------------------------------------------------------------------


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(42)
    x = np.concatenate([rng.normal(c, 0.3, (600, 7)) for c in (0, 3, 6)])
    df = spark.createDataFrame([(i, i // 600, [float(v) for v in r]) for i, r in enumerate(x)], "event_id long, truth int, x array<double>")
    return x, df


def test_som_separates_blobs_and_repeats(spark, blobs):
    x, df = blobs
    model = som.fit_som(df, xdim=5, ydim=5, epochs=8)
    again = som.fit_som(df.repartition(3), xdim=5, ydim=5, epochs=8)
    assert np.allclose(model.codes[None], again.codes[None], atol=1e-8)
    labels = metacluster.metacluster(model.codebook(spark), 3)
    model.metaclusters[None] = [r["metacluster"] for r in labels.orderBy("node_id").collect()]
    out = model.transform(df)
    assert out.groupBy("truth").agg(F.count_distinct("metacluster").alias("n")).where("n <> 1").count() == 0
    assert out.select("metacluster").distinct().count() == 3
    assert out.agg(F.avg("distance")).first()[0] < 1.0


def test_som_per_key_equals_single_maps(spark, blobs):
    _, df = blobs
    both = som.fit_som(df, model="truth", xdim=3, ydim=3, epochs=4)
    for t in (0, 2):
        one = som.fit_som(df.where(F.col("truth") == t), xdim=3, ydim=3, epochs=4)
        assert np.allclose(both.codes[t], one.codes[None], atol=1e-8)


def test_som_of_many_models_trains_in_groups(spark, blobs):
    _, df = blobs
    whole = som.fit_som(df, model="truth", xdim=2, ydim=2, epochs=3)
    parts = som.fit_som(df, model="truth", xdim=2, ydim=2, epochs=3, shipped_numbers=60)
    for t in range(3):
        assert np.allclose(whole.codes[t], parts.codes[t], atol=1e-8)
    a = sorted(map(tuple, whole.transform(df).select("event_id", "node_id").collect()))
    b = sorted(map(tuple, parts.transform(df).select("event_id", "node_id").collect()))
    assert a == b and len(a) == 1800
    strange = df.withColumn("truth", F.when(F.col("event_id") < 5, 99).when(F.col("event_id") > 5, F.col("truth")))
    for model in (whole, parts):
        out = model.transform(strange)
        assert out.count() == 1800 and out.where("node_id IS NULL").count() == 6


def test_som_heuristics():
    assert som.epochs_for(100) == 10 and som.epochs_for(10**8) == 100 and som.epochs_for(250_000) == 50
    assert som.grid_for(49_999, 10, 10) == (7, 7) and som.grid_for(50_000, 10, 10) == (10, 10) and som.grid_for(100, 5, 5) == (5, 5)


def test_ward_and_consensus_find_groups(spark):
    rng = np.random.default_rng(0)
    codes = np.concatenate([rng.normal(c, 0.1, (10, 2)) for c in (0, 5, 10)])
    book = spark.createDataFrame([("m", i, [float(v) for v in c]) for i, c in enumerate(codes)], "model_id string, node_id long, code array<double>")
    for out in (metacluster.metacluster(book, 3), metacluster.consensus_metacluster(book, 3, 20)):
        got = [r["metacluster"] for r in out.orderBy("node_id").collect()]
        assert got == [0] * 10 + [1] * 10 + [2] * 10
    tree = metacluster.spanning_tree(book)
    assert tree.count() == 29
    hops = metacluster.tree_hops(tree, 30)
    assert hops.count() == 900 and hops.where("src = dst AND hops <> 0").count() == 0


def test_rand_index_and_silhouette():
    assert metacluster.adjusted_rand(np.diag([5, 7])) == 1.0
    assert abs(metacluster.adjusted_rand(np.array([[5, 5], [5, 5]]))) < 0.12
    pts = np.array([[0, 0], [0, 1], [9, 9], [9, 8.0]])
    assert metacluster.silhouette(pts, np.array([0, 0, 1, 1])) > 0.85


def test_choose_k_follows_the_composite_score(spark, blobs):
    _, df = blobs
    codes = som.fit_som(df, xdim=4, ydim=4, epochs=5).codes[None]
    best, scores = metacluster.choose_k(df, codes, range(2, 7), xdim=4, ydim=4, bootstraps=3, epochs=5)
    assert len(scores) == 5
    stable = {k: (sil, st) for k, sil, st, _ in scores if st is not None and st >= metacluster.MIN_STABILITY}
    assert stable[3][1] > 0.99
    low, high = min(v[0] for v in stable.values()), max(v[0] for v in stable.values())
    span = high - low if high > low else 1.0
    want = {k: 0.65 * st + 0.35 * (sil - low) / span for k, (sil, st) in stable.items()}
    assert best == max(want, key=want.get)


def test_unmixing_recovers_and_stays_positive(spark):
    rng = np.random.default_rng(42)
    peaks = np.exp(-0.5 * ((np.arange(8)[None] - np.array([1, 3, 5, 7])[:, None]) / 1.2) ** 2)
    spectra = peaks / np.linalg.norm(peaks, axis=1, keepdims=True)
    truth = rng.exponential(100, (300, 4)) * (rng.random((300, 4)) > 0.4)
    y = truth @ spectra + rng.normal(0, 0.5, (300, 8))
    names_ = [f"d{i}" for i in range(8)]
    df = spark.createDataFrame(pd.DataFrame(y, columns=names_).assign(id=np.arange(300)))
    out = unmix.non_negative(df, names_, spectra, list("abcd")).orderBy("id").toPandas()
    assert (out[list("abcd")].to_numpy() >= 0).all()
    assert np.abs(out[list("abcd")].to_numpy() - truth).max() < 5
    # optimality: no gradient step inside the bounds can lower the residual
    x = out[list("abcd")].to_numpy()
    grad = (x @ spectra - y) @ spectra.T
    assert (grad > -1e-5).all() and (np.abs(grad[x > 1e-6]) < 1e-5).all()


def test_batch_correction_shrinks_shift(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, (1500, 2)), rng.normal(0, 1, (1500, 2)) + [1.5, 0]
    df = spark.createDataFrame(pd.DataFrame(np.vstack([a, b]), columns=["u", "v"]).assign(batch=["A"] * 1500 + ["B"] * 1500))
    fixed = embed.correct_batches(df, ["u", "v"], "batch", clusters=4)
    gap = fixed.groupBy("batch").agg(F.avg("u").alias("m")).toPandas()["m"]
    assert abs(gap[0] - gap[1]) < 0.75
    assert embed.correct_batches(df, [], "batch") is df
    assert embed.correct_batches(df.where("batch = 'A'"), ["u"], "batch").columns == df.columns


def test_robust_covariance_ignores_outliers(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (2000, 2)), rng.normal(40, 1, (100, 2))])
    center, cov = robust_covariance(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])), ["a", "b"])
    assert np.abs(center).max() < 0.2 and np.diag(cov).max() < 2


def test_otsu_matches_direct_scan(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(1, 0.2, 300), rng.normal(4, 0.5, 200)])
    got = mapping.otsu_threshold(spark.createDataFrame(pd.DataFrame({"g": 1, "d": v})), ["g"], "d").first()["threshold"]
    counts, edges = np.histogram(v, 64)
    mid = (edges[1:] + edges[:-1]) / 2
    best, at = -1.0, None
    for i in range(63):
        if counts[i] == 0:
            continue
        w = counts[:i + 1].sum() / counts.sum()
        var = w * (1 - w) * (np.average(mid[:i + 1], weights=counts[:i + 1]) - np.average(mid[i + 1:], weights=counts[i + 1:])) ** 2
        if var > best + 1e-12:
            best, at = var, mid[i]
    assert abs(got - at) < 1e-9


# --- files ----------------------------------------------------------------------


def test_fcs_round_trip_bad_files_and_split(spark):
    folder = scratch_path(spark, "fcs_test")
    df = spark.createDataFrame(
        [("s1", 1.5, float("nan")), ("s1", float("inf"), 2.0), ("s2", -3.0, float("-inf"))], "file string, `CD/3` double, B double")
    report = fcs.write_fcs(df, folder, "file")
    assert report.agg(F.sum("n_events")).first()[0] == 3
    with open(f"{folder}/broken.fcs", "wb") as out:
        out.write(b"not a cytometry file")
    whole = fcs.encode(["B"], np.ones((50, 1)))
    with open(f"{folder}/short.fcs", "wb") as out:
        out.write(whole[:-20])
    events, errors = fcs.read_events(spark, folder)
    got = sorted((r["sample_id"], r["CD/3"], r["B"]) for r in events.collect())
    assert got == [("s1.fcs", 1.5, 0.0), ("s1.fcs", 1e6, 2.0), ("s2.fcs", -3.0, 0.0)]
    assert sorted(r["sample_id"] for r in errors.collect()) == ["broken.fcs", "short.fcs"]
    many = spark.range(100).select(F.lit("big").alias("file"), F.col("id").cast("double").alias("v"))
    parts = fcs.write_fcs(many, scratch_path(spark, "fcs_parts"), "file", rows_per_file=20).collect()
    assert len(parts) > 1 and sum(r["n_events"] for r in parts) == 100


def test_fcs_integer_data():
    head = {"$DATATYPE": "I", "$BYTEORD": "4,3,2,1", "$PAR": "2", "$TOT": "2", "$P1N": "A", "$P2N": "B", "$P1B": "16", "$P2B": "32",
            "$P1R": "1024", "$P2R": "262144", "$MODE": "L"}
    body = np.array([(1023, 70000), (2048 + 5, 1)], dtype=np.dtype([("a", ">u2"), ("b", ">u4")])).tobytes()
    text = ("|" + "|".join(f"{k}|{v}" for k, v in head.items()) + "|").encode()
    start = 58
    begin = start + len(text)
    blob = ("FCS3.0    " + "".join(f"{v:>8d}" for v in (start, begin - 1, begin, begin + len(body) - 1, 0, 0))).encode() + text + body
    names_, data = fcs.parse_events(blob)
    assert names_ == ["A", "B"] and data.tolist() == [[1023.0, 70000.0], [5.0, 1.0]]


def test_cluster_export_report(spark):
    df = spark.createDataFrame([(-1, 1.0)] * 20 + [(1, 2.0)] * 12 + [(2, 3.0)] * 3, "cluster int, v double")
    path = scratch_path(spark, "cluster_test")
    got = {r["cluster"]: r["status"] for r in sinks.cluster_export(df, path, "cluster", 10).collect()}
    assert got == {-1: "noise", 1: "exported", 2: "too_small"}
    assert spark.read.parquet(path).count() == 12


def test_non_negative_unmixing_is_optimal():
    """Against all sets of positive sources; the conditions of optimality hold for every row."""
    from itertools import combinations

    rng = np.random.default_rng(12)
    spectra = np.abs(rng.normal(size=(4, 6)))
    spectra[3] = spectra[2] + 0.01 * rng.normal(size=6)  # nearly the same source twice
    y = rng.normal(size=(400, 6)) * 10
    y[:5] = 0.0
    got = unmix._non_negative(y, spectra)
    slope = got @ (spectra @ spectra.T) - y @ spectra.T
    assert (got >= 0).all() and (slope > -1e-5).all() and np.abs(got * slope).max() < 1e-4
    best = np.full(len(y), np.inf)
    for size in range(5):
        for on in combinations(range(4), size):
            x = np.zeros((len(y), 4))
            if on:
                x[:, on] = np.linalg.lstsq(spectra[list(on)].T, y.T, rcond=None)[0].T
            ok = (x >= -1e-12).all(axis=1)
            best = np.where(ok, np.minimum(best, ((y - x @ spectra) ** 2).sum(axis=1)), best)
    assert np.allclose(((y - got @ spectra) ** 2).sum(axis=1), best, rtol=1e-7, atol=1e-7)
    assert (np.linalg.lstsq(spectra.T, y.T, rcond=None)[0] < 0).any(axis=0).sum() > 100


def test_a_repeated_batch_counts_once(spark, monkeypatch):
    """The job dies after a batch stored its counts and before its flags; a restart repeats the batch."""
    from marrowgrid.streaming import jobs

    rng = np.random.default_rng(2)
    rows = [(int(i % 3), "Sain" if i % 2 else "Pathologique", [float(v) for v in rng.normal(size=2) + (i % 4)]) for i in range(600)]
    events = spark.createDataFrame(rows, "patient_id long, condition string, x array<double>")
    folder, path, ck = (scratch_path(spark, n) for n in ("arrive", "scores", "scores_ck"))
    events.repartition(4).write.parquet(folder)
    codes = np.array([[0.0, 0.0], [1.5, 1.5], [3.0, 3.0]])
    stream = lambda: jobs.open_files(spark, folder, events.schema, "*.parquet", per_trigger=1)
    plain, calls = jobs._running, []

    def dying(session, root, number, keys):
        calls.append(number)
        if number == 2 and calls.count(2) == 1:
            raise RuntimeError("killed")
        return plain(session, root, number, keys)

    monkeypatch.setattr(jobs, "_running", dying)
    with pytest.raises(Exception, match="killed"):
        jobs.score_on_map(stream(), codes, path, ck)
    jobs.score_on_map(stream(), codes, path, ck)
    assert calls.count(2) == 2
    monkeypatch.setattr(jobs, "SNAPSHOT_EVERY", 2)
    got = sorted((r.patient_id, r.node_id, r.n_total, r.n_sain, r.n_patho, r.is_mrd_eln) for r in jobs.scored_nodes(spark, path).collect())
    x = np.array([r[2] for r in rows])
    node = ((x[:, None] - codes[None]) ** 2).sum(axis=2).argmin(axis=1)
    frame = spark.createDataFrame([(r[0], r[1], int(n)) for r, n in zip(rows, node)], "patient_id long, condition string, node_id long")
    want = mrd.flag_nodes(mrd.node_shares(mrd.node_counts(frame)))
    assert got == sorted((r.patient_id, r.node_id, r.n_total, r.n_sain, r.n_patho, r.is_mrd_eln) for r in want.collect())


def test_snapshots_stand_for_earlier_batches(spark, monkeypatch):
    from marrowgrid.streaming import jobs

    monkeypatch.setattr(jobs, "SNAPSHOT_EVERY", 2)
    rows = [(1, "Sain", [float(i)]) for i in range(40)] + [(2, "Pathologique", [float(i)]) for i in range(40)]
    events = spark.createDataFrame(rows, "patient_id long, condition string, x array<double>")
    folder, path = scratch_path(spark, "many"), scratch_path(spark, "many_scores")
    events.repartition(6).write.parquet(folder)
    jobs.score_on_map(jobs.open_files(spark, folder, events.schema, "*.parquet", per_trigger=1), np.array([[0.0], [30.0]]), path, scratch_path(spark, "many_ck"))
    assert spark.read.parquet(f"{path}/snapshots").select("snapshot").distinct().count() >= 2
    got = sorted((r.patient_id, r.node_id, r.n_total) for r in jobs.scored_nodes(spark, path).collect())
    assert got == [(1, 0, 16), (1, 1, 24), (2, 0, 16), (2, 1, 24)]
