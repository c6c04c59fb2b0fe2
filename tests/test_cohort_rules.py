"""Rules of the patient runs, the tests' tails and the stored windows, on small fixtures."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marrowgrid.functions import blast
from marrowgrid.operators import graph, mapping, stats
from marrowgrid.operators.cohort import pool_per_patient
from marrowgrid.operators.gating import standard_masks
from marrowgrid.operators.selection import hash_order, smallest, weighted_take
from marrowgrid.plans import cohort_run as run
from marrowgrid.sources import readers
from marrowgrid.sources.tables import cells
from marrowgrid.streaming import jobs


def cohort(spark, patients, pool):
    rows = [(f"p{p}-{i}", p, "ill", "Pathologique") for p, n in patients.items() for i in range(n)]
    rows += [(f"{f}-{i}", -1, f, "Sain") for f, n in pool.items() for i in range(n)]
    events = spark.createDataFrame(rows, "event_id string, patient_id int, file_origin string, condition string")
    return events.where("condition <> 'Sain'"), events.where("condition = 'Sain'")


def test_large_patient_gets_the_whole_uneven_pool(spark):
    ill, pool = cohort(spark, {1: 60, 2: 10, 3: 1}, {"a": 90, "b": 7})
    out = pool_per_patient(ill, pool, hash_order("event_id"))
    got = {(r["patient_id"], r["file_origin"]): r["count"] for r in out.groupBy("patient_id", "file_origin").count().collect()}
    # 2 x 60 rows reach the pool of 97; 2 x 10 over two files are 10 each, of which b has 7
    assert got == {(1, "a"): 90, (1, "b"): 7, (2, "a"): 10, (2, "b"): 7, (3, "a"): 1, (3, "b"): 1}
    assert out.count() == out.select("patient_id", "event_id").distinct().count()


def test_empty_pool_and_no_patients(spark):
    ill, pool = cohort(spark, {1: 5}, {"a": 4})
    assert pool_per_patient(ill, pool.limit(0), hash_order("event_id")).count() == 0
    assert pool_per_patient(ill.limit(0), pool, hash_order("event_id")).count() == 0


def test_a_patient_does_not_depend_on_the_others(spark, sf_dir):
    settings = run.Settings(("CD45", "CD34", "HLA_DR"), xdim=3, ydim=3, epochs=3, metaclusters=3)
    # other patients lie far away, which moves any scale they share
    shifted = F.when((F.col("patient_id") != 3) & (F.col("condition") != "Sain"), F.col("CD45") * 50).otherwise(F.col("CD45"))
    events = cells(spark, sf_dir).drop("node_id", "metacluster").withColumn("CD45", shifted)
    alone = events.where("condition = 'Sain' OR patient_id = 3")
    _, all_ = run.patient_runs(events, settings, hash_order("event_id"))
    _, one = run.patient_runs(alone, settings, hash_order("event_id"))
    together = all_.where("patient_id = 3").first().asDict()
    assert together == pytest.approx(one.where("patient_id = 3").first().asDict())


def test_ranks_agree_on_both_paths(spark, sf_dir):
    events = cells(spark, sf_dir).select("event_id", "file_origin")
    kw = dict(ties=["event_id"], rank="at")
    small = smallest(events, ["file_origin"], 120, hash_order("event_id"), **kw)
    large = smallest(events, ["file_origin"], 120, hash_order("event_id"), group_rows=50, **kw)
    assert small.exceptAll(large).count() == 0 and large.exceptAll(small).count() == 0
    assert large.agg(F.max("at")).first()[0] == 120


def test_weighted_take_deals_ties_to_the_count(spark):
    df = spark.range(40).withColumn("w", F.lit(1.0))
    same = F.md5((F.col("id") % 2).cast("string"))  # twenty rows share each arrival time
    assert weighted_take(df, 7, F.col("w"), same).count() == 7


def test_cd34_gate_leaves_the_normal_side_whole(spark, sf_dir):
    events = cells(spark, sf_dir)
    plain, ill_only = standard_masks(events), standard_masks(events, cd34_of="Pathologique")
    assert events.where("condition = 'Sain'").where(~ill_only["cd34"]).count() == 0
    ill = events.where("condition = 'Pathologique'")
    assert ill.where(plain["cd34"]).count() == ill.where(ill_only["cd34"]).count()


def test_linear_prior_and_far_votes(spark):
    nodes = spark.createDataFrame([(n, m, float(n + 1) * k) for n in range(3) for k, m in enumerate("ab", 1)], "node_id int, marker string, v double")
    pops = spark.createDataFrame(
        [(p, m, c, float(v), 1.0) for p, c, v in (("x", 30, 1), ("y", 10, 3)) for m in "ab"],
        "population string, marker string, n_cells long, v double, var double")
    sizes = spark.createDataFrame([(n, 1) for n in range(3)], "node_id int, size long")
    votes = spark.createDataFrame([(n, "y", 9.0) for n in range(3)], "node_id int, population string, dist double")
    best = mapping.best_population(mapping.all_metrics(nodes, pops, sizes, votes=votes), ["method", "node_id"])
    assert {(r["best_pop"], r["best_dist"]) for r in best.where("method = 'M11'").collect()} == {("y", 9.0)}
    both = spark.createDataFrame([(0, "x", 30, 1, 6.0), (0, "y", 10, 1, 6.0)], "node_id int, population string, n_cells long, size long, d double")
    weighed = both.withColumn("w", mapping.with_prior(F.col("d"), "linear", factor=1e9))
    assert {r["population"]: r["w"] for r in weighed.collect()} == {"x": 4.0, "y": 12.0}


def test_student_tail_against_known_values(spark):
    rows = [(0.0, 5.0), (12.706204736, 1.0), (2.570581836, 5.0), (1.971956544, 199.0), (2.0, 2.0), (None, 3.0)]
    got = spark.createDataFrame(rows, "t double, df double").select("t", stats.student_two_sided("t", "df").alias("p")).collect()
    want = [1.0, 0.05, 0.05, 0.05, 1 - 2 / np.sqrt(6), None]
    for row, p in zip(got, want):
        assert row["p"] == (pytest.approx(p, abs=1e-7) if p is not None else None)


def test_spearman_of_short_flat_and_perfect_features(spark):
    rows = [("two", 1, 1), ("two", 2, 2), ("flat", 1, 5), ("flat", 2, 5), ("flat", 3, 5)] + [("line", i, i * i) for i in range(5)]
    got = {r["f"]: r for r in stats.spearman(spark.createDataFrame(rows, "f string, x int, y int"), ["f"], "x", "y").collect()}
    assert got["two"]["p"] is None and got["flat"]["p"] is None
    assert got["line"]["rho"] == pytest.approx(1.0) and got["line"]["p"] == pytest.approx(0.0, abs=1e-6)


def test_pool_version_follows_size_settings_and_code(spark):
    files = pd.DataFrame({"path": ["a", "b"], "length": [10, 20], "modificationTime": ["t1", "t2"]})
    base = readers.pool_version(spark.createDataFrame(files), {"c": 5})
    assert base == readers.pool_version(spark.createDataFrame(files[::-1]), {"c": 5})
    again = files.assign(length=[10, 21])
    assert base != readers.pool_version(spark.createDataFrame(again), {"c": 5})
    assert base != readers.pool_version(spark.createDataFrame(files), {"c": 6})
    assert base != readers.pool_version(spark.createDataFrame(files), {"c": 5}, code="other")


def test_open_windows_are_stored_and_updated(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp, sample_id string, signal double"
    at = dt.datetime(2026, 1, 1)

    def arrive(minutes):
        rows = [(at + dt.timedelta(minutes=m), "s", float(m)) for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    read = spark.createDataFrame([], schema).schema
    for minutes in ([0, 10, 70], [75, 80]):
        arrive(minutes)
        windows = jobs.drift(jobs.open_files(spark, folder, read, "*.parquet"), "ts", "sample_id", "signal")
        jobs.run_updates(windows, out, str(tmp_path / "ck"))
    got = {r["start"].hour: (r["n"], r["median"]) for r in jobs.latest(spark.read.parquet(out), ["start", "sample_id"]).collect()}
    assert got == {0: (2, 0.0), 1: (3, 75.0)}


def test_score_router_asks_for_what_a_method_needs(spark):
    row = spark.createDataFrame([(2.0, 1.0)], "z double, v double")
    score, d2 = blast.node_score("mahalanobis", values=["v"], center=[0.0], inverse=[[4.0]], norm=20.0)
    assert row.select(score.alias("s"), d2.alias("d")).first() == (2.0, 4.0)
    assert row.select(blast.node_score("none")[0]).first()[0] == 10.0
    assert row.select(blast.node_score("linear", z={"CD34": "z"})[0]).first()[0] == 10.0
    for method, given in (("linear", {}), ("hybrid", {"z": {"CD34": "z"}}), ("mahalanobis", {"values": ["v"], "center": [0.0]}), ("other", {})):
        with pytest.raises(ValueError):
            blast.node_score(method, **given)


def test_communities_settle_and_are_numbered_by_size(spark):
    pairs = [(a, b) for group in ([0, 1, 2, 3], [10, 11, 12]) for a in group for b in group if a != b]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 10, 11, 12, 20)], "query_id long")
    got = {r["query_id"]: r["community"] for r in graph.propagate_labels(nodes, edges).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 10: 1, 11: 1, 12: 1, 20: 2}


def test_summary_from_equal_rows_equals_that_of_the_labelled_events(spark, sf_dir):
    """Rows four times over; quotas of the patients differ, one lacks normal rows of its own."""
    from marrowgrid.operators import mrd

    settings = run.Settings(("CD45", "CD34", "HLA_DR"), xdim=3, ydim=3, epochs=3, metaclusters=3)
    few = cells(spark, sf_dir).drop("node_id", "metacluster").where("patient_id < 4 AND (patient_id <> 2 OR condition = 'Pathologique')")
    events = few.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("patient_id") == 1, 7).otherwise(3)))) \
        .withColumn("event_id", F.concat_ws("-", "event_id", "copy")).drop("copy")
    labelled, summary = run.patient_runs(events, settings, hash_order("event_id"), ratio=0.5)
    assert "metacluster" in labelled.columns and labelled.where("node_id IS NULL").isEmpty()
    assert sorted(summary.collect()) == sorted(mrd.mrd_summary(labelled).select(*summary.columns).collect())


def test_counts_of_the_combined_run_equal_its_cells(spark, sf_dir):
    settings = run.Settings(("CD45", "CD34", "HLA_DR"), xdim=3, ydim=3, epochs=3, metaclusters=3, min_cells=1)
    tables = run.combined_run(cells(spark, sf_dir), settings, hash_order("event_id"))
    held = tables["cells"]
    assert sorted(tables["conditions"].collect()) == sorted(held.groupBy("metacluster", "condition").agg(F.count("*").alias("n")).collect())
    assert sorted(tables["counts"].collect()) == sorted(held.groupBy("node_id").agg(F.count("*").alias("n")).collect())
    assert tables["mfi"].count() == held.select("metacluster").distinct().count()


@pytest.mark.parametrize("even", [True, False])
def test_first_rows_of_large_groups_under_a_bound(spark, even):
    """Also where hashes of a group are not spread, and with a group without name."""
    df = spark.range(12_000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 100 == 1, "b").alias("g"))
    order = hash_order("id") if even else F.concat(F.lit("f"), hash_order("id"))
    want = {}
    for r in df.withColumn("h", order).orderBy("h").collect():
        want.setdefault(r.g, []).append(r.id)
    got = smallest(df, ["g"], 20, order, ties=["id"]).collect()
    assert sorted((str(r.g), r.id) for r in got) == sorted((str(g), i) for g, ids in want.items() for i in ids[:20])


def test_groups_within_their_quota_are_not_ranked(spark):
    df = spark.range(3_000).select("id", F.when(F.col("id") < 400, "large").when(F.col("id") % 7 > 0, (F.col("id") % 60).cast("string")).alias("g"))
    sizes = df.groupBy("g").agg(F.count("*").alias("_size"))
    order = hash_order("id")
    got = smallest(df, ["g"], 380, order, sizes=sizes)
    assert sorted(got.collect(), key=str) == sorted(smallest(df, ["g"], 380, order).collect(), key=str)
