"""The paths taken beyond the size checks give the results of the small ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marrowgrid.operators import qc, stats
from marrowgrid.operators.neighbors import knn
from marrowgrid.operators.quantiles import quantiles
from marrowgrid.operators.selection import hash_order, smallest, take, weighted_take
from marrowgrid.operators.sizing import as_model, model_rows
from marrowgrid.sources.tables import acquisition, cells


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("by", [[], ["condition"], ["patient_id", "condition"]])
def test_narrowed_quantiles_are_exact(spark, sf_dir, by):
    events = cells(spark, sf_dir)
    specs = {"a": ("FSC_A", 0.02), "b": ("CD45", 0.5), "c": ("HLA_DR", 0.985)}
    small = quantiles(events, by, specs).toPandas()
    large = quantiles(events, by, specs, group_rows=40).toPandas()
    if by:
        small, large = (t.sort_values(by).reset_index(drop=True)[small.columns] for t in (small, large))
    pd.testing.assert_frame_equal(small, large, rtol=1e-12)


def test_narrowed_quantiles_with_outliers_nulls_and_ties(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=3000), [1e300, -1e300], np.full(2000, 0.25)])
    frame = pd.DataFrame({"g": ["a"] * len(values), "v": values})
    df = spark.createDataFrame(frame).unionByName(
        spark.sql("SELECT 'b' AS g, CAST(NULL AS DOUBLE) AS v UNION ALL SELECT 'a', CAST('NaN' AS DOUBLE)"))
    probs = (0.0, 0.1, 0.5, 0.73, 1.0)
    out = {r["g"]: r for r in quantiles(df, ["g"], {f"q{i}": ("v", p) for i, p in enumerate(probs)}, group_rows=10).collect()}
    assert np.allclose([out["a"][f"q{i}"] for i in range(5)], np.quantile(values, probs), rtol=1e-12)
    assert out["b"]["q2"] is None


@pytest.mark.parametrize("by,quota", [([], 321), ([], 1500), (["condition"], 100), (["file_origin"], 40)])
def test_selection_paths_agree(spark, sf_dir, by, quota):
    events = cells(spark, sf_dir).select("event_id", "condition", "file_origin")
    order = hash_order("event_id")
    plain = smallest(events, by, quota, order)
    cut = smallest(events, by, quota, order, group_rows=1)
    assert rows(plain) == rows(cut)
    want = events.groupBy(*by).count().agg(F.sum(F.least("count", F.lit(quota)))).first()[0]
    assert cut.count() == want


def test_selection_does_not_depend_on_partitions(spark, sf_dir):
    events = cells(spark, sf_dir).select("event_id")
    order = hash_order("event_id")
    assert rows(take(events.repartition(1), 500, order)) == rows(take(events.repartition(7), 500, order))


def test_weighted_sample_prefers_heavy_rows(spark, sf_dir):
    events = cells(spark, sf_dir).select("event_id", "SSC_A")
    part = weighted_take(events, 600, F.col("SSC_A") * F.col("SSC_A"), hash_order("event_id"))
    assert part.count() == 600
    assert part.agg(F.avg("SSC_A")).first()[0] > events.agg(F.avg("SSC_A")).first()[0] + 5


def test_equal_count_bins_paths_agree(spark, sf_dir):
    acq = acquisition(spark, sf_dir).select("event_id", "sample_id", "time")
    order = ["time", "event_id"]
    assert rows(qc.equal_count_bins(acq, "sample_id", order, 20)) == rows(qc.equal_count_bins(acq, "sample_id", order, 20, group_rows=30))


def test_equal_count_bins_with_one_crowded_instant(spark):
    df = spark.range(1000).select("id", F.lit("s").alias("s"), F.when(F.col("id") < 700, 5.0).otherwise(F.col("id") / 1.0).alias("t"))
    a = qc.equal_count_bins(df, "s", ["t", "id"], 13)
    b = qc.equal_count_bins(df, "s", ["t", "id"], 13, group_rows=50)
    assert rows(a) == rows(b)


def test_value_counts_paths_agree(spark, sf_dir):
    long = stats.to_long(cells(spark, sf_dir), ["metacluster", "condition"], ["CD45", "HLA_DR"])
    sides = (F.col("condition") == "Sain", F.col("condition") != "Sain")
    by = ["metacluster", "marker"]
    a = stats.value_counts(long, by, *sides)
    b = stats.value_counts(long, by, *sides, group_rows=20).select(*a.columns)
    assert rows(a) == rows(b)


def brute(ids, x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return {int(ids[i]): np.sort(d[i])[:k] for i in range(len(x))}


@pytest.mark.parametrize("copies", [0, 250])
def test_neighbours_by_cells_equal_brute_force(spark, copies):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.4, size=(120, 3)) for c in (0, 2, 5)] + [np.tile([[1.0, 1.0, 1.0]], (copies, 1))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    found = knn(df, df.withColumnRenamed("id", "base_id"), 6, query_id="id", shipped_numbers=60, block_rows=32).toPandas()
    want = brute(np.arange(len(x)), x, 6)
    assert len(found) == 6 * len(x)
    assert (found["id"] != found["base_id"]).all()
    for i, part in found.groupby("id"):
        assert np.allclose(np.sort(part["distance"]), want[i], atol=1e-9)


@pytest.mark.parametrize("share", [0.0, 2.0])
def test_neighbours_in_small_tiles(spark, monkeypatch, share):
    """Cells and blocks cut to a few rows, ties and copies at the last place: the smaller id wins, as in an ORDER BY."""
    from marrowgrid.operators import neighbors as nb

    for name, value in (("TILE_NUMBERS", 60), ("TILE_PAIRS", 200), ("PIECE_QUERIES", 7), ("PIECE_ROWS", 11), ("PIECE_NUMBERS", 30)):
        monkeypatch.setattr(nb, name, value)
    x = np.random.default_rng(9).integers(0, 4, (150, 2)).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = sorted((i, k + 1, int(j)) for i in range(150) for k, j in enumerate(np.lexsort((np.arange(150), d[i]))[:4]))
    for shipped in (10, 10 ** 6):
        found = knn(df, df.withColumnRenamed("id", "base_id"), 4, query_id="id", shipped_numbers=shipped, block_rows=8, cell_share=share)
        assert sorted((r["id"], r["rank"], r["base_id"]) for r in found.collect()) == want


def test_nothing_beyond_the_bound_is_looked_at():
    from marrowgrid.operators import neighbors as nb

    rng = np.random.default_rng(2)
    q, b = rng.normal(size=(40, 3)), rng.normal(size=(500, 3))
    d = np.sqrt(((q[:, None] - b[None]) ** 2).sum(axis=2))
    limit = np.sort(d, axis=1)[:, 2]
    who, where, far = nb._top(np.arange(40), q, np.arange(500), b, 5, False, limit)
    assert sorted(zip(who, where)) == [(i, j) for i in range(40) for j in sorted(np.argsort(d[i])[:3])]
    assert np.allclose(far, d[who, where], atol=0, rtol=1e-12)


@pytest.mark.parametrize("copies", [0, 60])
def test_neighbours_by_rounds_equal_brute_force(spark, copies):
    """Thirty dimensions: cells would visit nearly everything, so the rounds are taken by themselves."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(700, 30)), np.ones((copies, 30))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    found = knn(df, df.withColumnRenamed("id", "base_id"), 6, query_id="id", shipped_numbers=900, block_rows=90).toPandas()
    want = brute(np.arange(len(x)), x, 6)
    assert len(found) == 6 * len(x) and (found["id"] != found["base_id"]).all()
    for i, part in found.groupby("id"):
        assert np.allclose(np.sort(part["distance"]), want[i], atol=1e-6)


def test_rounds_keep_one_state_per_query(spark):
    """No round leaves more than k candidates a query, and empty blocks do no harm."""
    from marrowgrid.operators.neighbors import by_rounds

    rng = np.random.default_rng(9)
    base = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=5)]) for i in range(200)], "b long, v array<double>")
    asked = base.where("b < 3").select(F.col("b").alias("q"), "v")
    out = by_rounds(asked, base, 4, True, 200, 5, block=30)
    assert rows(out.groupBy("q").count()) == [(0, 4), (1, 4), (2, 4)]


def test_index_recall_grows_with_probes(spark):
    from marrowgrid.operators.neighbors import knn_indexed, recall

    rng = np.random.default_rng(4)
    centres = rng.normal(scale=4, size=(20, 30))
    x = np.concatenate([rng.normal(c, 1.0, size=(60, 30)) for c in centres])
    base = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "base_id long, x array<double>")
    asked = base.where("base_id % 100 = 0").withColumnRenamed("base_id", "query_id")
    exact = knn(asked, base, 10)
    reached = [recall(knn_indexed(asked, base, 10, probes=p, lists=30), exact).first() for p in (1, 8, 30)]
    assert [r.queries for r in reached] == [12] * 3 and [r.neighbours for r in reached] == [120] * 3
    assert reached[0].recall <= reached[1].recall <= reached[2].recall == 1.0 and reached[1].recall >= 0.9
    assert knn_indexed(asked, base.limit(0), 3).count() == 0


def test_large_model_is_written_not_collected(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    assert rows(as_model(df, 10)) == rows(df)
    with pytest.raises(ValueError):
        model_rows(df, 10)


def test_som_of_more_maps_than_model_rows_over_nodes(spark):
    """1,001 maps of 100 nodes have more seed rows than a shipped model may have."""
    from marrowgrid.operators.som import fit_som

    rows = [(f"e{m}-{i}", m, [float(m % 7), float(i), 1.0]) for m in range(1001) for i in range(2)]
    events = spark.createDataFrame(rows, "event_id string, patient_id long, x array<double>")
    model = fit_som(events, x="x", key=["event_id"], model="patient_id", xdim=10, ydim=10, epochs=1)
    assert len(model.codes) == 1001


@pytest.mark.parametrize("name", ["X2_score_arrivals", "X2_score_on_map"])
def test_arriving_files_stay_small(spark, sf_dir, monkeypatch, name):
    """More rows are more files, not larger ones; they still come in three batches."""
    import __spark_entry__ as entry
    from casebook import learned
    from tests.compare import compare, duck

    opened = []
    real = learned.jobs.open_files

    def watched(spark, folder, schema, glob, per_trigger=None):
        counts = spark.read.parquet(folder).groupBy(F.input_file_name()).count().agg(F.count("*"), F.max("count")).first()
        opened.append((*counts, per_trigger))
        return real(spark, folder, schema, glob, per_trigger)

    monkeypatch.setattr(learned, "ARRIVAL_ROWS", 500)
    monkeypatch.setattr(learned.jobs, "open_files", watched)
    got = entry.queries()[name](spark, sf_dir).toPandas()
    (files, most, once), = opened
    assert files > 3 and most < 700 and files <= 3 * once
    assert compare(got, duck(sf_dir).execute(entry.oracle_sql()[name]).df()) is None


def _repeated_vectors(spark):
    rng = np.random.default_rng(7)
    kinds = np.round(rng.normal(size=(40, 3)), 2)
    return spark.createDataFrame([(i, [float(v) for v in kinds[i % 40]]) for i in range(2000)], "event_id long, x array<double>")


def test_candidate_maps_train_in_the_same_jobs(spark, monkeypatch):
    """Every map equals the one trained alone, and an epoch of all of them is one job over distinct vectors."""
    from marrowgrid.operators import metacluster, som

    df = _repeated_vectors(spark)
    alone = [som.fit_som(df, xdim=3, ydim=3, epochs=6, seed=s).codes[None] for s in (1, 2, 3)]
    seen, sums = [], som._epoch_sums
    monkeypatch.setattr(som, "_epoch_sums", lambda source, *a: seen.append(source.count()) or sums(source, *a))
    together = som.fit_soms(df, [1, 2, 3], xdim=3, ydim=3, epochs=6)
    assert all(np.allclose(a, b.codes[None], atol=1e-9) for a, b in zip(alone, together))
    assert len(seen) <= 6 and set(seen) == {40}
    seen.clear()
    metacluster.choose_k(df, alone[0], range(2, 6), xdim=3, ydim=3, bootstraps=3, epochs=6)
    assert len(seen) <= 6


def test_choose_k_compares_maps_over_distinct_vectors(spark, monkeypatch):
    """Starts of all maps come from one pass, and maps are compared by equal vectors with their number."""
    from marrowgrid.operators import metacluster, som

    df, seen = _repeated_vectors(spark), []
    codes = som.fit_som(df, xdim=3, ydim=3, epochs=4).codes[None]
    met = metacluster._contingency
    monkeypatch.setattr(metacluster, "_contingency", lambda events, *a: seen.append(events.count()) or met(events, *a))
    monkeypatch.setattr(som, "_start", None)  # not once per seed
    best, scores = metacluster.choose_k(df, codes, range(2, 6), xdim=3, ydim=3, bootstraps=3, epochs=4)
    assert seen == [40] and len(scores) == 4
    monkeypatch.setattr(metacluster, "_contingency", met)
    runs = som.fit_soms(df, [142, 143, 144], xdim=3, ydim=3, epochs=4)
    books = [m.codes[None] for m in runs]
    whole = sorted(map(tuple, met(df, books).collect()))
    assert whole == sorted(map(tuple, met(df.groupBy("x").agg(F.count("*").alias("_n")), books).collect()))


@pytest.mark.parametrize("n, keys", [(30, 30), (5000, 5000), (5000, 3)])
def test_starts_of_many_maps_equal_those_of_each(spark, n, keys):
    """With few rows, with a bound on the hash, and where repeated keys leave too few rows below it."""
    from marrowgrid.operators import som

    df = spark.range(n).select((F.col("id") % keys).alias("event_id"), F.array(F.col("id") % keys * 0.5, F.lit(1.0)).alias("x"))
    got = som._starts(df, "x", ["event_id"], [1, 2, 3], 36, 2, n)
    for seed, book in zip((1, 2, 3), got):
        assert np.array_equal(book, som._start(df, "x", ["event_id"], [], 36, 2, None, seed, 1)[None])


def test_sums_of_an_epoch_meet_in_tasks_or_on_the_driver(spark, monkeypatch):
    from marrowgrid.operators import som

    df = _repeated_vectors(spark).withColumn("_n", F.lit(2).cast("long")).repartition(5)
    x = np.array([r["x"] for r in df.collect()])
    books = {0: x[:4], 1: x[4:9]}
    for numbers in (som.SHIPPED_NUMBERS, 1):
        monkeypatch.setattr(som, "SHIPPED_NUMBERS", numbers)
        for k, (n, s) in som._epoch_sums(df, books, None, None, "x", 3, som._packed(df, "x")).items():
            node = ((x[:, None, :] - books[k][None]) ** 2).sum(axis=2).argmin(axis=1)
            assert np.array_equal(n, 2 * np.bincount(node, minlength=len(books[k])))
            assert np.allclose(s, [2 * x[node == i].sum(axis=0) for i in range(len(books[k]))])


def test_contingency_counts_every_event(spark):
    from marrowgrid.operators import metacluster

    df = _repeated_vectors(spark)
    x = np.array([r["x"] for r in df.collect()])
    books = [x[:4], x[4:9], x[9:12]]
    node = [((x[:, None, :] - b[None]) ** 2).sum(axis=2).argmin(axis=1) for b in books]
    want = {(a, b, i, j): int(((node[a] == i) & (node[b] == j)).sum())
            for a in range(3) for b in range(a + 1, 3) for i in range(len(books[a])) for j in range(len(books[b]))}
    got = {(r["a"], r["b"], r["i"], r["j"]): r["count"] for r in metacluster._contingency(df, books).collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_rows_of_iterative_jobs_are_folded_and_cut(spark):
    """Equal rows are held once with their number; different rows lie in partitions of bounded size, however few files hold them."""
    from marrowgrid.operators import som
    from marrowgrid.operators.sizing import cached, folded

    few = folded(_repeated_vectors(spark).select("x"))
    assert few.count() == 40 and few.agg(F.sum("_n")).first()[0] == 2000
    own = spark.range(20_000).coalesce(1)
    assert folded(own).where("_n = 1").count() == 20_000
    held = cached(own.withColumn("v", F.rand(1)), rows=1000)
    assert max(r[0] for r in held.groupBy(F.spark_partition_id()).count().select("count").collect()) <= 1100
    seen, persist = [], type(own).persist

    def noted(df, *a):
        seen.append(df.columns)
        return persist(df, *a)

    type(own).persist = noted
    try:
        model = som.fit_kmeans_codebook(_repeated_vectors(spark), xdim=2, ydim=2)
    finally:
        type(own).persist = persist
    assert model.codes[None].shape == (4, 3) and ["x", "_n"] in seen


def test_batch_correction_rounds_go_over_distinct_rows(spark, monkeypatch):
    """The rounds see equal rows once with their number, and repeated rows are corrected as single ones are."""
    from marrowgrid.operators import embed

    rng = np.random.default_rng(3)
    m, batch = np.round(rng.normal(size=(900, 2)), 0), rng.integers(0, 2, 900)
    stages = [(rng.normal(size=(3, 2)), np.ones((3, 2)), rng.normal(size=(3, 2, 2))) for _ in range(4)]
    assert np.allclose(embed._corrected(m, batch, stages, 0.7), embed._corrected_rows(m, batch, stages, 0.7), atol=1e-12)
    df = spark.createDataFrame(pd.DataFrame({"u": m[:, 0] + batch, "b": batch}))
    sums, held = embed._cluster_sums, []

    def noted(events, *a):
        held.append((events.count(), events.agg(F.sum("_n")).first()[0]))
        return sums(events, *a)

    monkeypatch.setattr(embed, "_cluster_sums", noted)
    embed.correct_batches(df, ["u"], "b", clusters=2, rounds=3)
    assert len(held) == 3 and all(kinds < 30 and n == 900 for kinds, n in held)


def test_pool_of_many_samples_has_few_files(spark, tmp_path):
    """The files of a stored pool grow with its rows, not with its samples, and a crowded sample is cut."""
    from marrowgrid.sources import readers

    pool = spark.range(6000).select(F.col("id").alias("event_id"), F.concat(F.lit("F"), F.least(F.col("id"), F.lit(400))).alias("file_origin"))
    readers.save_pool(pool, str(tmp_path), "v", rows_per_file=500)
    back = readers.load_pool(spark, str(tmp_path), "v")
    assert rows(back.select("event_id", "file_origin")) == rows(pool)
    per = back.groupBy(F.input_file_name()).count().collect()
    assert len(per) <= 13 and max(r["count"] for r in per) < 1500
    assert readers.load_pool(spark, str(tmp_path), "other") is None


def test_stratifying_hierarchy_goes_over_distinct_vectors(spark, monkeypatch):
    """The hierarchy is fitted on equal vectors once with their number and splits as it does on all rows."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    from marrowgrid.operators import embed

    rng = np.random.default_rng(5)
    spots = np.array([[0, 0], [8, 0], [0, 9], [7, 8]])
    x = spots[rng.integers(0, 4, 1200)] + rng.integers(0, 2, (1200, 2))
    df = spark.createDataFrame(pd.DataFrame({
        "event_id": np.arange(1200), "file": [f"F{i % 12}" for i in range(1200)], "u": x[:, 0].astype(float), "v": x[:, 1].astype(float)}))
    df = df.withColumn("endpoint", (F.substring("file", 2, 2).cast("int") % 2))
    fit, seen = BisectingKMeans.fit, []

    def noted(self, data, *a):
        seen.append((data.count(), self.getWeightCol()))
        return fit(self, data, *a)

    whole = fit(BisectingKMeans(k=4, seed=42), df.select(array_to_vector(F.array("u", "v")).alias("features")))
    want = sorted(whole.transform(df.select(array_to_vector(F.array("u", "v")).alias("features"))).groupBy("prediction").count().toPandas()["count"])
    monkeypatch.setattr(BisectingKMeans, "fit", noted)
    monkeypatch.setattr(embed, "lasso_importance", lambda table, columns, *_, **__: spark.createDataFrame([(c, 1.0) for c in columns], "feature string, importance double"))
    out = embed.stratifying_clusters(df, "file", "endpoint", ["u", "v"], hash_order("event_id"), clusters=4).toPandas()
    assert seen == [(16, "weight")] and sorted(out["n"]) == want


def test_samples_within_their_quota_need_no_order(spark, monkeypatch):
    """No sample is larger than its quota, so no key is hashed and no sample sorted by it."""
    from marrowgrid.operators import embed

    rng = np.random.default_rng(5)
    x = rng.integers(0, 2, (400, 2)) * 9.0 + rng.integers(0, 2, (400, 2))
    df = spark.createDataFrame(pd.DataFrame({"event_id": np.arange(400), "file": [f"F{i % 4}" for i in range(400)], "u": x[:, 0], "v": x[:, 1]}))
    df = df.withColumn("endpoint", F.substring("file", 2, 1).cast("int") % 2)
    monkeypatch.setattr(embed, "lasso_importance", lambda table, columns, *_, **__: spark.createDataFrame([(c, 1.0) for c in columns], "feature string, importance double"))
    unused = F.raise_error(F.concat(F.lit("ordered "), F.col("event_id").cast("string"))).cast("string")
    out = embed.stratifying_clusters(df, "file", "endpoint", ["u", "v"], unused, clusters=4, per_sample=100).toPandas()
    assert out["n"].sum() == 400
    few = embed.stratifying_clusters(df, "file", "endpoint", ["u", "v"], hash_order("event_id"), clusters=4, per_sample=30).toPandas()
    assert few["n"].sum() == 120
