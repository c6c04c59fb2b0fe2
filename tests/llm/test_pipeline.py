"""Stages of the pipeline, each against its operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marrowgrid import session
from marrowgrid.llm import divergence_rules, quality_cotraining, queries
from tests.llm.test_near import plain_similar

STAGES = dict(corpus_pipeline.STAGES)


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_stages_in_order():
    assert list(STAGES) == ["quality classifier", "quality rules", "near duplicates", "packing"]


def test_decisions_take_effect(spark, sf_dir, documents, labels):
    features = quality_cotraining.with_labels(documents, labels)
    rejected = quality_cotraining.score(features, quality_cotraining.fit(features)).where("not kept")
    first = STAGES["quality classifier"](spark, documents, sf_dir)
    assert first.columns == documents.columns and ids(first) == sorted(set(ids(documents)) - set(ids(rejected)))
    second = STAGES["quality rules"](spark, first, sf_dir)
    kept = divergence_rules.apply_rules(first, divergence_rules.references(first)).where("kept")
    assert second.columns == documents.columns and ids(second) == ids(kept)
    third = STAGES["near duplicates"](spark, second, sf_dir)
    groups = plain_similar({r.doc_id: r.text for r in second.collect()})
    assert third.columns == documents.columns and ids(third) == sorted(set(groups.values()))
    last = STAGES["packing"](spark, third, sf_dir)
    assert sorted({r.doc_id for r in last.collect()}) == ids(third)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.agg(F.sum("length")).first() == last.agg(F.sum("length")).first()


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_rows(spark, sf_dir, odd, none, name):
    small = odd.where("doc_id is null or doc_id <> 9").select("doc_id", "text", "lang", "source", "n_chars", F.col("score"))
    got = STAGES[name](spark, small, sf_dir)
    if name != "packing":
        assert got.columns == corpus_pipeline.COLUMNS
    got.collect()
    assert STAGES[name](spark, none, sf_dir).count() == 0


def test_repeated_rows_are_one_document(spark, sf_dir, odd):
    kept = STAGES["near duplicates"](spark, odd.where("doc_id is null or doc_id in (5, 6, 7)"), sf_dir)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 5), (False, 7), (True, 0)]


def test_near_duplicates_keep_no_large_table(spark, sf_dir, documents, monkeypatch, tmp_path):
    """Prefixes, meetings and shingle sets go once they are used, and the setting that releases shuffle files is put back."""
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    assert STAGES["near duplicates"](spark, documents, sf_dir).count() > 0
    left = {p.name.split("-")[0] for p in tmp_path.iterdir()}
    assert "dropped" in left and not left & {"marked", "own", "prefixes", "met", "sets"}
    assert spark.conf.get(key) == before


@pytest.mark.parametrize("name", list(STAGES))
def test_texts_go_to_python_in_small_batches(spark, sf_dir, none, name):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        STAGES[name](spark, none, sf_dir)
        assert int(spark.conf.get(key)) <= 1000
    finally:
        spark.conf.set(key, before)


def test_only_stage_tables_can_be_removed(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "given"))
    given = spark.read.parquet(str(tmp_path / "given"))
    with pytest.raises(KeyError):
        session.unstaged(given)
    assert given.count() == 3


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
