"""Language, quality, rules and toxicity: brute-force restatements and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marrowgrid.llm import divergence_rules, language_ppm, quality_cotraining, toxicity
from tests.llm.conftest import DOCUMENTS

ROW = "doc_id long, text string, lang string"


# ---------------------------------------------------------------------------------------------------- language


def plain_bits(training, text, order=language_ppm.ORDER):
    """Code length by a dictionary of contexts, one byte at a time."""
    seen = {}
    for other in training:
        data = bytes(order) + other
        for i in range(order, len(data)):
            for k in range(order + 1):
                seen.setdefault(data[i - k:i], Counter())[data[i]] += 1
    data, bits = bytes(order) + text, 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            after = seen.get(data[i - k:i])
            if after is None:
                continue
            n, d = after.total(), len(after)
            if data[i] in after:
                bits -= math.log2(after[data[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_a_plain_model(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "the dog ate that", "en"), (3, "le chat est là", "fr"), (4, None, "fr"), (5, "x", None)]
    model = language_ppm.fit(spark.createDataFrame(rows, ROW))
    assert model.langs == ["en", "fr"]
    for text in ("the chat", "zzz\x00qé", "a", "là là"):
        got = model.code_lengths([text.encode()])[0]
        want = [plain_bits([t.encode() for _, t, g in rows if g == lang and t], text.encode()) for lang in model.langs]
        assert np.allclose(got, want)


def test_long_texts_are_cut_without_loss(monkeypatch, spark):
    model = language_ppm.fit(spark.createDataFrame([(1, "some words of a language " * 9, "en"), (2, "quelques mots " * 9, "fr")], ROW))
    texts = [b"some words " * 50, b"mots", b"", "é".encode() * 99]
    whole = model.code_lengths(texts)
    pieces = language_ppm.pieces
    monkeypatch.setattr(language_ppm, "pieces", lambda t: pieces(t, 17))
    assert np.allclose(model.code_lengths(texts), whole)


def test_languages_of_documents(documents, odd, none):
    rows = {r.doc_id: r for r in language_ppm.identify(documents).collect()}
    truth = {r.doc_id: r.lang for r in documents.collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [i for i, r in rows.items() if r.held_out]
    assert np.mean([rows[i].lang_pred == truth[i] for i in held]) > 0.97
    found = language_ppm.identify(odd).collect()
    assert len(found) == odd.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (1, 2, 3, 8))
    assert language_ppm.identify(none).count() == 0


def test_no_training_rows_and_no_use_of_labels(spark):
    rows = spark.createDataFrame([(i, "text here", None) for i in range(5)], ROW)
    assert {r.lang_pred for r in language_ppm.identify(rows).collect()} == {"und"}


# ---------------------------------------------------------------------------------------------------- rules


def plain_counts(text):
    """The contract's counts, restated."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for i in range(len(words) - 2):
        if triples[tuple(words[i:i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside),
            len(words) < 50 or 100 * len(inside) > 50 * len(words))


def test_counts(documents, odd, none):
    for docs in (documents, odd):
        texts = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                      for r in divergence_rules.apply_rules(docs, {}).collect())
        assert set(got) == {(i, *plain_counts(t)) for i, t in texts} and got.total() == docs.count()
    assert divergence_rules.references(none) == {} and divergence_rules.apply_rules(none, {}).count() == 0


def test_repeated_words_with_many_distinct_words():
    rng = random.Random(1)
    for distinct in (3, 50, 3_000_000):
        codes = np.array([rng.randrange(min(distinct, 9)) for _ in range(60)])
        triples = Counter(zip(codes, codes[1:], codes[2:]))
        want = {j for i in range(58) if triples[tuple(codes[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert divergence_rules.repeated_words(codes, distinct) == len(want)


def test_divergence_is_the_definition():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.1, 0.2, 0.7])
    m = (p + q) / 2
    want = sum(a * math.log2(a / b) for a, b in zip(p, m) if a) / 2 + sum(a * math.log2(a / b) for a, b in zip(q, m) if a) / 2
    assert math.isclose(divergence_rules.divergence(p[None], q)[0], want)
    assert divergence_rules.divergence(np.array([[1.0, 0.0]]), np.array([0.0, 1.0]))[0] == 1.0


def test_references_equal_plain_counts(documents):
    known = divergence_rules.references(documents)
    rows = [r for r in documents.collect() if r.lang and not divergence_rules.measure(r.text).base_failed]
    for lang, ref in known.items():
        words, classes = Counter(), np.zeros(divergence_rules.CLASSES)
        for r in rows:
            if r.lang == lang:
                found = divergence_rules.measure(r.text)
                words.update(found.common)
                classes += found.classes
        total = words.total()
        want = {w: n / total for w, n in words.items() if n >= divergence_rules.MIN_SHARE * total}
        assert dict(zip(ref.words, ref.shares)) == pytest.approx(want)
        assert ref.classes == pytest.approx(classes / classes.sum())
    assert set(known) == {r.lang for r in rows}


def test_verdicts(documents):
    known = divergence_rules.references(documents)
    rows = {r.doc_id: r for r in divergence_rules.apply_rules(documents, known).collect()}
    kept = {r.doc_id for r in documents.where(divergence_rules.passes(documents, known)).collect()}
    assert kept == {i for i, r in rows.items() if r.kept}
    assert all(not r.kept for r in rows.values() if r.base_failed)
    texts = {r.doc_id: r.text for r in documents.collect()}
    junk = [i for i, t in texts.items() if not rows[i].base_failed and ("%%%" in t or t.count("!!") > 20)]
    clean = [i for i, t in texts.items() if not rows[i].base_failed and not re.search(r"%%%|!!|###|\$\$\$|&&&| \| |\*\*\*", t)]
    assert junk and not any(rows[i].kept for i in junk)
    assert np.mean([rows[i].kept for i in clean]) > 0.99


@pytest.mark.parametrize("greek", [15, 20])
def test_languages_without_reference(spark, documents, greek):
    """Clean texts of a language below the guard, or of none, are kept whatever other languages have references."""
    rng = random.Random(4)
    words = ["".join(rng.choice("αβγδεηικλμνοπρστυ") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    latin = ["".join(rng.choice("abdeghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = [(10 ** 6 + i, " ".join(rng.choices(words, k=60)) + ".", "el") for i in range(greek)]
    rows += [(2 * 10 ** 6 + i, " ".join(rng.choices(latin, k=150)) + ".", None) for i in range(5)]
    short = [(3 * 10 ** 6, "too few words", None), (3 * 10 ** 6 + 1, "λίγα", "el")]
    docs = documents.select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame(rows + short, "doc_id long, text string, lang string"))
    known = divergence_rules.references(docs)
    assert ("el" in known) == (60 * greek >= divergence_rules.REFERENCE_WORDS)
    kept = {r.doc_id for r in divergence_rules.apply_rules(docs, known).where("kept and doc_id >= 1000000").collect()}
    assert kept == {i for i, _, _ in rows}
    assert {r.doc_id for r in docs.where(divergence_rules.passes(docs, known)).where("doc_id >= 1000000").collect()} == kept


# ---------------------------------------------------------------------------------------------------- quality


def test_cotraining(spark):
    # the next table up: the smallest has nineteen held-out labels
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    features = quality_cotraining.with_labels(documents, labels.where(~quality_cotraining.held_out()))
    model = quality_cotraining.fit(features)
    scored = quality_cotraining.score(features, model)
    rows = {r.doc_id: r for r in scored.collect()}
    assert len(rows) == documents.count()
    held = [(r.doc_id, r.quality) for r in labels.where(quality_cotraining.held_out()).collect()]
    assert np.mean([rows[i].kept == (q == 1) for i, q in held]) > 0.9
    assert all(0 <= x <= 1 for r in rows.values() for x in (r.text_score, r.meta_score, r.score))
    kept = {r.doc_id for r in documents.where(quality_cotraining.keeps(documents, model)).collect()}
    assert kept == {i for i, r in rows.items() if r.kept}


def test_views_teach_each_other(spark, documents, labels):
    """Confident labels are given once, copies count once, and only unlabelled rows are asked."""
    few = labels.where("doc_id % 4 = 0")
    features = quality_cotraining.with_labels(documents.unionByName(documents), few)
    x = quality_cotraining._inputs(features.where("quality is not null").toPandas())
    y = features.where("quality is not null").toPandas()["quality"].to_numpy(float)
    views = {n: quality_cotraining._fit_view(n, x[n], y, np.ones(len(y))) for n in quality_cotraining.VIEWS}
    sure = quality_cotraining._confident(features, views, 15, 0.9)
    assert len(sure) and sure.groupby(["view", "label"]).size().max() <= 15
    assert not sure.duplicated(["view", "label", "h"]).any()
    labelled = {r.h for r in features.where("quality is not null").select("h").collect()}
    unlabelled = {r.h for r in features.where("quality is null").select("h").collect()}
    assert set(sure["h"]) <= unlabelled and labelled


def test_odd_rows_of_cotraining(spark, odd, none, labels):
    features = quality_cotraining.with_labels(odd, spark.createDataFrame([(1, None), (None, 1), (4, 1), (4, 0), (7, 1)], "doc_id long, quality int"))
    rows = quality_cotraining.score(features, quality_cotraining.fit(features)).collect()
    assert len(rows) == odd.count() and all(r.kept for r in rows)  # one class only: the share of good labels
    empty = quality_cotraining.with_labels(none, labels)
    assert quality_cotraining.score(empty, quality_cotraining.fit(empty)).count() == 0
    unlabelled = quality_cotraining.with_labels(odd, labels.where("false"))
    assert {r.score for r in quality_cotraining.score(unlabelled, quality_cotraining.fit(unlabelled)).collect()} == {0.5}


# ---------------------------------------------------------------------------------------------------- toxicity


def _toxic_table(spark, n=600):
    rng = random.Random(4)
    syllables = ["ba", "to", "ri", "ne", "lo", "mu", "sha", "ke"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["wretchling", "gormhead", "snivelpig"]))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark, odd, none):
    docs, labels = _toxic_table(spark)
    rows = {r.doc_id: r for r in toxicity.detect(docs, labels).collect()}
    held = [i for i, r in rows.items() if r.held_out]
    assert held == [i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([rows[i].predicted == (i % 6 == 0) for i in held]) > 0.97
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows.values())
    model = toxicity.fit(docs, labels)
    logits = toxicity.WordLogits(model.buckets)
    # an unseen misspelling is nearer to its word than to clean words
    for wrong, word in (("wretchlingg", "wretchling"), ("gormheed", "gormhead")):
        for clean in ("toriba", "shake", "lomune"):
            assert abs(logits[wrong] - logits[word]) < abs(logits[wrong] - logits[clean])
            assert logits[wrong] + model.bias > 0 > logits[clean] + model.bias
    assert toxicity.score(none, model).count() == 0
    assert toxicity.score(odd, model).count() == odd.count()


def test_span_logit_is_the_highest_mean(spark):
    buckets = np.random.default_rng(1).normal(size=toxicity.BUCKETS)
    model, logits = toxicity.ToxicModel(buckets, 0.25, 1.0, 0.0), toxicity.WordLogits(buckets)
    words = [f"w{i}" for i in range(40)]
    values = [np.mean([buckets[b] for b in toxicity.subwords(w)]) for w in words]
    want = max(np.mean(values[i:i + toxicity.SPAN]) for i in range(40 - toxicity.SPAN + 1)) + 0.25
    assert math.isclose(model.document_logit(logits, " ".join(words)), want)
    assert model.document_logit(logits, None) == model.document_logit(logits, " .,") == 0.25
    assert math.isclose(model.document_logit(logits, "w1"), values[1] + 0.25)


def test_toxicity_without_both_labels(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.detect(odd, labels).collect()} == {0}
    assert toxicity.detect(odd, labels.where("false")).count() == odd.count()
