"""SimHash and I-Match against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marrowgrid.llm import imatch, near_copies, simhash
from marrowgrid.llm.common import components

DOCS = "doc_id long, text string"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(rows, radius=4):
    """(doc id, fingerprint) rows to {doc id: smallest reachable id}."""
    low = {i: i for i, _ in rows}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(i), find(j)
                low[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_fingerprints(documents, odd):
    for docs in (documents, odd.where("doc_id is null or doc_id <> 9")):
        for r, text in zip(simhash.fingerprints(docs).collect(), [r.text for r in docs.select("text").collect()]):
            assert r.fp % (1 << 64) == plain_fingerprint(text)


def test_blocks_do_not_change_a_fingerprint(monkeypatch):
    from marrowgrid.llm import common

    text = " ".join(f"word{i % 97} x{i % 31}" for i in range(2000))
    want = plain_fingerprint(text)
    monkeypatch.setattr(simhash, "byte_blocks", lambda data: common.byte_blocks(data, 50))
    assert simhash.fingerprint(text.encode()) == want


@pytest.mark.parametrize("tile", [2048, 4])
def test_near_duplicates_equal_brute_force(spark, tile):
    rng = random.Random(5)
    values = []
    for _ in range(40):
        value = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 2, 12])):
            values.append(value)
            for _ in range(rng.randint(0, 4)):
                value ^= 1 << rng.randrange(64)
    hub = rng.getrandbits(64)
    values += [hub ^ sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(60)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    distinct = spark.createDataFrame([(v,) for v in sorted(set(signed))], "fp long")
    found = {r.node: r.root for r in components(simhash.links(distinct, 4, tile)).collect()}
    want = plain_components([(v, v % (1 << 64)) for v in sorted(set(signed))])
    assert {v: found.get(v, v) for v in want} == want


def test_near_duplicates_of_documents(documents, odd, none):
    rows = simhash.near_duplicates(documents).collect()
    want = plain_components([(r.doc_id, int(r.fingerprint, 16)) for r in rows])
    assert {r.doc_id: r.component_id for r in rows} == want
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == "0" * 16 and by_id[1].component_id == by_id[2].component_id == by_id[3].component_id == 1
    assert by_id[6].component_id == 5 and by_id[7].component_id == 7
    assert simhash.near_duplicates(none).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 700)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5)]
    random.Random(2).shuffle(edges)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(701)} | {i: 1000 for i in range(1000, 1400)}


def plain_edited(texts):
    """{doc id: edited text}, {doc id: next doc id} by descending id."""
    ids = sorted(texts, reverse=True)
    following = dict(zip(ids, ids[1:] + ids[:1]))
    out = {}
    for i in ids:
        half = len(texts[i]) // 2
        out[i] = texts[i][:len(texts[i]) - half] + texts[following[i]][:half]
    return out, following


def terms(text):
    return {t for t in re.split(r"[^\w]+|_", text.lower()) if t}


@pytest.mark.parametrize("rows_per_range", [4000, 30])
def test_edited_texts_and_likeness(documents, monkeypatch, rows_per_range):
    monkeypatch.setattr(imatch, "RANGE_ROWS", rows_per_range)
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    edited, following = plain_edited(texts)
    rows = {r.doc_id: r for r in imatch.edited_and_next(documents).collect()}
    assert set(rows) == set(texts)
    prints = {}
    for i, r in rows.items():
        assert r.n_chars == len(texts[i])
        assert r.edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(texts[i], set()).add(r.fingerprint)
        if texts[i] == texts[following[i]]:
            assert r.near_next == 1
    assert all(len(p) == 1 for p in prints.values())
    gap = np.array([r.near_edited - r.near_next for r in rows.values()])
    assert (gap > 0).mean() > 0.8


def test_subsets_equal_a_plain_rule(spark):
    """The hashes of the subsets, from term hashes, by a Python restatement."""
    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    hashes = [random.Random(i).getrandbits(63) for i in range(12)]
    frame = spark.createDataFrame([(sorted(hashes),)], "terms array<long>")
    got = frame.select(imatch.subset_hashes(F.col("terms")).alias("h")).first().h
    chosen = frame.select(*[F.expr(f"filter(terms, t -> pmod(xxhash64(t, {n}), {imatch.SUBSET_ONE_IN}) = 0)").alias(f"s{n}")
                            for n in range(1, imatch.SUBSETS + 1)]).first()
    for n, code in enumerate(got, 1):
        own = chosen[f"s{n}"]
        assert own == sorted(own)
        assert (code == -1) == (not own)
    # an unchanged subset keeps its hash, a changed one does not
    fewer = spark.createDataFrame([(sorted(hashes)[1:],)], "terms array<long>").select(
        imatch.subset_hashes(F.col("terms")).alias("h")).first().h
    gone = sorted(hashes)[0]
    for n in range(1, imatch.SUBSETS + 1):
        assert (got[n - 1] == fewer[n - 1]) == (gone not in chosen[f"s{n}"])


def test_lexicon_is_the_band(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 20} rare{i}") for i in range(40)], DOCS)
    known = {r.term for r in imatch.lexicon(docs, 2, 0.1).collect()}
    named = {r.w: r.h for r in spark.createDataFrame([(w,) for w in ["common", "word3", "rare7"]], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    assert named["word3"] in known and named["common"] not in known and named["rare7"] not in known
    assert len(known) == 20


def test_odd_rows_of_imatch(spark, odd, none):
    rows = imatch.edited_and_next(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_chars == 0 and by_id[1].fingerprint == by_id[2].fingerprint
    assert by_id[5].fingerprint == by_id[6].fingerprint
    assert by_id[6].near_next == 1  # the next document by descending id is 5, with the same text
    assert imatch.edited_and_next(none).count() == 0
    assert imatch.fingerprints(none).count() == 0
    one = imatch.edited_and_next(spark.createDataFrame([(3, "alone here")], DOCS)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"alonealone"[:5] + b"alone").hexdigest() and one[0].near_next == 1
    same = {r.doc_id: r.fingerprint for r in imatch.fingerprints(odd).collect()}
    assert same[5] == same[6]


def plain_similar(texts, least=0.8):
    """{doc id: smallest id reachable over texts whose five-word shingles have this likeness}."""
    sets = {}
    for i, text in texts.items():
        words = text.lower().split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    low = {i: i for i in texts}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])):
                x, y = find(i), find(j)
                low[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("tile, block, crowded", [(2048, 4096, 256), (5, 4, 256), (5, 4, 4)])
def test_similar_documents_equal_brute_force(spark, monkeypatch, tile, block, crowded):
    """Near copies too far apart for four bits are found, near fingerprints of unlike texts are not linked."""
    monkeypatch.setattr(near_copies, "CROWDED", crowded)
    if tile == 5:
        monkeypatch.setattr(near_copies, "HELD_PAIRS", 3)
        monkeypatch.setattr(near_copies, "LOCAL_LINKS", 0 if crowded == 256 else 200_000)
        monkeypatch.setattr(near_copies, "HELD_TOKENS", 50)
    rng, texts = random.Random(8), {}
    passage = " ".join(f"p{k}" for k in range(60))
    for k in range(12):
        texts[len(texts)] = passage + " " + " ".join(f"own{k}x{m}" for m in range(rng.choice([5, 90])))
    for group in range(8):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([150, 400, 800]))]
        for _ in range(6):
            own = list(words)
            for _ in range(rng.randrange(0, len(words) // 45 + 1)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(3000)}"
            texts[len(texts)] = " ".join(own)
    texts |= {len(texts): "", len(texts) + 1: " ", len(texts) + 2: "one two", len(texts) + 3: "One two"}
    docs = spark.createDataFrame(list(texts.items()), DOCS)
    want = plain_similar(texts)
    assert {r.doc_id: r.component_id for r in near_copies.similar_documents(docs, tile=tile, block=block).collect()} == want
    close = plain_components([(i, plain_fingerprint(t)) for i, t in texts.items()])
    assert close != want


def test_similar_documents_of_given_tables(documents, odd, none):
    rows = documents.select("doc_id", "text").collect()
    want = plain_similar({r.doc_id: r.text for r in rows})
    assert {r.doc_id: r.component_id for r in near_copies.similar_documents(documents).collect()} == want
    got = near_copies.similar_documents(odd).collect()
    assert len(got) == odd.where("doc_id is not null").count()
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[6] == 5 and by_id[7] == 7
    assert near_copies.similar_documents(none).count() == 0


def test_several_texts_of_one_id(spark):
    long = " ".join(f"w{k}" for k in range(50))
    rows = [(5, long), (7, long), (7, "another text of the same id here"), (9, "another text of the same id here"), (11, "alone")]
    got = near_copies.similar_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.component_id for r in got} == {5: 5, 7: 5, 9: 5, 11: 11}


def test_pairs_of_one_label_are_not_compared():
    base = np.arange(100, dtype=np.int64)
    sets = [base, base[:90], base[5:], np.arange(200, 300), np.concatenate([base[:70], np.arange(500, 520)])]
    ids = np.array([10, 11, 12, 13, 14])
    found = near_copies.alike(ids, sets, np.zeros(5, int), ids.copy(), 0.8)
    assert sorted(found) == [(10, 11), (10, 12)]
    assert near_copies.alike(ids, sets, np.zeros(5, int), np.array([1, 1, 1, 2, 3]), 0.8) == []
    assert near_copies.alike(ids, sets, np.array([0, 1, 1, 0, 1]), ids.copy(), 0.8) == [(10, 11), (10, 12)]


def test_close_pairs_equal_all_pairs():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, (60, 4), dtype=np.uint64)
    b = np.concatenate([a[:20] ^ (np.uint64(1) << rng.integers(0, 63, (20, 4)).astype(np.uint64)), rng.integers(0, 1 << 63, (30, 4), dtype=np.uint64)])
    want = {(i, j) for i in range(60) for j in range(50) if (int(a[i, 0]) ^ int(b[j, 0])).bit_count() <= simhash.SIMILAR_RADIUS
            and sum((int(x) ^ int(y)).bit_count() for x, y in zip(a[i], b[j])) <= simhash.WIDE_RADIUS}
    found = {(int(i), int(j)) for x, y in simhash.close_pairs(a, b, False) for i, j in zip(x, y)}
    assert found == want and len(want) >= 20
    inside = {(int(i), int(j)) for x, y in simhash.close_pairs(b, b, True) for i, j in zip(x, y)}
    assert all(i < j for i, j in inside)


@pytest.mark.parametrize("bits", [1 << 26, 1 << 7])
def test_prefixes_of_one_text_of_each_node(spark, monkeypatch, bits):
    """Also where the sets of bits are so small that most nodes and rows meet there by chance."""
    monkeypatch.setattr(near_copies, "ID_BITS", bits)
    rows = [(n * 100 + i, n, i, [n, n + i]) for n in range(300) for i in range(1 if n % 3 else 4)]
    marked = spark.createDataFrame([(d, n, p, r) for r, (d, n, _, p) in enumerate(rows)], "doc_id long, node long, prefix array<long>, row long")
    nodes = marked.groupBy("node").agg(F.count("*").alias("copies"), F.min("row").alias("row"))
    got = sorted((r.node, r.id, r.prefix) for r in near_copies._prefixes(marked, nodes).collect())
    assert got == [(n, n * 100, [n, n]) for n in range(300)]
    rest = sorted(r.node for r in near_copies._holding(near_copies._prefixes(marked, nodes), np.arange(0, 300, 2), False).collect())
    assert rest == list(range(1, 300, 2))


def test_no_task_runs_two_python_steps(documents, monkeypatch):
    """Prefixes are read from a table, so a task has one Python worker and not a second one that makes them."""
    plans = []
    for name in ("_dealt", "_holding"):
        def step(prefixes, *rest, inner=getattr(near_copies, name)):
            plans.append(prefixes._jdf.queryExecution().optimizedPlan().toString())
            return inner(prefixes, *rest)

        monkeypatch.setattr(near_copies, name, step)
    monkeypatch.setattr(near_copies, "CROWDED", 4)
    near_copies.similar_documents(documents)
    assert len(plans) >= 5 and not any("MapInArrow" in p for p in plans)


@pytest.mark.parametrize("bits", [1 << 26, 1 << 7])
@pytest.mark.parametrize("share", [0, 3, 1])
def test_rows_without_the_given_ids(spark, monkeypatch, bits, share):
    """Also where most ids meet a given one in the set of bits by chance, and where none or all are given."""
    monkeypatch.setattr(near_copies, "ID_BITS", bits)
    rows = [(i % 200 - 20, f"text {i}") for i in range(240)] + [(None, "no id"), (None, None)]
    given = [i for i in range(-20, 180) if share and i % share == 0]
    ids = spark.createDataFrame([(i,) for i in given], "doc_id long")
    got = near_copies.without(spark.createDataFrame(rows, DOCS), ids)
    assert got.columns == ["doc_id", "text"]
    want = [r for r in rows if r[0] not in given]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
