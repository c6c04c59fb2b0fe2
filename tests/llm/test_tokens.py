"""Byte BPE, packing and unigram counts against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from marrowgrid.llm import bpe_cuts, packing, unigram_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(VOCABULARY)
BPE = bpe_cuts.ForcedCutBpe(open(VOCABULARY, encoding="utf-8").read())
FAST = packing.Encoder(open(VOCABULARY, encoding="utf-8").read())


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoders_equal_the_library(text):
    want = ids_of(text)
    assert BPE.encode(text).tolist() == want
    assert FAST(text).tolist() == want
    assert BPE.decode(np.array(want)) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "", " ", "a" * 5000, "=" * 3001, " " * 5000 + "x", "\n" * 4000, "I'LL it's <|endoftext|> x <|endoftext|>", "ab" * 3000,
    "".join(map(chr, range(0x250))), "กำ" * 500])
def test_hard_texts(text):
    want = ids_of(text)
    assert BPE.encode(text).tolist() == want
    assert FAST(text).tolist() == want
    assert BPE.decode(np.array(want)) == text


def test_cuts_are_outside_all_tokens():
    pieces = BPE.fragments_of("naïve zx\x00qj ﬁ".encode())
    assert b"".join(pieces) == "naïve zx\x00qj ﬁ".encode()
    assert len(pieces) > 3
    for left, right in zip(pieces, pieces[1:]):
        assert not any(left[-1:] + right[:1] in token for token in BPE.ids)


def test_heap_and_search_merge_alike():
    rng = random.Random(3)
    for _ in range(200):
        data = bytes(rng.choice(b"etaoin shrdlu") for _ in range(rng.randint(2, 120)))
        short = bpe_cuts._LONG
        try:
            bpe_cuts._LONG = 10_000
            plain = BPE._merge(data)
        finally:
            bpe_cuts._LONG = short
        assert BPE._merge_long(data) == plain


def test_round_trip_of_documents(spark, documents, odd, none):
    for docs in (documents, odd):
        texts = {(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()}
        rows = bpe_cuts.round_trip(docs, VOCABULARY).collect()
        assert {(r.doc_id, r.decoded) for r in rows} == texts
        assert len(rows) == docs.count()
        by_text = {r.decoded: r.ids for r in rows}
        assert all(ids == ids_of(text) for text, ids in by_text.items())
        back = bpe_cuts.decode(bpe_cuts.encode(docs, VOCABULARY), VOCABULARY)
        assert {(r.doc_id, r.text) for r in back.collect()} == texts
    assert bpe_cuts.round_trip(none, VOCABULARY).count() == 0


def _check_packing(docs, rows, most_padded):
    want = sorted(((r.doc_id is None, r.doc_id or 0), tuple(ids_of(r.text or "") + [1])) for r in docs.select("doc_id", "text").collect())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    padded = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(x.length for x in pieces[:i]) for i in range(len(pieces))]
        total = sum(r.length for r in pieces)
        assert 0 < total <= 2048
        padded += total & (total - 1) != 0
    assert padded <= most_padded
    # every id of every document lies in one piece, with the right checksum
    parts = {}
    for r in rows:
        parts.setdefault(((r.doc_id is None, r.doc_id or 0), r.doc_tokens), []).append(r)
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in want)
    for (doc, total), pieces in parts.items():
        texts = {ids for d, ids in want if d == doc and len(ids) == total}
        assert len(texts) == 1
        ids = np.array(texts.pop(), "<u4")
        copies = sum(1 for d, i in want if d == doc and len(i) == total)
        covered = np.zeros(total, int)
        for r in pieces:
            covered[r.start:r.start + r.length] += 1
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
        assert (covered == copies).all()


def test_packing(spark, documents, odd, none):
    for docs in (documents, odd):
        rows = packing.pack(docs, VOCABULARY).collect()
        _check_packing(docs, rows, docs.rdd.getNumPartitions())
        assert {r.tier for r in rows} <= set(packing.TIERS)
    assert packing.pack(none, VOCABULARY).count() == 0


def test_packing_in_small_chunks(documents):
    rows = packing.pack(documents.coalesce(1), VOCABULARY, chunk_tokens=3000, step_tokens=4096).collect()
    _check_packing(documents, rows, 1)
    groups = {}
    for r in rows:
        groups[r.step_group] = groups.get(r.step_group, 0) + r.length
    assert max(groups.values()) <= 4096


def test_packer_routes_and_fills():
    packer = packing.Packer(0)
    sizes = [5000, 1500, 600, 300, 100, 90, 7, 1]
    packer.pack([(i, 0, np.arange(n, dtype=np.uint32), n) for i, n in enumerate(sizes)])
    packer.finish()
    filled = {}
    for row in packer.rows:
        filled[row[5]] = filled.get(row[5], 0) + row[2]
    assert sum(filled.values()) == sum(sizes)
    assert sum(v & (v - 1) != 0 for v in filled.values()) <= 1


def _library_counter(pieces, byte_fallback):
    library = Tokenizer(models.Unigram(pieces, 0, byte_fallback))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(library.encode(text, add_special_tokens=False).ids)


SMALL = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -3.0), ("bb", -1.5)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab xyé▁\n", max_size=40))
def test_ties_and_unknown_characters(text):
    assert unigram_counts.UnigramCounter(SMALL).count(text) == _library_counter(SMALL, False)(text)


def test_unigram_counts_of_documents(spark, documents, odd, none):
    pieces = unigram_counts.sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    want = _library_counter(pieces, True)
    for docs in (documents, odd.where("doc_id is null or doc_id <> 9")):
        got = {(r.doc_id, r.n_tokens) for r in unigram_counts.token_counts(docs, pieces).collect()}
        assert got == {(r.doc_id, want(r.text or "")) for r in docs.select("doc_id", "text").collect()}
    assert unigram_counts.token_counts(none, pieces).count() == 0
    # a long word keeps to a bounded memory and the same count
    counter = unigram_counts.UnigramCounter(pieces)
    assert counter.count("abc" * 5000) == want("abc" * 5000)
