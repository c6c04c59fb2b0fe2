"""Grace deduplication, spelling variants and source divergence against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marrowgrid.llm import grace_dedup, source_divergence, spelling_variants

DOCS = "doc_id long, text string, lang string, source string"


# ---- exact duplicates ------------------------------------------------------------------------------------------------


def plain_duplicates(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), keep is None or i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_normalised_text():
    for text in ("", " ", "\t\n", " a  b\n\nc ", "a", "a\x0b\x0cb ", "x y", "\x1fz "):
        assert grace_dedup.normalised(text.encode()) == re.sub(r"[\x20\x09-\x0D]+", " ", text).encode()


def test_table_compares_contents_of_equal_hashes():
    data = [b"aa", b"bb", b"aa", b"c", b"bb", b"cc", b"aa"]
    for hashes in (np.zeros(7, np.uint64), np.arange(7, dtype=np.uint64) % np.uint64(2)):
        first = grace_dedup.classes(np.zeros(7, np.uint64), data)
        assert first.tolist() == [0, 1, 0, 3, 1, 5, 0]
    # rows that start at the last slot go on at the first
    assert grace_dedup.classes(np.full(7, (1 << 64) - 1, np.uint64), data).tolist() == [0, 1, 0, 3, 1, 5, 0]


@pytest.mark.parametrize("bucket_bytes", [grace_dedup.BUCKET_BYTES, 2000, 150])
def test_duplicates_equal_brute_force(spark, monkeypatch, bucket_bytes):
    """Small buckets force splits, cuts of a hot text, and several rounds of representatives."""
    monkeypatch.setattr(grace_dedup, "FOLD_ROWS", 3)
    monkeypatch.setattr(grace_dedup, "slices", lambda batch: (batch.slice(i, 2) for i in range(0, batch.num_rows, 2)))
    rng = random.Random(4)
    texts = [f"text {i}" + " word" * rng.randint(0, 30) for i in range(60)]
    rows = [(i, rng.choice(texts).replace(" ", rng.choice([" ", "  ", "\n"]), 1)) for i in range(300)]
    rows += [(1000 + i, "the hot  text" + " of many" * 5) for i in range(150)] + [(2000, None), (2001, ""), (None, ""), (None, "alone"), (2002, " ")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(grace_dedup.deduplicate(docs, bucket_bytes)) == plain_duplicates(rows)


def test_duplicates_of_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(grace_dedup.deduplicate(odd)) == plain_duplicates(rows)
    assert grace_dedup.deduplicate(none).count() == 0


# ---- spelling variants -----------------------------------------------------------------------------------------------


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    close = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(close[w]), words.get(form[w])))
    return sorted(out)


@pytest.mark.parametrize("max_blocks", [spelling_variants.MAX_BLOCKS, 70])
def test_variants_equal_brute_force(spark, max_blocks, monkeypatch):
    """A filter that is far too small for the vocabulary changes nothing but the work."""
    monkeypatch.setattr(spelling_variants, "PER_BLOCK", 32 if max_blocks > 70 else 2000)
    rng = random.Random(8)
    letters = "abcdéeèßÿ÷×ñ"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(40)] + ["aaaaaaa", "b" * 70]
    words = list(bases)
    for b in bases:
        for _ in range(3):
            i = rng.randrange(len(b))
            words.append(rng.choice([b[:i] + b[i + 1:], b[:i] + rng.choice(letters) + b[i:], b[:i] + rng.choice(letters) + b[i + 1:]]))
            b = rng.choice([b, words[-1]])
    weights = [60 if k < len(bases) else (9, 1, 1)[(k - len(bases)) % 3] for k in range(len(words))]
    rows = []
    for i in range(400):
        rows.append((i, " ".join(rng.choice([w, w.upper() if w.isascii() else w]) for w in rng.choices(words, weights, k=60))))
    rows += [(None, "aaaaaaa aaaaaaa1aaaaaaa"), (5000, None)]
    want = plain_variants(rows)
    assert len(want) > 80 and any(w[1] for w in want) and any(w[1] != w[2] for w in want if w[1])
    got = spelling_variants.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), max_blocks)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_filter_holds_every_word():
    words = [f"word{i}" for i in range(1000)] + ["é" * 100]
    by = defaultdict(int)
    for w in words:
        by[min(len(w), 64)] += 1
    held = spelling_variants.Filter.sized(by)
    held.bits = np.zeros((int(held.blocks.sum()), 8), np.uint64)
    for _, codes in spelling_variants.by_length(words):
        block, digits = held.places(codes.shape[1], spelling_variants.word_hashes(codes))
        for k in range(spelling_variants.PROBES):
            bit = held.bit(digits, k)
            np.bitwise_or.at(held.bits, (block, (bit >> np.uint64(6)).astype(int)), np.uint64(1) << (bit & np.uint64(63)))
    others = [f"ward{i:03}" for i in range(1000)]
    for names, least, most in ((words, 1, 1), (others, 0, 0.02)):
        hits = [held.may_hold(c.shape[1], spelling_variants.word_hashes(c)).mean() for _, c in spelling_variants.by_length(names)]
        assert all(least <= h <= most for h in hits)


def test_hashes_of_edits():
    codes = next(spelling_variants.by_length(["abcdéf", "zzzzzz"]))[1]
    single = lambda w: spelling_variants.word_hashes(next(spelling_variants.by_length([w]))[1])[0]
    dropped = spelling_variants.deletion_hashes(codes)
    assert [dropped[0, i] for i in range(6)] == [single("abcdéf"[:i] + "abcdéf"[i + 1:]) for i in range(6)]
    swapped = spelling_variants.replacement_hashes(codes)
    at = int(np.nonzero(spelling_variants.ALPHABET == ord("ü"))[0][0])
    assert [swapped[0, i, at] for i in range(6)] == [single("abcdéf"[:i] + "ü" + "abcdéf"[i + 1:]) for i in range(6)]


def test_variants_of_odd_rows(odd, none, documents):
    for docs in (odd, documents):
        got = spelling_variants.variants(docs)
        assert sorted(tuple(r) for r in got.collect()) == plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert spelling_variants.variants(none).count() == 0


# ---- source divergence -----------------------------------------------------------------------------------------------


def plain_audit(rows):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= 10)
        own = sorted(s for l, s in groups if l == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10 ** 9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in own}
        whole = Counter()
        for s in own:
            whole.update(counts[lang, s])
        q = shares(whole)
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(gap(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 10)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def test_radix_order():
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 1 << 63, 500, dtype=np.uint64) << np.uint64(1), rng.integers(0, 4, 500).astype(np.uint64)]
    words[0][:250] = words[0][250:]
    assert source_divergence.radix_order(words).tolist() == np.lexsort((words[1], words[0])).tolist()


@pytest.mark.parametrize("text", ["", "abc", "AbC déjà-vu 東京 x1y", "a" * 8 + " " + "b" * 16 + " " + "c" * 17 + " " + "c" * 17 + " " + "d" * 300, "1 2 3"])
def test_terms_of_a_text(text):
    got = Counter()
    for _, terms, n, docs in source_divergence.counted_terms(text.encode() + b" ", np.zeros(1, np.int64), np.zeros(1, np.int64)):
        for t, k, d in zip(terms, n, docs):
            got[t.decode()] += int(k)
            assert d == 1
    assert got == Counter(re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text))


@pytest.mark.parametrize("cell, sources, piece", [(source_divergence.CELL, 32, 4_000_000), (40, 3, 60)])
def test_audit_equals_brute_force(spark, monkeypatch, cell, sources, piece):
    """Small cells force blocks of terms and of sources, small slices force texts that are counted in parts."""
    for name, value in (("CELL", cell), ("SOURCES", sources), ("SLICE", piece)):
        monkeypatch.setattr(source_divergence, name, value)
    rng = random.Random(6)
    vocabulary = ["Wort", "mot", "überlang" * 3, "東京都", "x", "sixteen_bytes", "abcdefghijklmnop", "abcdefghijklmnopq"] + [f"term{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(400):
        source = f"s{min(rng.randrange(14), rng.randrange(14))}"
        known = vocabulary[:8 + int(source[1:])]
        rows.append((i, " ".join(rng.choices(known, k=rng.randint(0, 25))), rng.choice(["en", "de"]), source))
    rows += [(900, None, "en", "silent"), (901, "only here", None, None), (902, "b", "xx", "one"), (903, "b", "xx", "two")]
    got = source_divergence.audit(spark.createDataFrame(rows, DOCS).repartition(6))
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows)


def test_audit_of_odd_rows(odd, none, documents):
    for docs in (odd, documents):
        rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
        assert sorted(tuple(r) for r in source_divergence.audit(docs).collect()) == plain_audit(rows)
    assert source_divergence.audit(none).count() == 0
