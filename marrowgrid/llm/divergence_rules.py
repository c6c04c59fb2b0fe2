"""Quality rules by distribution divergence.

Two histograms of a text, its character classes and its common words, are compared with references of each language by
the Jensen-Shannon divergence (base 2).  A text passes if, for some language, neither divergence exceeds its limit.
A text whose own language is not given or has too few words for a reference says nothing about being like other
languages, so only the counting rules judge it.
From each divergence the part that chance alone explains, ``(bins - 1) / (4 n ln 2)`` for ``n`` observations, is taken
off first, and a histogram of fewer than a minimum of observations is not judged, so short texts are not rejected for
being short.  Counting rules (few words, repeated windows of words) come first.

References are statistics of all documents: class counts by language, and every word that makes up at least
``MIN_SHARE`` of the words of its language.  Such heavy words are found exactly in two scans: words are counted in a
fixed number of hash buckets, then only words of buckets that reach the share are counted by name.

Scale: three scans; each task emits bounded counts that Spark sums; at most ``1 / MIN_SHARE`` words per language reach
the driver.  Nothing is shuffled per document.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrowgrid.llm.common import CLASSES, byte_blocks, class_counts, slices, utf8
from marrowgrid.session import staged

MIN_WORDS = 50
#: percent of the words that may lie in repeated three-word windows
MAX_REPEAT = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: what is stripped from a word before it is compared with common words (fixed value)
PUNCTUATION = b".,;:!?()[]{}\"'`#*$%&|<>=+-_/\\~^@"

BUCKETS = 1 << 14
MIN_SHARE = 0.004
#: words a language must have to be a reference
REFERENCE_WORDS = 1000

#: characters, and words, from which on a histogram is judged
MIN_CHARS = 200
MIN_COMMON_WORDS = 100
CLASS_LIMIT = 0.07
WORD_LIMIT = 0.05


def word_codes(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Number of each word (by first appearance) and the distinct words."""
    numbers = defaultdict(count().__next__)
    codes = [np.fromiter(map(numbers.__getitem__, block.split()), np.int64) for block in byte_blocks(data)]
    return (np.concatenate(codes) if codes else np.zeros(0, np.int64)), list(numbers)


def repeated_words(codes: np.ndarray, distinct: int, width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that are found twice or more, the first finding included."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    keys = codes[:n]
    for i in range(1, width):
        if distinct ** (i + 1) >= 1 << 62:
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * distinct + codes[i:n + i]
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    inside = np.zeros(len(codes), bool)
    places = np.nonzero(np.isin(keys, twice))[0]
    for i in range(width):
        inside[places + i] = True
    return int(inside.sum())


@dataclass
class Counts:
    """What the rules look at in one text."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    classes: np.ndarray
    common: Counter

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT * self.n_words


def measure(text: str | None) -> Counts:
    """Counts of a whole text; null is like empty."""
    text = text or ""
    data = utf8(text)
    codes, words = word_codes(data)
    lines = Counter(text.split("\n"))
    dup = sum(n - 1 for line, n in lines.items() if n > 1 and line.strip(BLANKS))
    common: Counter = Counter()
    for word, n in zip(words, np.bincount(codes, minlength=len(words)).tolist()):
        common[word.lower().strip(PUNCTUATION)] += n
    common.pop(b"", None)
    return Counts(
        len(codes), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dup,
        repeated_words(codes, len(words)), class_counts(data), common)


@dataclass
class Reference:
    """Histograms of one language: shares of character classes, shares of common words with the rest last."""

    classes: np.ndarray
    words: list[bytes]
    shares: np.ndarray


def _bucket_pass(batches):
    classes, buckets = defaultdict(lambda: np.zeros(CLASSES, np.int64)), defaultdict(lambda: np.zeros(BUCKETS, np.int64))
    for batch in batches:
        for part in slices(batch):
            for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist()):
                found = measure(text)
                if found.base_failed:
                    continue
                classes[lang] += found.classes
                places = [zlib.crc32(w) & (BUCKETS - 1) for w in found.common]
                np.add.at(buckets[lang], places, list(found.common.values()))
    for lang in classes:
        places = np.nonzero(buckets[lang])[0]
        for kind, at, n in (("class", np.arange(CLASSES), classes[lang]), ("bucket", places, buckets[lang][places])):
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(at), pa.string()), "kind": pa.array([kind] * len(at), pa.string()),
                "place": at.astype(np.int32), "n": n})


def references(docs: DataFrame) -> dict[str, Reference]:
    """References of every language of ``docs`` that has enough words; rows without language or text are left out,
    as are texts that fail the counting rules."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    sums = staged(rows.mapInArrow(_bucket_pass, "lang string, kind string, place int, n long")
                  .groupBy("lang", "kind", "place").agg(F.sum("n").alias("n")), "buckets")
    totals = sums.groupBy("lang").agg(F.sum(F.when(F.col("kind") == "bucket", F.col("n"))).alias("total")) \
        .where(F.col("total") >= REFERENCE_WORDS)
    # at most 1 / MIN_SHARE buckets and the classes of each language
    kept = sums.join(totals, "lang").where((F.col("kind") == "class") | (F.col("n") >= MIN_SHARE * F.col("total"))).toPandas()
    if not len(kept):
        return {}
    found = {lang: set(g.place) for lang, g in kept[kept.kind == "bucket"].groupby("lang")}
    wanted = rows.sparkSession.sparkContext.broadcast(found)

    def names(batches):
        counts = defaultdict(Counter)
        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist()):
                    places = wanted.value.get(lang, ())
                    measured = measure(text) if places else None
                    if places and not measured.base_failed:
                        for word, n in measured.common.items():
                            if zlib.crc32(word) & (BUCKETS - 1) in places:
                                counts[lang][word] += n
        for lang, words in counts.items():
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(words), pa.string()), "word": pa.array(list(words), pa.binary()),
                "n": pa.array(list(words.values()), pa.int64())})

    words = rows.mapInArrow(names, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")) \
        .join(totals, "lang").where(F.col("n") >= MIN_SHARE * F.col("total")).toPandas()
    out = {}
    for lang, group in kept.groupby("lang"):
        classes = np.zeros(CLASSES)
        own = group[group.kind == "class"]
        classes[own.place.to_numpy()] = own.n.to_numpy()
        common = words[words.lang == lang].sort_values("word")
        shares = common.n.to_numpy() / group.total.iloc[0]
        out[lang] = Reference(classes / max(1.0, classes.sum()), [bytes(w) for w in common.word],
                              np.append(shares, max(0.0, 1.0 - shares.sum())))
    return out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence, base 2, of each row of ``p`` and the histogram ``q``; 0 to 1."""
    m = (p + q) / 2

    def entropy(x):
        return -(x * np.log2(np.where(x > 0, x, 1.0))).sum(-1)

    return np.clip(entropy(m) - (entropy(p) + entropy(q)) / 2, 0.0, 1.0)


def _beyond_chance(value: np.ndarray, bins: int, n: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, value - (bins - 1) / (4 * np.maximum(n, 1) * math.log(2)))


def divergences(found: list[Counts], known: dict[str, Reference]) -> tuple[np.ndarray, np.ndarray]:
    """Class and word divergence of each text from each reference (in order of name), 0 where not judged."""
    classes = np.array([f.classes for f in found], float).reshape(-1, CLASSES)
    chars, words = classes.sum(1), np.array([f.common.total() for f in found], float)
    by_class, by_word = np.zeros((len(found), len(known))), np.zeros((len(found), len(known)))
    for column, lang in enumerate(sorted(known)):
        ref = known[lang]
        value = _beyond_chance(divergence(classes / np.maximum(chars, 1)[:, None], ref.classes), CLASSES, chars)
        by_class[:, column] = np.where(chars >= MIN_CHARS, value, 0.0)
        if ref.words:
            own = np.array([[f.common[w] for w in ref.words] for f in found], float).reshape(len(found), -1)
            share = np.column_stack([own, words - own.sum(1)]) / np.maximum(words, 1)[:, None]
            value = _beyond_chance(divergence(share, ref.shares), len(ref.shares), words)
            by_word[:, column] = np.where(words >= MIN_COMMON_WORDS, value, 0.0)
    return by_class, by_word


def judge(found: list[Counts], known: dict[str, Reference], langs: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each text is kept, and its divergences from the reference that it is closest to its limits with.

    A text whose ``lang`` has no reference (or is null) is judged by the counting rules alone, with divergences 0.
    """
    failed = np.array([f.base_failed for f in found], bool)
    if not known or not found:
        return ~failed, np.zeros(len(found)), np.zeros(len(found))
    by_class, by_word = divergences(found, known)
    excess = np.maximum(by_class / CLASS_LIMIT, by_word / WORD_LIMIT)
    best = excess.argmin(1)
    rows = np.arange(len(found))
    own = np.array([lang in known for lang in langs], bool)
    within = ~own | (excess[rows, best] <= 1.0)
    return ~failed & within, np.where(own, by_class[rows, best], 0.0), np.where(own, by_word[rows, best], 0.0)


def apply_rules(docs: DataFrame, known: dict[str, Reference]) -> DataFrame:
    """Counts and verdict of every whole text.

    Columns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_divergence,
    word_divergence``.  Null and empty texts have no words and fail.  Without a reference of its language only the counting
    rules count.  Repeated rows are judged as often as given, an empty table gives no rows, texts of any length are
    read whole, and columns beyond ``doc_id``, ``text`` and ``lang`` are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = [measure(t) for t in part["text"].to_pylist()]
                kept, by_class, by_word = judge(found, held.value, part["lang"].to_pylist())
                out = {"doc_id": part["doc_id"]}
                for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
                    out[name] = pa.array([getattr(f, name) for f in found], pa.int64())
                yield pa.RecordBatch.from_pydict(out | {
                    "base_failed": pa.array([f.base_failed for f in found], pa.bool_()), "kept": pa.array(kept, pa.bool_()),
                    "class_divergence": by_class, "word_divergence": by_word})

    return docs.select("doc_id", "text", "lang").mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "base_failed boolean, kept boolean, class_divergence double, word_divergence double")


def passes(docs: DataFrame, known: dict[str, Reference]) -> Column:
    """The verdict as a column of ``docs``, to filter by without sending the rows through Python."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    @F.arrow_udf("boolean")
    def kept(text: pa.Array, lang: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.RecordBatch.from_pydict({"text": text, "lang": lang})):
            out.append(judge([measure(t) for t in part["text"].to_pylist()], held.value, part["lang"].to_pylist())[0])
        return pa.array(np.concatenate(out) if out else [], pa.bool_())

    return kept("text", "lang")
