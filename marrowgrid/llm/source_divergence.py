"""How far the sources of a language differ in their words: exact term counts and pairwise divergences.

Counting packs terms by length.  In the bytes of a slice of texts all terms are found at once; a term of up to eight
bytes is one 64-bit word, one of up to sixteen is two, and both kinds are put in order by a radix sort (stable
16-bit digits, last digit first) and counted as runs in numpy.  Longer terms are few and go to buckets by length, each
sorted by bytes.  A task emits counts per (language, source, term) of its slice, which Spark adds up before and after
the shuffle.

Divergences of sources are computed per block of terms and per pair of blocks of sources, so that no task holds all
terms of a language or all pairs of its sources.  A block holds only counts above zero; what pairs of sources have in
common where both counts are zero is one number per pair.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrowgrid.llm.common import slices
from marrowgrid.session import staged

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: bytes of text that are counted at once; a longer text is counted in blocks of that size
SLICE = 4_000_000
#: counts of one cell (a block of terms by a block of sources), sources of a block
CELL, SOURCES = 200_000, 32

#: bytes of terms, lower-cased; 0 elsewhere
_TERM = np.zeros(256, np.uint8)
_TERM[0x80:] = np.arange(0x80, 0x100)
_TERM[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_TERM[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
#: keeps the first bytes of a big-endian word
_FIRST = np.array([0] + [(1 << 64) - (1 << 64 - 8 * k) for k in range(1, 9)], np.uint64)


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Order of rows by unsigned words, the first word most significant; rows of equal words keep their order."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(words: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, start of each run of equal words, its length and its number of documents."""
    order = radix_order(words)
    new = np.ones(len(order), bool)
    for i, word in enumerate(words):
        sorted_ = word[order]
        same = sorted_[1:] == sorted_[:-1]
        new[1:] = ~same if i == 0 else new[1:] | ~same
    starts = np.nonzero(new)[0]
    ends = np.append(starts[1:], len(order))
    # rows of a run are still in document order
    other = new.copy()
    other[1:] |= doc[order][1:] != doc[order][:-1]
    seen = np.append(0, np.cumsum(other))
    return order, starts, ends - starts, seen[ends] - seen[starts]


def counted_terms(data: bytes, doc_starts: np.ndarray, groups: np.ndarray):
    """Arrays ``(group, term, n, docs)`` of texts that follow one another in ``data``, each with a byte after it.

    ``doc_starts`` says where each text begins and ``groups`` to which group it counts.
    """
    # a word may be read at any byte, and the second one eight further on
    padded = np.zeros(len(data) + 24, np.uint8)
    padded[:len(data)] = _TERM[np.frombuffer(data, np.uint8)]
    inside = padded != 0
    edges = np.nonzero(inside[1:] != inside[:-1])[0] + 1
    if inside[0]:
        edges = np.append(0, edges)
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return
    lengths = ends - starts
    doc = np.searchsorted(doc_starts, starts, "right") - 1
    at = np.ndarray((len(padded) - 8,), ">u8", padded.data, strides=(1,))
    for low, high, n_words in ((0, 8, 1), (8, 16, 2)):
        own = np.nonzero((lengths > low) & (lengths <= high))[0]
        if not len(own):
            continue
        words = [at[starts[own] + 8 * i].astype(np.uint64) & _FIRST[np.clip(lengths[own] - 8 * i, 0, 8)] for i in range(n_words)]
        order, first, n, docs = _runs([groups[doc[own]].astype(np.uint64), *words], doc[own])
        chosen = order[first]
        packed = np.stack([w[chosen] for w in words], 1).astype(">u8").view(f"S{8 * n_words}").ravel()
        yield groups[doc[own][chosen]], packed.tolist(), n, docs
    long = np.nonzero(lengths > 16)[0]
    whole = padded.tobytes() if len(long) else b""
    for bits in np.unique([int(x).bit_length() for x in lengths[long]]) if len(long) else ():
        bucket = [i for i in long if int(lengths[i]).bit_length() == bits]
        rows = sorted((int(groups[doc[i]]), whole[starts[i]:ends[i]], int(doc[i])) for i in bucket)
        found: dict = {}
        for k, (group, term, number) in enumerate(rows):
            run = found.setdefault((group, term), [0, 0])
            run[0] += 1
            run[1] += k == 0 or rows[k - 1] != (group, term, number)
        yield (np.array([g for g, _ in found]), [t for _, t in found], np.array([v[0] for v in found.values()]),
               np.array([v[1] for v in found.values()]))


def _blocks(data: bytes, limit: int):
    """Parts of a text of about ``limit`` bytes that cut no term."""
    at = 0
    while at < len(data):
        end = min(len(data), at + limit)
        while end < len(data) and _TERM[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def _emit(batches):
    def made(keys: list, group, terms, n, docs) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "lang": pa.array([keys[g][0] for g in group], pa.string()), "source": pa.array([keys[g][1] for g in group], pa.string()),
            "term": pa.array([t.decode("utf-8", "replace") for t in terms], pa.string()), "n": pa.array(n, pa.int64()),
            "docs": pa.array(docs, pa.int64())})

    for batch in batches:
        for part in slices(batch, limit=SLICE):
            texts = [t or b"" for t in part["text"].to_pylist()]
            names = list(zip(part["lang"].to_pylist(), part["source"].to_pylist()))
            if len(texts) == 1 and len(texts[0]) > SLICE:
                total: Counter = Counter()
                for block in _blocks(texts[0], SLICE):
                    for _, terms, n, _ in counted_terms(block + b" ", np.zeros(1, np.int64), np.zeros(1, np.int64)):
                        for term, k in zip(terms, n.tolist()):
                            total[term] += k
                if total:
                    yield made(names, np.zeros(len(total), np.int64), list(total), list(total.values()), np.ones(len(total), np.int64))
                continue
            keys = list(dict.fromkeys(names))
            number = {k: i for i, k in enumerate(keys)}
            sizes = np.array([len(t) + 1 for t in texts], np.int64)
            groups = np.array([number[k] for k in names], np.int64)
            for found in counted_terms(b" ".join(texts) + b" ", np.cumsum(sizes) - sizes, groups):
                yield made(keys, *found)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term of every group."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    given = docs.select(*named, F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(_emit, "lang string, source string, term string, n long, docs long") \
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _whole(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(38,0)")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)); decimals, since the product outgrows a long."""
    scaled = ((_whole(count) + 2) * SCALE).cast("decimal(38,0)")
    whole = (_whole(total) + 2 * _whole(kept)).cast("decimal(38,0)")
    return F.when(kept > 0, F.call_function("div", scaled, F.nullif(whole, F.lit(0))) + 1).otherwise(F.lit(0)).cast("long")


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are below 2^30, so a long holds the square."""
    return F.call_function("div", (p - q) * (p - q), F.nullif(p + q, F.lit(0)))


def _cell_sums(table: pa.Table) -> pa.Table:
    """Sums of a cell over its terms, for each pair of one source of the left and one of the right block.

    A sum holds what the terms at hand add to a language in which all counts of the pair are zero.
    """
    side, term, p, p0 = (table[c].to_numpy() for c in ("side", "term_no", "p", "p0"))
    source = table["source"].to_numpy(zero_copy_only=False)
    lang = table["lang"][0].as_py()
    same = table["same"][0].as_py()
    counted = term >= 0
    terms = np.unique(term[counted])
    width = len(terms)
    matrices, names, zeros = [], [], []
    for s in (0,) if same else (0, 1):
        own = side == s
        listed, first, row = np.unique(source[own], return_index=True, return_inverse=True)
        zero = p0[own][first]
        m = np.repeat(zero[:, None], width, 1)
        some = counted[own]
        m[row[some], np.searchsorted(terms, term[own][some])] = p[own][some]
        matrices.append(m)
        names.append(listed)
        zeros.append(zero)
    out = {"lang": [], "a": [], "b": [], "value": []}
    right, right_names, right_zero = matrices[-1], names[-1], zeros[-1]
    for i, name in enumerate(names[0]):
        at = i + 1 if same else 0
        if at >= len(right_names):
            continue
        d = right[at:] - matrices[0][i]
        value = (d * d // (right[at:] + matrices[0][i])).sum(1)
        z = right_zero[at:] - zeros[0][i]
        value -= width * (z * z // (right_zero[at:] + zeros[0][i]))
        for other, v in zip(right_names[at:], value):
            out["a"].append(name)
            out["b"].append(other)
            out["value"].append(int(v))
    out["lang"] = [lang] * len(out["a"])
    return pa.table(out, pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())]))


def pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value`` of pairs of sources in blocks of terms; what has no count at all adds nothing.

    ``counts``: ``lang, source, term_no, p`` of counts above zero; ``groups``: ``lang, source, p0, kept``.
    """
    # so many blocks of terms that a block of sources and one of terms make a cell
    spread = groups.where("kept > 0").groupBy("lang").agg(
        F.ceil(F.count("*") / SOURCES).alias("source_blocks"), F.ceil(F.max("kept") * SOURCES / F.lit(CELL)).alias("term_blocks"))
    placed = groups.join(spread, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("source_blocks")))
    rows = counts.join(placed, ["lang", "source"]).withColumn("part", F.pmod("term_no", "term_blocks"))
    # every source takes part in every block of terms, also without a count there
    every = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1))).select(
        "*", F.lit(-1).cast("long").alias("term_no"), F.col("p0").alias("p"))
    # a row is needed in the cells of its own block with every block
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("source_blocks") - 1)).alias("other")
    given = ["lang", "source", "term_no", "p", "p0", "part", "block"]
    dealt = rows.select(*given, "source_blocks").unionByName(every.select(*given, "source_blocks")).select(*given, other).select(
        "lang", "source", "term_no", "p", "p0", "part", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        (F.col("block") == F.col("other")).alias("same"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"))
    return dealt.groupBy("lang", "part", "low", "high").applyInArrow(_cell_sums, "lang string, a string, b string, value long") \
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: divergence from every other source, and the ten most telling terms.

    Null text, language and source are empty.  Equal values rank by item.  Repeated rows are documents of their own,
    extra columns are ignored, a group without terms takes part with its other sources, a language without kept terms
    has divergence 0, and an empty table gives no rows.
    """
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    counts = staged(term_counts(docs), "term_counts")
    known = staged(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
                   .where(F.col("docs") >= MIN_DOCS).drop("docs").withColumn("term_no", F.monotonically_increasing_id()), "kept_terms")
    held = staged(counts.select("lang", "source", "term", "n").join(known, ["lang", "term"]), "kept_counts")
    langs = known.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = staged(docs.select(*named).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("kept", zero).alias("kept"),
        F.coalesce("lang_total", zero).alias("lang_total"))
        .withColumn("p0", _share(zero, F.col("total"), F.col("kept"))), "groups")
    shares = staged(held.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "term_no", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")), "shares")

    # pairs: what all terms would give with no count at all, and the difference that the counted terms make
    left = groups.select("lang", "source", "p0", "kept")
    right = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    sums = pair_sums(shares, left)
    both = sums.select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
        .alias("p"), "value").select("lang", "p.*", F.col("value").alias("more"))
    pairs = left.join(right, "lang").where("source <> item").join(both, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        F.when(F.col("kept") > 0, F.col("kept") * _gap(F.col("p0"), F.col("q0")) + F.coalesce("more", zero)).otherwise(zero).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value")) \
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.unionByName(terms)


#: The contract's rows in SQL, with all counts (zeros included) written out.
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
terms AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM terms GROUP BY ALL HAVING count(DISTINCT k) >= 10),
own AS (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
filled AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
shared AS (
  SELECT lang, source, term, n,
         CAST(1 + (1000000000 * (CAST(n AS HUGEINT) + 2)) // (sum(n) OVER w + 2 * count(*) OVER w) AS BIGINT) AS p
  FROM filled WINDOW w AS (PARTITION BY lang, source)),
whole AS (
  SELECT lang, term, CAST(1 + (1000000000 * (CAST(n AS HUGEINT) + 2)) // (sum(n) OVER w + 2 * count(*) OVER w) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM filled GROUP BY ALL) WINDOW w AS (PARTITION BY lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM shared a JOIN shared b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
all_pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(p.value, 0) AS value
  FROM groups g JOIN groups h ON h.lang = g.lang AND h.source <> g.source
  LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source),
told AS (
  SELECT s.lang, s.source, s.term AS item, CAST((s.p - w.q) * (s.p - w.q) // (s.p + w.q) AS BIGINT) AS value
  FROM shared s JOIN whole w ON w.lang = s.lang AND w.term = s.term WHERE s.n > 0 AND s.p > w.q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM all_pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM told)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
