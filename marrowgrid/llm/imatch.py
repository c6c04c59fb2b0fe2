"""I-Match fingerprints with randomised lexicons, in DataFrame functions only.

Terms (runs of letters and digits, lower case) are kept if their inverse document frequency lies in a band: they occur
in at least two documents and in at most ``MAX_SHARE`` of them.  From the lexicon of such terms several random subsets
are drawn by hash; for each, the distinct terms of a text that lie in it are sorted and hashed together.  Texts that
share most terms agree in many subsets, others in none.

A subset that is good for a short text holds too many terms of a long one, so subsets are drawn at levels: level ``l``
draws from the terms whose hash ends in ``l`` zero bits, and a text uses the level of its length and the next one, so
that neighbours in length share a level.  A hash of all its terms comes first; it is the classic fingerprint and tells
apart texts without a term in the band.

Scale: document frequencies are one aggregation with map-side combining; from then on a text is some twenty hashes, and
only those meet the lexicon, in a join on the term.  The next document by id comes from windows over ranges of ids, so
no task sorts the table; each range's first row is also dealt to the range above it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrowgrid.session import staged

#: fixed band: terms of fewer documents, or of a larger share of them, are left out
MIN_DOCS = 2
MAX_SHARE = 0.05
#: random subsets per level, and the share of the lexicon in each
SUBSETS = 48
SUBSET_ONE_IN = 16
#: characters per level-0 text; each doubling is one level
LEVEL_CHARS = 192
#: rows of a range of ids, and the most ranges
RANGE_ROWS = 4000
MAX_RANGES = 100_000
EMPTY = "----"


def term_hashes(text: Column) -> Column:
    """Distinct hashes of the terms of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.array_distinct(F.transform(words, lambda t: F.xxhash64(t)))


def level_of(n_chars: Column) -> Column:
    """0 up to twice ``LEVEL_CHARS`` characters, one more for each doubling."""
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(n_chars, F.lit(1)) / LEVEL_CHARS))).cast("int")


def at_level(hashes: Column, level: Column) -> Column:
    """Hashes that end in ``level`` zero bits."""
    return F.filter(hashes, lambda h: F.pmod(h, F.pow(F.lit(2.0), level).cast("long")) == 0)


def full_hash(hashes: Column) -> Column:
    """Hash of all terms, whatever their frequency."""
    return F.lower(F.lpad(F.hex(F.xxhash64(F.array_sort(hashes))), 16, "0"))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_id, next_text``: the next row by descending id; after the last comes the first.

    Ids are cut into ranges of about ``RANGE_ROWS`` rows (ids need not be dense, but should not cluster: a crowded
    range is one task's window, which spills).  Rows without id come last; rows of equal id follow by text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, low, high = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        low = high = 0
    ranges = min(max(1, math.ceil(n / RANGE_ROWS)), MAX_RANGES)
    width = (high - low + 1) // ranges + 1
    bucket = F.coalesce(F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)), F.lit(0)).cast("long")
    rows = rows.withColumn("bucket", bucket)
    # the first row of each range: at most MAX_RANGES of them, by the choice of the width
    firsts = rows.groupBy("bucket").agg(F.max("doc_id").alias("first_id"))
    above = Window.orderBy(F.col("bucket"))
    firsts = firsts.select("bucket", "first_id", F.lead("bucket").over(above).alias("above")) \
        .withColumn("above", F.coalesce("above", F.lit(None).cast("long")))
    lowest = firsts.agg(F.min("bucket")).first()[0]
    firsts = F.broadcast(firsts.select(
        F.col("bucket").alias("own"), "first_id", F.coalesce("above", F.lit(lowest).cast("long")).alias("dealt")))
    lent = rows.join(firsts, (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first_id"))) \
        .select("doc_id", "text", F.col("dealt").alias("bucket"), F.lit(True).alias("lent"))
    order = Window.partitionBy("bucket").orderBy(F.col("lent"), F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return rows.withColumn("lent", F.lit(False)).unionByName(lent).select(
        "doc_id", "text", "lent", F.lead("doc_id").over(order).alias("next_id"), F.lead("text").over(order).alias("next_text")) \
        .where(~F.col("lent")).drop("lent")


def lexicon(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Hashes ``term`` of the band, from all documents."""
    terms = docs.select(F.explode(term_hashes(F.coalesce("text", F.lit("")))).alias("term"))
    n = docs.count()
    return terms.groupBy("term").agg(F.count("*").alias("df")) \
        .where((F.col("df") >= min_docs) & (F.col("df") <= max(min_docs, max_share * n))).select("term")


def subset_hashes(terms: Column) -> Column:
    """16 bits of hash per random subset of the lexicon, -1 where the sorted ``terms`` have none in the subset."""

    def one(number: Column) -> Column:
        own = F.filter(terms, lambda t: F.pmod(F.xxhash64(t, number), F.lit(SUBSET_ONE_IN)) == 0)
        return F.when(F.size(own) > 0, F.xxhash64(own).bitwiseAND(F.lit(0xFFFF)).cast("int")).otherwise(-1)

    return F.transform(F.sequence(F.lit(1), F.lit(SUBSETS)), one)


def as_text(full: Column, level: Column, here: Column, above: Column) -> Column:
    """``full hash : level : hashes at the level : hashes at the next level``, as text."""
    digits = lambda codes: F.array_join(F.transform(codes, lambda c: F.when(
        c < 0, EMPTY).otherwise(F.lower(F.lpad(F.hex(c), 4, "0")))), "")
    return F.concat_ws(":", full, F.lpad(level.cast("string"), 2, "0"), digits(here), digits(above))


def _agreement(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets in which either text has terms."""
    seen = F.filter(F.zip_with(a, b, lambda x, y: F.when((x >= 0) | (y >= 0), (x == y).cast("double"))), lambda v: v.isNotNull())
    total = F.aggregate(seen, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(seen) > 0, total / F.size(seen)).otherwise(0.0)


def likeness(a: str, b: str) -> Column:
    """0 to 1: 1 for equal term sets, else the agreement on the level both have, 0 if they have none.

    ``a`` and ``b`` name structs of ``full, level, here, above``.
    """
    x, y = F.col(a), F.col(b)
    return F.when(x["full"] == y["full"], 1.0) \
        .when(x["level"] == y["level"], _agreement(x["here"], y["here"])) \
        .when(x["level"] == y["level"] + 1, _agreement(x["here"], y["above"])) \
        .when(y["level"] == x["level"] + 1, _agreement(x["above"], y["here"])).otherwise(0.0)


def _sketches(rows: DataFrame, texts: dict[str, str], terms_of: DataFrame) -> DataFrame:
    """Replace each text column of ``texts`` by a struct (its value names it) of ``full, level, here, above``.

    ``rows`` has ``key``, equal only for rows whose texts are equal.  Sorted term lists are made below the join, so
    that they are not made again for every subset.
    """
    out = rows
    for text, name in texts.items():
        out = out.withColumn(f"{name}_level", level_of(F.length(text))).withColumn(f"{name}_hashes", term_hashes(F.col(text))).drop(text)
    for name in texts.values():
        hashes, level = F.col(f"{name}_hashes"), F.col(f"{name}_level")
        out = out.withColumn(f"{name}_full", full_hash(hashes)).withColumn(f"{name}_terms", at_level(hashes, level)).drop(f"{name}_hashes")
    base = staged(out, "imatch")

    def marked(name: str) -> Column:
        step = F.pow(F.lit(2.0), F.col(f"{name}_level") + 1).cast("long")
        return F.transform(f"{name}_terms", lambda t: F.struct(
            t.alias("term"), F.lit(name).alias("of"), (F.pmod(t, step) == 0).alias("deep")))

    asked = base.select("key", F.explode(F.concat(*map(marked, texts.values()))).alias("t")).select("key", "t.*")
    met = asked.join(terms_of, "term").groupBy("key").agg(*[
        F.array_sort(F.collect_set(F.when(chosen, F.col("term")))).alias(f"{name}_{part}")
        for name in texts.values()
        for part, chosen in (("here", F.col("of") == name), ("above", (F.col("of") == name) & F.col("deep")))])
    none = F.array().cast("array<long>")
    found = base.join(met, "key", "left")
    return found.select(*rows.drop(*texts).columns, *[F.struct(
        F.col(f"{name}_full").alias("full"), F.col(f"{name}_level").alias("level"),
        *[subset_hashes(F.coalesce(f"{name}_{part}", none)).alias(part) for part in ("here", "above")]).alias(name)
        for name in texts.values()])


def _printed(name: str) -> Column:
    c = F.col(name)
    return as_text(c["full"], c["level"], c["here"], c["above"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every whole text against the lexicon of ``docs`` itself; null is like empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    return _sketches(rows, {"text": "own"}, lexicon(docs)).select("doc_id", _printed("own").alias("fingerprint"))


def edited_and_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited form and of the next document, and how alike they are.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by the first as many of the next document
    by descending id.  Columns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.  Repeated rows come back as often as given; an empty table gives no rows.  Rows of equal id follow by
    text, longer texts are read whole, and columns beyond ``doc_id`` and ``text`` are ignored.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long")).select(
        "doc_id", "n_chars", "text", F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("next_id", "next_text").alias("next_key"),
        F.concat(F.col("text").substr(F.lit(1), (F.col("n_chars") - half).cast("int")),
                 F.col("next_text").substr(F.lit(1), half)).alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited"), 256))
    found = staged(_sketches(rows, {"text": "own", "edited": "changed"}, lexicon(docs)), "imatch")
    following = found.select(F.col("key").alias("next_key"), F.col("own").alias("following")).dropDuplicates(["next_key"])
    return found.join(following, "next_key", "left").select(
        "doc_id", "n_chars", "edited_sha256", _printed("own").alias("fingerprint"), _printed("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "following").alias("near_next"))
