"""Spelling variants: Bloom-guided neighbourhoods of a vocabulary.

Words are counted over all documents.  A blocked Bloom filter, in shards by word length, is built from the whole
vocabulary and sent to the tasks; its size is bounded by ``MAX_BLOCKS`` whatever the vocabulary.  Each task then
generates the edits of its words and probes the filter.  Only edits that the filter cannot rule out become rows and
meet the vocabulary in a join, which removes false positives.  A vocabulary too large for the filter's bound makes more
false positives and a larger join, but the same result.

Edits are never built as strings before they are positive: a word is a row of a code matrix, its hash is a polynomial,
and the hashes of all its deletions and replacements follow from prefix sums.  Insertions need no probes, since a word
that another one reaches by an insertion reaches that one by a deletion.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrowgrid.llm.common import byte_blocks, slices
from marrowgrid.session import staged

MIN_LENGTH, MIN_COUNT, EVERY, FACTOR = 6, 5, 199, 5
#: words that a task counts before it hands them on
COUNTED = 200_000
#: 512-bit blocks of all shards together (64 MB)
MAX_BLOCKS = 1 << 20
#: words per block (16 bits a word) and probes per word within its block
PER_BLOCK, PROBES = 32, 6
#: numbers of one probe matrix
PROBED = 1 << 21
#: lengths from here on share a shard
LAST_SHARD = 64
MAX_ROUNDS = 40

#: what words are made of once A-Z is lower-cased
ALPHABET = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint64)
_RUN = re.compile(f"[a-zÀ-ÿ]{{{MIN_LENGTH},}}")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def words_of(doc_id: int | None, data: bytes) -> Counter:
    """Words of at least ``MIN_LENGTH`` code points, after the deletions that the contract plants."""
    out: Counter = Counter()
    name = b"" if doc_id is None else str(doc_id).encode()
    for block in byte_blocks(data.lower()):  # lowers A-Z only
        for run, n in Counter(_RUN.findall(block.decode("utf-8", "surrogatepass"))).items():
            h = zlib.crc32(name + b":" + run.encode())
            if h % EVERY == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
                if len(run) < MIN_LENGTH:
                    continue
            out[run] += n
    return out


def _counted(batches):
    total: Counter = Counter()

    def flush():
        return pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(total.values(), pa.int64())})

    for batch in batches:
        for part in slices(batch):
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                total.update(words_of(doc_id, text or b""))
                if len(total) > COUNTED:
                    yield flush()
                    total.clear()
    if total:
        yield flush()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of the words that occur ``MIN_COUNT`` times or more."""
    given = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# ---------------------------------------------------------------------------------------------------------------------
# hashes of words and of their edits
# ---------------------------------------------------------------------------------------------------------------------


def by_length(words: list[str], limit: int = 0):
    """Code matrices of words of equal length, with the words' positions; at most ``limit`` words each."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths):
        chosen = np.nonzero(lengths == length)[0]
        step = max(1, limit // (int(length) * (len(ALPHABET) + 1))) if limit else len(chosen)
        for at in range(0, len(chosen), step):
            part = chosen[at:at + step]
            joined = "".join(words[i] for i in part).encode("utf-32-le", "surrogatepass")
            yield part, np.frombuffer(joined, "<u4").reshape(len(part), int(length)).astype(np.uint64)


def _powers(length: int) -> np.ndarray:
    out = np.full(length + 1, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial in the code points, modulo 2^64, one per row."""
    return (codes * _powers(codes.shape[1])[:-1]).sum(1, dtype=np.uint64)


def deletion_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of each row without each of its code points."""
    parts = codes * _powers(codes.shape[1])[:-1]
    before = np.cumsum(parts, axis=1, dtype=np.uint64)
    whole = before[:, -1:]
    return (before - parts) + (whole - before) * np.uint64(_INVERSE)


def replacement_hashes(codes: np.ndarray, start: int = 0, end: int | None = None) -> np.ndarray:
    """Hash of each row with each of its code points replaced by each letter (its own included).

    With a range only code points in it are replaced.
    """
    powers = _powers(codes.shape[1])[:-1][start:end]
    rest = word_hashes(codes)[:, None] - codes[:, start:end] * powers
    return rest[:, :, None] + powers[None, :, None] * ALPHABET[None, None, :]


class Filter:
    """Blocked Bloom filter with a range of blocks for each length."""

    def __init__(self, first: np.ndarray, blocks: np.ndarray, bits: np.ndarray):
        self.first, self.blocks, self.bits = first, blocks, bits

    @staticmethod
    def sized(counts: dict[int, int], max_blocks: int = MAX_BLOCKS) -> Filter:
        """Empty filter for so many words of each shard."""
        wanted = np.zeros(LAST_SHARD + 1, np.int64)
        for length, n in counts.items():
            wanted[length] = -(-n // PER_BLOCK)
        if wanted.sum() > max_blocks:
            wanted = np.where(wanted > 0, np.maximum(1, wanted * (max_blocks - LAST_SHARD) // wanted.sum()), 0)
        return Filter(np.cumsum(wanted) - wanted, wanted, np.zeros((0, 8), np.uint64))

    def places(self, length: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block of each hash, and a mixed hash whose digits are its bits there."""
        shard = min(length, LAST_SHARD)
        mixed = hashes ^ (hashes >> np.uint64(32))
        mixed = mixed * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        mixed = mixed * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(32)
        block = ((mixed >> np.uint64(32)) * np.uint64(self.blocks[shard])) >> np.uint64(32)
        return block.astype(np.int64) + self.first[shard], mixed * np.uint64(0x9FB21C651E98DF25)

    @staticmethod
    def bit(digits: np.ndarray, probe: int) -> np.ndarray:
        return (digits >> np.uint64(64 - 9 * (probe + 1))) & np.uint64(511)

    def may_hold(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """False where no word of that length has the hash."""
        if not self.blocks[min(length, LAST_SHARD)]:
            return np.zeros(hashes.shape, bool)
        flat = hashes.ravel()
        block, digits = self.places(length, flat)
        alive = np.arange(len(flat))
        for probe in range(PROBES):
            bit = self.bit(digits, probe)
            held = (self.bits[block, (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)
            keep = held.astype(bool)
            alive, block, digits = alive[keep], block[keep], digits[keep]
        out = np.zeros(len(flat), bool)
        out[alive] = True
        return out.reshape(hashes.shape)


def build_filter(words: DataFrame, max_blocks: int = MAX_BLOCKS) -> Filter:
    """Filter of all ``word``: tasks set bits, equal blocks are merged in Spark, blocks (and no words) come back."""
    shard = F.least(F.length("word"), F.lit(LAST_SHARD))
    counts = {r.shard: r.n for r in words.groupBy(shard.alias("shard")).agg(F.count("*").alias("n")).collect()}
    made = Filter.sized(counts, max_blocks)

    def bits(batches):
        for batch in batches:
            blocks, where = [], []
            for _, codes in by_length(batch["word"].to_pylist()):
                block, digits = made.places(codes.shape[1], word_hashes(codes))
                for probe in range(PROBES):
                    blocks.append(block)
                    where.append(made.bit(digits, probe))
            if not blocks:
                continue
            block, bit = np.concatenate(blocks), np.concatenate(where)
            own, row = np.unique(block, return_inverse=True)
            out = np.zeros((len(own), 8), np.uint64)
            np.bitwise_or.at(out, (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
            yield pa.RecordBatch.from_pydict({"block": own} | {f"w{i}": out[:, i].view(np.int64) for i in range(8)})

    columns = [f"w{i}" for i in range(8)]
    found = words.select("word").mapInArrow(bits, "block long, " + ", ".join(f"{c} long" for c in columns)) \
        .groupBy("block").agg(*(F.bit_or(c).alias(c) for c in columns)).toArrow()
    held = np.zeros((int(made.blocks.sum()), 8), np.uint64)
    at = found["block"].to_numpy()
    for i, c in enumerate(columns):
        held[at, i] = found[c].to_numpy().view(np.uint64)
    made.bits = held
    return made


def edits(words: list[str], held: Filter):
    """(position of the word, edit, whether it is a deletion) of every edit that the filter cannot rule out."""
    for part, codes in by_length(words, PROBED):
        length = codes.shape[1]
        # within a run of equal letters every deletion leaves the same text; the last one stands for all
        ends = np.ones(codes.shape, bool)
        ends[:, :-1] = codes[:, 1:] != codes[:, :-1]
        for row, at in zip(*np.nonzero(held.may_hold(length - 1, deletion_hashes(codes)) & ends)):
            word = words[part[row]]
            yield part[row], word[:at] + word[at + 1:], True
        step = max(1, PROBED // (len(part) * len(ALPHABET)))
        for start in range(0, length, step):
            own = codes[:, start:start + step, None] == ALPHABET[None, None, :]
            maybe = held.may_hold(length, replacement_hashes(codes, start, start + step)) & ~own
            for row, at, letter in zip(*np.nonzero(maybe)):
                word, place = words[part[row]], start + at
                yield part[row], word[:place] + chr(int(ALPHABET[letter])) + word[place + 1:], False


def near_pairs(words: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``word, near, near_n``: both directions of every pair of words one edit apart."""
    made = build_filter(words, max_blocks)
    sent = words.sparkSession.sparkContext.broadcast((made.first, made.blocks, made.bits))

    def probe(batches):
        held = Filter(*sent.value)
        for batch in batches:
            given, counts = batch["word"].to_pylist(), batch["n"].to_numpy()
            found = list(edits(given, held))
            at = np.array([f[0] for f in found], np.int64)
            yield pa.RecordBatch.from_pydict({
                "word": pa.array([given[i] for i in at], pa.string()), "n": pa.array(counts[at] if len(at) else [], pa.int64()),
                "edit": pa.array([f[1] for f in found], pa.string()), "deleted": pa.array([f[2] for f in found], pa.bool_())})

    positive = words.select("word", "n").mapInArrow(probe, "word string, n long, edit string, deleted boolean")
    met = positive.join(words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")
    # a deletion is found from the longer word only, a replacement from both
    back = F.struct(F.col("edit").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    there = F.struct("word", F.col("edit").alias("near"), F.col("edit_n").alias("near_n"))
    return met.select(F.explode(F.when(F.col("deleted"), F.array(there, back)).otherwise(F.array(there))).alias("p")).select("p.*")


def follow(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form: the last word that is reached.

    Each round doubles the steps.  A form occurs five times as often as its word, so chains are short and end.
    """
    steps = staged(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(MAX_ROUNDS):
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = staged(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = further.select("word", "root")
        if further.where("moved").isEmpty():
            return steps
    raise RuntimeError(f"forms still lead on after {MAX_ROUNDS} rounds")


def variants(docs: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the vocabulary.

    ``form`` is the near word of largest count (of equal ones the first in code-point order) if that count is at least
    ``FACTOR`` times the word's own, else null.  Null texts have no words, a null id counts as an empty name, repeated
    rows count again, and extra columns are ignored.  An empty table, or one without frequent words, gives no rows.
    """
    words = staged(vocabulary(docs), "vocabulary")
    pairs = near_pairs(words, max_blocks)
    best = pairs.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    told = staged(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.less") >= FACTOR * F.col("n"), F.col("best.form")).alias("form"),
        F.when(-F.col("best.less") >= FACTOR * F.col("n"), -F.col("best.less")).alias("form_n")), "forms")
    roots = follow(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The contract's rows in SQL: crc32 as a table-driven fold over the bytes of ``<doc_id>:<run>``, near words by the
#: texts that deletions leave.
SQL = f"""
WITH RECURSIVE crc_bits AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS steps FROM crc_bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
counted AS (
  SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named
  FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(named, ''), lambda x: CASE WHEN unicode(x) < 128
      THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)] END))),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS h
  FROM counted, crc),
edited AS (
  SELECT CASE WHEN h % {EVERY} = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2)
         ELSE run END AS word, n FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
gaps AS (
  SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT g.word AS word, w.word AS near, w.n AS near_n FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS top, first(near ORDER BY near_n DESC, near) AS form FROM pairs GROUP BY word),
told AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= {FACTOR} * w.n THEN b.form END AS form,
         CASE WHEN b.top >= {FACTOR} * w.n THEN b.top END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
steps AS (
  SELECT word, form, word AS root, form AS next, 0 AS k FROM told
  UNION ALL
  SELECT s.word, s.form, s.next, t.form, s.k + 1 FROM steps s JOIN told t ON t.word = s.next)
SELECT t.word, t.form, s.root, t.n, t.n_near, t.form_n
FROM told t JOIN steps s ON s.word = t.word AND s.next IS NULL
"""
