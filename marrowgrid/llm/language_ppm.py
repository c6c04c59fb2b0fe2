"""Language identification by prediction by partial matching (PPM).

Each language has a byte model of contexts up to ``ORDER`` bytes with escape method C: in a context that was followed
``n`` times by ``d`` different bytes, a byte seen ``c`` times costs ``-log2(c / (n + d))`` bits and the escape to the
next shorter context costs ``-log2(d / (n + d))`` bits; a context never seen costs nothing to leave, and below the
empty context a byte costs 8 bits.  Statistics are frozen after training (no update while scoring, no exclusion), so
the code length of a text is the sum of a cost per window of ``ORDER + 1`` bytes.  A text starts after zero bytes.

Scale: contexts are counted in the tasks and summed by Spark; the model has at most as many windows as the bounded
training sample has bytes and is broadcast.  Scoring is one scan without a shuffle; long texts are cut into
overlapping pieces, which leaves every window whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrowgrid.llm.common import SLICE_BYTES, remainder, sample_share, slices, utf8

ORDER = 4
#: rows per language, on average, that train a model; chosen by a hash of the id
TRAIN_ROWS = 1500
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def windows(data: np.ndarray) -> np.ndarray:
    """The ``ORDER + 1`` bytes that start at each place, packed into one integer."""
    n = len(data) - ORDER
    keys = np.zeros(max(n, 0), np.int64)
    for i in range(ORDER + 1):
        keys = (keys << 8) | data[i:i + n]
    return keys


def pieces(texts: list[bytes], limit: int = SLICE_BYTES):
    """Groups of (text number, bytes with ``ORDER`` bytes of context), each of about ``limit`` bytes."""
    group, held = [], 0
    for i, text in enumerate(texts):
        padded = bytes(ORDER) + text
        for at in range(0, len(text), limit):
            piece = padded[at:at + limit + ORDER]
            group.append((i, piece))
            held += len(piece)
            if held >= limit:
                yield group
                group, held = [], 0
    if group:
        yield group


def _grouped_windows(group) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the joined pieces, and the (start, end) places of each piece's own windows, alternating."""
    keys = windows(np.frombuffer(b"".join(p for _, p in group), np.uint8))
    sizes = np.array([len(p) for _, p in group], np.int64)
    starts = np.cumsum(sizes) - sizes
    return keys, np.stack([starts, starts + sizes - ORDER], 1).ravel()


def _count(batches):
    for batch in batches:
        for part in slices(batch):
            frame = part.to_pandas()
            for lang, rows in frame.groupby("lang", sort=False):
                for group in pieces([utf8(t) for t in rows["text"]]):
                    keys, places = _grouped_windows(group)
                    own = np.concatenate([keys[a:b] for a, b in places.reshape(-1, 2)])
                    found, n = np.unique(own, return_counts=True)
                    yield pa.RecordBatch.from_pydict(
                        {"lang": pa.array([lang] * len(found), pa.string()), "key": found, "n": n.astype(np.int64)})


@dataclass
class Order:
    """Sorted byte strings of one length with the bits they cost, and their contexts with the bits of an escape."""

    grams: np.ndarray
    cost: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray


class PpmModel:
    """Frozen byte statistics of several languages."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self.orders = {lang: self._orders(*counts[lang]) for lang in self.langs}
        known = [counts[lang][0] for lang in self.langs]
        self.known = np.unique(np.concatenate(known)) if known else np.zeros(0, np.int64)
        self.bits = self._bits(self.known)

    @staticmethod
    def _orders(keys: np.ndarray, n: np.ndarray) -> list[Order]:
        out = []
        for k in range(ORDER, -1, -1):
            grams, inverse = np.unique(keys & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            seen = np.bincount(inverse, n)
            contexts, owner = np.unique(grams >> 8, return_inverse=True)
            total, distinct = np.bincount(owner, seen), np.bincount(owner)
            out.append(Order(grams, -np.log2(seen / (total + distinct)[owner]), contexts,
                             -np.log2(distinct / (total + distinct))))
        return out

    def _bits(self, keys: np.ndarray) -> np.ndarray:
        """Cost of the last byte of each window, by language."""
        out = np.zeros((len(keys), len(self.langs)))
        for column, lang in enumerate(self.langs):
            open_, cost = np.ones(len(keys), bool), np.zeros(len(keys))
            for k, order in zip(range(ORDER, -1, -1), self.orders[lang]):
                gram = keys & ((1 << 8 * (k + 1)) - 1)
                at = np.minimum(np.searchsorted(order.grams, gram), len(order.grams) - 1)
                hit = open_ & (order.grams[at] == gram)
                cost[hit] += order.cost[at[hit]]
                open_ &= ~hit
                context = gram >> 8
                at = np.minimum(np.searchsorted(order.contexts, context), len(order.contexts) - 1)
                left = open_ & (order.contexts[at] == context)
                cost[left] += order.escape[at[left]]
            out[:, column] = cost + 8.0 * open_
        return out

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """As ``_bits``, by lookup where the window is known."""
        if not len(self.known):
            return self._bits(keys)
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        out, new = self.bits[at], self.known[at] != keys
        if new.any():
            out[new] = self._bits(keys[new])
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits each text takes under each language."""
        total = np.zeros((len(texts), len(self.langs)))
        for group in pieces(texts):
            keys, places = _grouped_windows(group)
            codes, distinct = pd.factorize(keys)
            cost = self.cost(distinct)
            rows = np.array([i for i, _ in group])
            cut = places[:-1] if places[-1] >= len(keys) else places
            for column in range(len(self.langs)):
                np.add.at(total[:, column], rows, np.add.reduceat(cost[codes, column], cut)[::2])
        return total


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> PpmModel:
    """Train on ``text`` and ``lang`` of the given rows.

    Rows without text or language are left out.  ``train_rows`` bounds the training sample: about so many rows of
    each language are used (all of a smaller language), whole.  An empty table gives a model without languages.
    """
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL AND text <> ''")
    share = {r["lang"]: min(1.0, train_rows / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return PpmModel({})
    shares = F.create_map(*[F.lit(x) for item in sorted(share.items()) for x in item])
    sample = rows.where(sample_share("doc_id", 2) < F.try_element_at(shares, F.col("lang")))
    found = sample.select("text", "lang").mapInArrow(_count, "lang string, key long, n long") \
        .groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    return PpmModel({lang: (g["key"].to_numpy(), g["n"].to_numpy()) for lang, g in found.groupby("lang")})


def predict(docs: DataFrame, model: PpmModel) -> DataFrame:
    """Language of every whole text: ``doc_id, lang_pred, score, bits_per_byte``.

    ``score`` is the posterior of the language with equal priors; the smaller name wins a tie.  A text that is null
    or has no letter, and every text under a model without languages, is ``und`` with score 0.  Repeated rows are
    predicted as often as given, an empty table gives no rows, and columns beyond ``doc_id`` and ``text`` are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = held.value
        for batch in batches:
            for part in slices(batch):
                texts = part["text"].to_pylist()
                known = [bool(m.langs) and t is not None and _LETTER.search(t) is not None for t in texts]
                data = [utf8(t) if k else b"" for t, k in zip(texts, known)]
                bits = m.code_lengths(data) if m.langs else np.zeros((len(texts), 1))
                best = bits.argmin(1)
                least = bits.min(1)
                share = 1.0 / np.exp2(least[:, None] - bits).sum(1)
                size = np.maximum(1, [len(d) for d in data])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part["doc_id"],
                    "lang_pred": pa.array([m.langs[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                    "score": np.where(known, share, 0.0), "bits_per_byte": np.where(known, least / size, 0.0)})

    return docs.select("doc_id", "text").mapInArrow(
        score, "doc_id long, lang_pred string, score double, bits_per_byte double")


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Learn from the documents whose id does not leave 1, predict for all; adds ``held_out``."""
    held_out = remainder("doc_id", 3) == 1
    model = fit(docs.where(~F.coalesce(held_out, F.lit(False))), train_rows)
    return predict(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")
