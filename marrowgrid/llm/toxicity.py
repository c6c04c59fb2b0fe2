"""Toxicity from subword-bag embeddings.

A word is the mean of the embeddings of its hashed character n-grams (with word edges) and of the word itself, so a
misspelling shares most vectors with the word it comes from.  A span of words is the mean of its words and goes
through a linear softmax; embeddings and softmax are trained jointly in numpy.  A label says only that some span of the
document is toxic: training starts with the span of the most telling word of each toxic document, then keeps the label
on the spans that score highest (all spans of a clean document stay clean).  A document scores by its most toxic span
and by how many of its words, and what share of them, are suspicious: syllables of clean words now and then join to
something that looks toxic, but rarely several times.  The weights of the three come from rows that the model at hand was
not trained on: the sample is cut into folds, each scored by a model of the other folds, and the last model uses all rows.

Scale: scoring is one scan without a shuffle, and as the layers are linear, a word costs one number that a task
remembers.  The labelled sample is bounded by rows and characters (documented parameters) and fitted on the driver.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrowgrid.llm.common import remainder, sample_share, slices
from marrowgrid.llm.quality_cotraining import logistic

#: rows of each label that are fitted, on average, and the characters of all of them; chosen by a hash of the id
TOXIC_ROWS = 800
CLEAN_ROWS = 1000
SAMPLE_CHARS = 8_000_000
#: parts of the sample, each scored by a model of the others to calibrate
FOLDS = 2

SPAN = 3
BUCKETS = 1 << 20
DIMENSIONS = 8
GRAMS = (3, 4, 5, 6)
ROUNDS = 3
ROUND_EPOCHS = 8
#: largest move of an entry in an epoch: embeddings, softmax weights, intercepts
RATES = (2.0, 0.03, 0.1)
#: span logit from which on a word with neutral neighbours is suspicious
SUSPICIOUS = -1.0
REMEMBERED = 300_000
_WORD = re.compile(r"[^\W_]+")


def subwords(word: str) -> list[int]:
    """Buckets of a word and its character n-grams."""
    marked = f"<{word}>"
    n, hashed = len(marked), zlib.crc32
    if marked.isascii():
        raw = marked.encode()
        own = [hashed(raw[i:i + size]) & (BUCKETS - 1) for size in GRAMS for i in range(n - size + 1)]
    else:
        own = [hashed(marked[i:i + size].encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for size in GRAMS for i in range(n - size + 1)]
    own.append(hashed(b"=" + word.encode("utf-8", "surrogatepass")) & (BUCKETS - 1))
    return own


def words_of(text: str | None):
    """Lists of lower-case words; a very long text comes in several."""
    if not text:
        return
    if len(text) < 1 << 20:
        if found := _WORD.findall(text.lower()):
            yield found
        return
    matches = (m.group() for m in _WORD.finditer(text.lower()))
    while part := list(islice(matches, 1 << 17)):
        yield part


class WordLogits(dict):
    """Word to its contribution, mean of the buckets' logits; forgets everything when full."""

    def __init__(self, buckets: np.ndarray):
        super().__init__()
        self.buckets = buckets.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        own = subwords(word)
        value = sum(map(self.buckets.__getitem__, own)) / len(own)
        if len(word) <= 64:
            self[word] = value
        return value


@dataclass
class ToxicModel:
    """Logit of each bucket, intercept; weights of the highest span, offset, weights of the suspicious words."""

    buckets: np.ndarray
    bias: float
    slope: float
    offset: float
    crowd: tuple[float, float] = (0.0, 0.0)

    def features(self, logits: WordLogits, text: str | None) -> tuple[float, float, float]:
        """Highest span logit (the intercept alone without words), logs of the number and share of suspicious words."""
        best, tail, n, suspicious = None, [], 0, 0
        least = SPAN * (SUSPICIOUS - self.bias)
        for words in words_of(text):
            own = np.array(list(map(logits.__getitem__, words)))
            n += len(own)
            suspicious += int((own > least).sum())
            values = np.append(tail, own)
            if len(values) >= SPAN:
                sums = np.cumsum(np.append(0.0, values))
                top = (sums[SPAN:] - sums[:-SPAN]).max() / SPAN
                best = top if best is None else max(best, top)
            tail = values[-(SPAN - 1):].tolist()
        if best is None:
            best = sum(tail) / len(tail) if tail else 0.0
        return best + self.bias, math.log(suspicious + 0.05), math.log((suspicious + 0.05) / (n + 20))

    def document_logit(self, logits: WordLogits, text: str | None) -> float:
        """Highest span logit; the intercept alone for a text without words."""
        return self.features(logits, text)[0]

    def probability(self, features: np.ndarray) -> np.ndarray:
        """Calibrated probability of rows of ``features``."""
        z = features.reshape(-1, 3) @ np.array([self.slope, *self.crowd]) + self.offset
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class _Bags:
    """Words and spans of the training texts as flat index arrays."""

    def __init__(self, texts: list[str | None]):
        numbers = defaultdict(count().__next__)
        tokens, sizes, owner = [], [], []
        for i, text in enumerate(texts):
            own = [numbers[w] for words in words_of(text) for w in words]
            for at in range(0, len(own), SPAN):
                sizes.append(len(own[at:at + SPAN]))
                owner.append(i)
            tokens.extend(own)
        self.tokens, self.sizes, self.owner = np.array(tokens, np.int64), np.array(sizes, np.int64), np.array(owner, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        buckets = [subwords(w) for w in numbers]
        self.word_sizes = np.array([len(b) for b in buckets], np.int64)
        self.word_starts = np.cumsum(self.word_sizes) - self.word_sizes
        #: hash buckets that occur, and the number among them of each subword
        self.used, self.buckets = np.unique(np.array([x for b in buckets for x in b], np.int64), return_inverse=True)
        self.of_word = np.repeat(np.arange(len(buckets)), self.word_sizes)
        self.of_span = np.repeat(np.arange(len(sizes)), self.sizes)


def _first_choice(bags: _Bags, labels: np.ndarray) -> np.ndarray:
    """Spans of toxic documents to start from: those whose best word has the surest excess of toxic documents.

    A subword counts by the lower bound (two standard errors) of its log odds of document frequencies, a word by its
    best subword.
    """
    words = np.unique(bags.owner[bags.of_span] * len(bags.word_sizes) + bags.tokens)
    owner, words = np.divmod(words, len(bags.word_sizes))
    df = np.zeros((2, len(bags.used)))
    for at in range(0, len(labels), 64):  # a few documents at once: every word has dozens of subwords
        block = slice(*np.searchsorted(owner, (at, at + 64)))
        pairs = np.unique(np.repeat(owner[block], bags.word_sizes[words[block]]) * len(bags.used) + _gather(bags, words[block]))
        doc, subword = np.divmod(pairs, len(bags.used))
        np.add.at(df, (labels[doc], subword), 1.0)
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])[:, None]
    odds = np.log((df + 0.5) / (n + 1))
    sure = odds[1] - odds[0] - 2 * np.sqrt(1 / (df[0] + 0.5) + 1 / (df[1] + 0.5))
    word = np.maximum.reduceat(sure[bags.buckets], bags.word_starts)
    return np.maximum.reduceat(word[bags.tokens], bags.starts)


def _gather(bags: _Bags, words: np.ndarray) -> np.ndarray:
    """Buckets of the given words, joined."""
    sizes = bags.word_sizes[words]
    ends = np.cumsum(sizes)
    return bags.buckets[np.repeat(bags.word_starts[words] - (ends - sizes), sizes) + np.arange(sizes.sum())]


def _train(bags: _Bags, labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and intercepts, by descent with momentum on all spans at once.

    A step goes with the square root of the gradient, scaled by the largest entry of its matrix: subwords that few
    spans share move less, so the chosen spans are learnt by what they have in common.  The steps of the intercepts
    shrink within a round, or models of different folds would end some steps apart.
    """
    rng = np.random.default_rng(seed)
    params = [rng.uniform(-0.05, 0.05, (len(bags.used), DIMENSIONS)), rng.uniform(-0.5, 0.5, (DIMENSIONS, 2)), np.zeros(2)]
    moments = [np.zeros_like(p) for p in params]
    toxic = labels[bags.owner] == 1
    share = 1.0 / np.bincount(bags.owner, minlength=len(labels))[bags.owner]
    n_toxic, n_clean = max(1, labels.sum()), max(1, (1 - labels).sum())

    def forward():
        word = np.add.reduceat(params[0][bags.buckets], bags.word_starts) / bags.word_sizes[:, None]
        span = np.add.reduceat(word[bags.tokens], bags.starts) / bags.sizes[:, None]
        logits = span @ params[1] + params[2]
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        return span, p / p.sum(1, keepdims=True)

    def epoch(target, weight, settled):
        span, p = forward()
        p[np.arange(len(target)), target] -= 1.0
        g = p * weight[:, None]
        d_span = g @ params[1].T / bags.sizes[:, None]
        d_embed = np.empty_like(params[0])
        for k in range(DIMENSIONS):
            d_word = np.bincount(bags.tokens, d_span[bags.of_span, k], len(bags.word_sizes)) / bags.word_sizes
            d_embed[:, k] = np.bincount(bags.buckets, d_word[bags.of_word], len(bags.used))
        for p_, m, grad, rate in zip(params, moments, (d_embed, span.T @ g, g.sum(0)), (*RATES[:2], RATES[2] * (1 - settled))):
            m *= 0.8
            m += grad
            p_ -= rate * np.sign(m) * np.sqrt(np.abs(m) / (np.abs(m).max() + 1e-12))

    merit = np.where(toxic, _first_choice(bags, labels), -np.inf)
    for round_ in range(ROUNDS):
        top = np.full(len(labels), -np.inf)
        np.maximum.at(top, bags.owner, merit)
        # toxic documents: their top spans, and all that score high; clean documents: all spans, half on the hardest
        chosen = toxic & ((merit >= top[bags.owner]) | (merit >= 0.9 if round_ else False))
        per = np.bincount(bags.owner[chosen], minlength=len(labels))
        hard = ~toxic & (merit >= top[bags.owner]) if round_ else np.zeros(len(merit), bool)
        weight = np.where(chosen, 0.5 / np.maximum(1, per[bags.owner]) / n_toxic, 0.0) \
            + np.where(toxic, 0.0, (0.25 * share + 0.25 * hard) / n_clean)
        for step in range(ROUND_EPOCHS):
            epoch(chosen.astype(int), weight, step / ROUND_EPOCHS)
        merit = forward()[1][:, 1]
    return tuple(params)


def _uncalibrated(texts: list[str], labels: np.ndarray) -> ToxicModel:
    """Model of one sample; texts without words give one without weights."""
    bags, buckets = _Bags(texts), np.zeros(BUCKETS)
    if not len(bags.tokens):
        return ToxicModel(buckets, 0.0, 1.0, 0.0)
    embed, weights, bias = _train(bags, labels)
    buckets[bags.used] = embed @ (weights[:, 1] - weights[:, 0])
    return ToxicModel(buckets, float(bias[1] - bias[0]), 1.0, 0.0)


def _features(model: ToxicModel, texts) -> np.ndarray:
    logits = WordLogits(model.buckets)
    return np.array([model.features(logits, t) for t in texts], float).reshape(-1, 3)


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS,
        sample_chars: int = SAMPLE_CHARS) -> ToxicModel:
    """Train on ``doc_id, text`` of ``docs`` and ``doc_id, toxic`` of ``labels``.

    About ``toxic_rows`` and ``clean_rows`` labels are used, fewer if their texts exceed ``sample_chars``; each text is
    used whole.  The chosen ids are picked before they meet the texts, so they are few enough to be sent to the tasks.
    Without rows of both labels every score is that of the one label there is (clean without any).
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return ToxicModel(np.zeros(BUCKETS), 0.0, 0.0, 30.0 if n_toxic else -30.0)
    share = sample_share("doc_id", 10)
    ids = known.where(share < F.when(F.col("toxic") == 1, toxic_rows / n_toxic).otherwise(clean_rows / n_clean)).toArrow()
    ids = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int")
    picked = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")
    chars = picked.agg(F.sum(F.length("text"))).first()[0] or 1
    if chars > sample_chars:
        picked = picked.where(sample_share("doc_id", 12) < sample_chars / chars)
    rows = picked.select("doc_id", "text", "toxic", sample_share("doc_id", 13).alias("fold")).toPandas().sort_values(["doc_id", "text"])
    y, fold = rows["toxic"].to_numpy(), (rows["fold"].to_numpy() * FOLDS).astype(int)
    model = _uncalibrated(rows["text"].tolist(), y)
    if not model.buckets.any():
        return ToxicModel(model.buckets, 0.0, 0.0, float(np.log(n_toxic / n_clean)))
    x = _features(model, rows["text"])
    if np.bincount(2 * fold + y, minlength=2 * FOLDS).min() >= 5:
        for part in range(FOLDS):
            own = fold == part
            x[own] = _features(_uncalibrated(rows["text"][~own].tolist(), y[~own]), rows["text"][own])
    # rows weigh as in the population, not as in the sample
    weight = np.where(y == 1, n_toxic / max(1, y.sum()), n_clean / max(1, (1 - y).sum()))
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    *beta, offset = logistic((x - mean) / spread, y.astype(float), weight / weight.mean(), 0.1)
    beta = np.array(beta) / spread
    model.slope, model.crowd, model.offset = float(beta[0]), (float(beta[1]), float(beta[2])), float(offset - beta @ mean)
    return model


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text; null and empty texts get the score of no words.

    Repeated rows are scored as often as given, an empty table gives no rows, and columns beyond ``doc_id`` and ``text``
    are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = held.value
        logits = WordLogits(own.buckets)
        for batch in batches:
            for part in slices(batch):
                found = own.probability(np.array([own.features(logits, t) for t in part["text"].to_pylist()], float))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part["doc_id"], "score": found, "predicted": (found >= 0.5).astype(np.int32)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def detect(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """Learn from the labels of documents whose id does not leave 0, score all; adds ``held_out``.

    A document with several labels counts as toxic if any of them says so.
    """
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    model = fit(docs, labels.where(~held_out), **limits)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
