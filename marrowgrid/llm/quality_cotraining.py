"""Quality classifier by co-training of two views.

One classifier sees the content of a text (shares of character classes, word lengths, repetition, line structure), the
other the metadata of its page (language, source, length class).  Both are logistic regressions.  In each round each
view labels the unlabelled documents it is confident about for the other view.  At the end each view is calibrated on
labelled rows that trained neither, and the calibrated log-odds are added (the prior counted once) to score everything.

Scale: features are computed in one scan and staged in a few hundred bytes per document, so rounds do not read text.
All unlabelled documents compete for the pseudo-labels of a round; the choice depends on a hash of the features, and
copies count once.  The labelled sample is bounded (``LABELLED_ROWS``) and fitted in numpy on the driver.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass
from itertools import count, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrowgrid.llm.common import CLASSES, byte_blocks, class_counts, remainder, sample_share, slices, utf8
from marrowgrid.session import staged

#: labelled rows, on average, that are fitted; chosen by a hash of the id
LABELLED_ROWS = 8000
ROUNDS = 3
#: probability from which on a view is confident
CONFIDENT = 0.97
#: pseudo-labels of one class that a view gives in a round, and their weight against a real label
PER_ROUND = 200
PSEUDO_WEIGHT = 0.3
#: share of the labelled sample kept for calibration
CALIBRATION = 0.3
META_BUCKETS = 64
META_SLOTS = 3 * META_BUCKETS
TEXT_FEATURES = CLASSES + 10
VIEWS = ("text", "meta")


def text_features(text: str | None) -> np.ndarray:
    """Content features of a whole text; zeros for a null or empty one."""
    out = np.zeros(TEXT_FEATURES)
    if not text:
        return out
    data = utf8(text)
    classes = class_counts(data)
    out[:CLASSES] = classes / max(1, classes.sum())
    numbers = defaultdict(count().__next__)
    codes = [np.fromiter(map(numbers.__getitem__, b.split()), np.int64) for b in byte_blocks(data)]
    codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    n = len(codes)
    if not n:
        return out
    seen = np.bincount(codes)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    upper = sum(c * w.isupper() for w, c in zip(numbers, seen.tolist()))
    plain = sum(c for w, c in zip(numbers, seen.tolist()) if w[-1:].isalpha() or w[-1] > 127)
    out[CLASSES:] = (
        np.log1p(n), (len(data) - classes[3] - classes[4]) / n / 10, len(seen) / n, seen.max() / n,
        (codes[1:] == codes[:-1]).mean() if n > 1 else 0.0, upper / n, plain / n,
        len(lines) and 1 - len(set(lines)) / len(lines), np.log1p(n / max(1, len(lines))),
        len(seen) / np.sqrt(n) / 10)
    return out


def meta_slots(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """One slot for each metadata field; a null field has a slot of its own."""
    size = 0 if n_chars is None else 1 + min(30, max(0, int(n_chars)).bit_length())
    return [
        zlib.crc32(b"" if lang is None else b"l" + utf8(lang)) % META_BUCKETS,
        META_BUCKETS + zlib.crc32(b"" if source is None else b"s" + utf8(source)) % META_BUCKETS,
        2 * META_BUCKETS + size]


def _features(batches):
    for batch in batches:
        for part in slices(batch):
            rows = part.to_pydict()
            yield pa.RecordBatch.from_pydict({
                "doc_id": part["doc_id"],
                "text_x": pa.array([text_features(t).astype(np.float32) for t in rows["text"]], pa.list_(pa.float32())),
                "meta_x": pa.array(list(map(meta_slots, rows["lang"], rows["source"], rows["n_chars"])), pa.list_(pa.int32()))})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept and is not penalised."""
    x = np.column_stack([x, np.ones(len(x))])
    beta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = _sigmoid(x @ beta)
        step = np.linalg.solve(
            (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty),
            x.T @ (weight * (y - p)) - penalty * beta)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass
class View:
    """A linear classifier and its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.beta[:-1] + self.beta[-1]

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.logit(x) + self.offset


@dataclass
class CoModel:
    """Both views; without both classes among the labels there are none and ``prior`` is the score."""

    views: dict[str, View]
    prior: float

    def scores(self, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Calibrated probability of good quality by view, and of both together."""
        n = len(x["text"])
        if not self.views:
            return {name: np.full(n, self.prior) for name in (*VIEWS, "both")}
        base = np.log(self.prior / (1 - self.prior))
        logits = {name: self.views[name].calibrated(x[name]) for name in VIEWS}
        out = {name: _sigmoid(logit) for name, logit in logits.items()}
        return out | {"both": _sigmoid(sum(logits.values()) - base)}


def _dense(slots) -> np.ndarray:
    """Indicator matrix of metadata slots."""
    slots = np.asarray(slots, np.int64).reshape(-1, 3)
    out = np.zeros((len(slots), META_SLOTS))
    out[np.arange(len(slots))[:, None], slots] = 1.0
    return out


def _inputs(frame: pd.DataFrame) -> dict[str, np.ndarray]:
    return {"text": np.array(frame["text_x"].tolist(), float).reshape(-1, TEXT_FEATURES), "meta": _dense(frame["meta_x"].tolist())}


def _fit_view(name: str, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> View:
    if name == "meta":
        mean, scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
    else:
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-4)
    return View(mean, scale, logistic((x - mean) / scale, y, weight, 10.0 if name == "meta" else 1.0))


def _confident(features: DataFrame, views: dict[str, View], per_round: int, confident: float) -> pd.DataFrame:
    """Unlabelled rows that a view is sure of: per view and class the ``per_round`` with the smallest hash."""
    held = features.sparkSession.sparkContext.broadcast(views)

    def run(batches):
        best: dict[tuple[str, int], dict] = {}
        for batch in batches:
            frame = batch.to_pandas()
            x = _inputs(frame)
            for name, view in held.value.items():
                p = _sigmoid(view.logit(x[name]))
                for label, sure in ((1, p >= confident), (0, p <= 1 - confident)):
                    own = best.setdefault((name, label), {})
                    rows = frame[sure].drop_duplicates("h")
                    own.update(zip(rows["h"], zip(rows["text_x"], rows["meta_x"])))
                    for h in sorted(own)[per_round:]:
                        del own[h]
        for (name, label), own in best.items():
            yield pa.RecordBatch.from_pydict({
                "view": pa.array([name] * len(own), pa.string()), "label": pa.array([label] * len(own), pa.int32()),
                "h": pa.array(list(own), pa.int64()),
                "text_x": pa.array([a for a, _ in own.values()], pa.list_(pa.float32())),
                "meta_x": pa.array([b for _, b in own.values()], pa.list_(pa.int32()))})

    sure = features.where("quality IS NULL").select("h", "text_x", "meta_x") \
        .mapInArrow(run, "view string, label int, h long, text_x array<float>, meta_x array<int>") \
        .groupBy("view", "label", "h").agg(F.first("text_x").alias("text_x"), F.first("meta_x").alias("meta_x")).persist()
    parts = [sure.where((F.col("view") == name) & (F.col("label") == label)).orderBy("h").limit(per_round).toPandas()
             for name in VIEWS for label in (0, 1)]
    sure.unpersist()
    return pd.concat(parts, ignore_index=True)


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Staged features of every document with ``quality`` where known (the mean of several labels, else null)."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id") \
        .agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    found = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")) \
        .mapInArrow(_features, "doc_id long, text_x array<float>, meta_x array<int>")
    return staged(found.join(known, "doc_id", "left").withColumn("h", F.xxhash64("text_x", "meta_x")), "features")


def fit(features: DataFrame, labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS, per_round: int = PER_ROUND,
        confident: float = CONFIDENT) -> CoModel:
    """Co-train on the features of ``with_labels``.

    ``labelled_rows`` bounds the labelled sample; unlabelled rows all compete in every round.
    """
    labelled = features.where("quality IS NOT NULL")
    n, good = labelled.agg(F.count("*"), F.sum("quality")).first()
    if not n or good in (0, n):
        return CoModel({}, 0.5 if not n else float(good == n))
    prior = good / n
    sample = labelled.where(sample_share("doc_id", 1) < labelled_rows / n) \
        .select("text_x", "meta_x", "quality", sample_share("doc_id", 11).alias("share")).orderBy("share").toPandas()
    x, y = _inputs(sample), sample["quality"].to_numpy(float)
    train = sample["share"].to_numpy() >= CALIBRATION
    if min(y[train].sum(), (1 - y[train]).sum(), y[~train].sum(), (1 - y[~train]).sum()) < 5:
        train[:] = True
    own = {name: (x[name][train], y[train], np.ones(train.sum())) for name in VIEWS}
    given: dict[str, set] = {name: set() for name in VIEWS}
    views = {name: _fit_view(name, *own[name]) for name in VIEWS}
    for _ in range(rounds):
        sure = _confident(features, views, per_round * (rounds + 1), confident)
        for name, other in (VIEWS, VIEWS[::-1]):
            new = sure[(sure["view"] == name) & ~sure["h"].isin(given[name])].groupby("label").head(per_round)
            given[name] |= set(new["h"])
            a, b, w = own[other]
            own[other] = (np.vstack([a, _inputs(new)[other]]), np.append(b, new["label"].to_numpy(float)),
                          np.append(w, np.full(len(new), PSEUDO_WEIGHT)))
        views = {name: _fit_view(name, *own[name]) for name in VIEWS}
    held = ~train if (~train).any() else train
    for name in VIEWS:
        slope, offset = logistic(views[name].logit(x[name][held])[:, None], y[held], np.ones(held.sum()), 1e-3)
        # a view that does not rank held rows rightly says nothing beyond the prior
        views[name].slope, views[name].offset = (slope, offset) if slope > 0 else (0.0, np.log(prior / (1 - prior)))
    return CoModel(views, prior)


def score(features: DataFrame, model: CoModel) -> DataFrame:
    """``doc_id, text_score, meta_score, score, kept`` of every row of the features; kept from a score of 0.5.

    Repeated rows are scored as often as given, an empty table gives no rows, and texts of any length are read whole.
    Columns beyond those of documents are ignored, whatever their names.
    """
    held = features.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = held.value.scores(_inputs(batch.select(["text_x", "meta_x"]).to_pandas()))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "text_score": found["text"], "meta_score": found["meta"], "score": found["both"],
                "kept": pa.array(found["both"] >= 0.5, pa.bool_())})

    return features.select("doc_id", "text_x", "meta_x").mapInArrow(
        run, "doc_id long, text_score double, meta_score double, score double, kept boolean")


def keeps(docs: DataFrame, model: CoModel) -> Column:
    """The decision as a column of ``docs``, to filter by without sending rows through Python or a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def kept(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        out = []
        for part in slices(pa.RecordBatch.from_pydict({"text": text, "lang": lang, "source": source, "n_chars": n_chars})):
            rows = part.to_pydict()
            x = {"text": np.array([text_features(t) for t in rows["text"]], np.float32).astype(float).reshape(-1, TEXT_FEATURES),
                 "meta": _dense(list(map(meta_slots, rows["lang"], rows["source"], rows["n_chars"])))}
            out.append(held.value.scores(x)["both"] >= 0.5)
        return pa.array(np.concatenate(out) if out else [], pa.bool_())

    return kept("text", "lang", "source", F.col("n_chars").cast("long"))


def held_out(column: str = "doc_id") -> Column:
    """Rows whose labels the registered query does not learn from: remainder 0 of five."""
    return F.coalesce(remainder(column, 5) == 0, F.lit(False))
