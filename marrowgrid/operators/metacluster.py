"""Metaclusters, spanning trees and the number of clusters.

A codebook is model-sized, so one codebook is one group; many patients'
codebooks are clustered in parallel by ``model_id``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrowgrid.functions.vectors import matrix_of, nearest
from marrowgrid.operators.sizing import folded, model_rows

# Consensus and selection parameters.
RESAMPLES, RESAMPLE_SHARE, RUNS_PER_TASK = 100, 0.9, 10
MIN_STABILITY, W_STABILITY, W_SILHOUETTE, BOOTSTRAPS = 0.75, 0.65, 0.35, 10


def agglomerate(points: np.ndarray, ks: Sequence[int], linkage: str = "ward", distances: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """Labels at each k, numbered by first member; distances update by Lance-Williams."""
    n = len(points) if distances is None else len(distances)
    if distances is None:
        d = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    else:
        d = distances.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    wanted, out = set(ks), {}
    alive = n
    while True:
        if alive in wanted:
            out[alive] = np.unique(label, return_inverse=True)[1]
        if alive <= max(min(wanted, default=1), 1):
            break
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        if linkage == "ward":
            t = size[i] + size[j] + size
            fresh = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / t
        else:
            fresh = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        fresh[[i, j]] = np.inf
        dead = ~np.isfinite(d[i]) & ~np.isfinite(d[j])
        fresh[dead] = np.inf
        d[i], d[:, i] = fresh, fresh
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        alive -= 1
    for k in wanted - set(out):
        out[k] = np.arange(n)  # fewer points than clusters
    return out


def metacluster(codebook: DataFrame, k: int, linkage: str = "ward") -> DataFrame:
    """(model_id, node_id, metacluster) of every codebook."""

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        found = agglomerate(np.stack(pdf["code"].to_numpy()), [k], linkage)[k]
        return pd.DataFrame({"model_id": pdf["model_id"], "node_id": pdf["node_id"], "metacluster": found})

    return codebook.select("model_id", "node_id", "code").groupBy("model_id").applyInPandas(
        label, "model_id string, node_id long, metacluster int")


def consensus_metacluster(codebook: DataFrame, k: int, resamples: int = RESAMPLES, share: float = RESAMPLE_SHARE, seed: int = 42) -> DataFrame:
    """Labels from how often two nodes fall together over resampled codebooks.

    Resamples run in parallel chunks; each chunk returns summed co-membership
    rows of the (model-sized) codebook, which are added up per model.
    """
    chunks = max(1, resamples // RUNS_PER_TASK)

    def vote(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        codes, chunk = np.stack(pdf["code"].to_numpy()), int(pdf["chunk"].iloc[0])
        n = len(codes)
        together, seen = np.zeros((n, n)), np.zeros((n, n))
        for run in range(chunk, resamples, chunks):
            rng = np.random.default_rng(seed + run)
            part = np.sort(rng.choice(n, size=max(int(n * share), min(k, n)), replace=False))
            labels = agglomerate(codes[part], [min(k, len(part))])[min(k, len(part))]
            same = labels[:, None] == labels[None, :]
            together[np.ix_(part, part)] += same
            seen[np.ix_(part, part)] += 1
        return pd.DataFrame({"model_id": pdf["model_id"], "node_id": pdf["node_id"], "together": list(together), "seen": list(seen)})

    runs = codebook.select("model_id", "node_id", "code", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    partial = runs.groupBy("model_id", "chunk").applyInPandas(
        vote, "model_id string, node_id long, together array<double>, seen array<double>")

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        # one summed row per node and chunk: as many numbers as the chunks' codebooks
        rows = {n: (np.sum(np.stack(g["together"]), axis=0), np.sum(np.stack(g["seen"]), axis=0)) for n, g in pdf.groupby("node_id")}
        ids = sorted(rows)
        rate = np.stack([rows[n][0] / np.maximum(rows[n][1], 1.0) for n in ids])
        labels = agglomerate(np.empty((len(ids), 0)), [k], "average", 1.0 - rate)[k]
        return pd.DataFrame({"model_id": pdf["model_id"].iloc[0], "node_id": ids, "metacluster": labels})

    return partial.groupBy("model_id").applyInPandas(final, "model_id string, node_id long, metacluster int")


def spanning_tree(codebook: DataFrame) -> DataFrame:
    """Minimum spanning tree edges (model_id, src, dst, weight) of every codebook."""

    def prim(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node_id")
        codes, ids = np.stack(pdf["code"].to_numpy()), pdf["node_id"].to_numpy()
        best = np.full(len(codes), np.inf)
        link, outside = np.zeros(len(codes), dtype=int), np.ones(len(codes), dtype=bool)
        at, edges = 0, []
        outside[0] = False
        for _ in range(len(codes) - 1):
            d = np.sqrt(((codes - codes[at]) ** 2).sum(axis=1))
            closer = outside & (d < best)
            best[closer], link[closer] = d[closer], at
            at = int(np.argmin(np.where(outside, best, np.inf)))
            outside[at] = False
            edges.append((pdf["model_id"].iloc[0], ids[min(at, link[at])], ids[max(at, link[at])], best[at]))
        return pd.DataFrame(edges, columns=["model_id", "src", "dst", "weight"])

    return codebook.select("model_id", "node_id", "code").groupBy("model_id").applyInPandas(
        prim, "model_id string, src long, dst long, weight double")


def tree_hops(edges: DataFrame, nodes: int) -> DataFrame:
    """Hop distance between all node pairs of each (model-sized) tree."""

    def hops(pdf: pd.DataFrame) -> pd.DataFrame:
        n = nodes
        d = np.full((n, n), np.inf)
        np.fill_diagonal(d, 0)
        d[pdf["src"], pdf["dst"]] = d[pdf["dst"], pdf["src"]] = 1
        for via in range(n):
            d = np.minimum(d, d[:, [via]] + d[[via], :])
        a, b = np.nonzero(np.isfinite(d))
        return pd.DataFrame({"model_id": pdf["model_id"].iloc[0], "src": a, "dst": b, "hops": d[a, b].astype(int)})

    return edges.groupBy("model_id").applyInPandas(hops, "model_id string, src long, dst long, hops int")


def silhouette(points: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette of a model-sized point set."""
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    groups = np.unique(labels)
    if len(groups) < 2 or len(groups) >= len(points):
        return -1.0
    member = labels[:, None] == groups[None, :]
    sums, sizes = d @ member, member.sum(axis=0)
    own = member.argmax(axis=1)
    mine = sums[np.arange(len(points)), own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes
    means[np.arange(len(points)), own] = np.inf
    other = means.min(axis=1)
    s = np.where(sizes[own] > 1, (other - mine) / np.maximum(np.maximum(other, mine), 1e-300), 0.0)
    return float(s.mean())


def adjusted_rand(counts: np.ndarray) -> float:
    """Adjusted Rand index of a contingency table."""
    pairs = lambda v: (v * (v - 1) / 2).sum()
    n = counts.sum()
    total, rows, cols = pairs(np.array([n])), pairs(counts.sum(axis=1)), pairs(counts.sum(axis=0))
    expected = rows * cols / max(total, 1)
    top = (rows + cols) / 2
    return 1.0 if top == expected else float((pairs(counts) - expected) / (top - expected))


def _contingency(events: DataFrame, books: Sequence[np.ndarray], x: str = "x") -> DataFrame:
    """(a, b, i, j, count): events that lie on node i of map a and on node j of map b.

    A task hands on its counts, never the events' nodes.  A column ``_n`` is the number of equal events of a row.
    """
    weighed = "_n" in events.columns
    sent = events.sparkSession.sparkContext.broadcast(list(books))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = sent.value
        met = {(a, b): np.zeros(len(maps[a]) * len(maps[b]), dtype="int64") for a, b in combinations(range(len(maps)), 2)}
        for batch in batches:
            if batch.num_rows:
                m = matrix_of(batch.column(0))
                node = [nearest(m, book) for book in maps]
                copies = batch.column(1).to_numpy(zero_copy_only=False) if weighed else None
                for (a, b), cells in met.items():
                    cells += np.bincount(node[a] * len(maps[b]) + node[b], weights=copies, minlength=len(cells)).astype("int64")
        for (a, b), cells in met.items():
            used = np.nonzero(cells)[0]
            if len(used):
                i, j = np.divmod(used, len(maps[b]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), v, dtype="int64")) for v in (a, b)] + [pa.array(v) for v in (i, j, cells[used])],
                    names=["a", "b", "i", "j", "n"])

    found = events.select(x, *(["_n"] if weighed else [])).mapInArrow(count, "a long, b long, i long, j long, n long")
    return found.groupBy("a", "b", "i", "j").agg(F.sum("n").alias("count"))


def choose_k(
    events: DataFrame, codes: np.ndarray, ks: Sequence[int], *, x: str = "x", key: Sequence[str] = ("event_id",), xdim: int = 10, ydim: int = 10,
    bootstraps: int = BOOTSTRAPS, min_stability: float = MIN_STABILITY, seed: int = 42, epochs: int | None = None,
    rows: DataFrame | None = None,
) -> tuple[int, list[tuple[int, float, float, float]]]:
    """Number of metaclusters and the (k, silhouette, stability, composite) scores.

    Silhouettes of the codebook keep the better half of the candidates.  Then
    maps are trained with different seeds on all rows, all of them in the same
    jobs; every pair of maps is compared by its node-by-node contingency counts, from
    which the Rand index follows for all k at once.  ``rows`` are the events with their number, where the caller has them.
    """
    from marrowgrid.operators.som import fit_soms

    labels = agglomerate(codes, list(ks))
    sil = {k: silhouette(codes, labels[k]) for k in ks}
    kept = sorted(sorted(ks, key=lambda k: -sil[k])[: max(len(ks) // 2, 3)])
    kinds = folded(events.select(x)) if rows is None else rows
    try:
        runs = fit_soms(events, [seed + 100 + b for b in range(bootstraps)], x=x, key=key, xdim=xdim, ydim=ydim, epochs=epochs, rows=kinds)
        tables: dict = {}
        for r in model_rows(_contingency(kinds, [m.codes[None] for m in runs], x), math.comb(bootstraps, 2) * (xdim * ydim) ** 2 + 1):
            tables.setdefault((r["a"], r["b"]), []).append((r["i"], r["j"], r["count"]))
    finally:
        if rows is None:
            kinds.unpersist()
    cut = [agglomerate(m.codes[None], kept) for m in runs]
    stability = {}
    for k in kept:
        scores = []
        for (a, b), cells in tables.items():
            i, j, c = np.array(cells).T
            table = np.zeros((k, k))
            np.add.at(table, (cut[a][k][i], cut[b][k][j]), c)
            scores.append(adjusted_rand(table))
        stability[k] = float(np.mean(scores)) if scores else 0.0
    pool = [k for k in kept if stability[k] >= min_stability] or [max(kept, key=lambda k: stability[k])]
    low, high = min(sil[k] for k in pool), max(sil[k] for k in pool)
    span = high - low if high > low else 1.0
    composite = {k: W_STABILITY * stability[k] + W_SILHOUETTE * (sil[k] - low) / span for k in pool}
    best = max(composite, key=composite.get)
    return best, [(k, sil[k], stability.get(k), composite.get(k)) for k in ks]
