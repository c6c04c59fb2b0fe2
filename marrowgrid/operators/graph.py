"""Graph communities of events: Jaccard-weighted neighbours, label propagation."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marrowgrid.operators.neighbors import knn, knn_indexed
from marrowgrid.operators.sizing import GROUP_ROWS, as_model, ordered_pieces
from marrowgrid.session import staged

#: steps after which labels that keep changing are an error
MAX_STEPS = 200


def jaccard_edges(neighbors: DataFrame, src: str = "query_id", dst: str = "base_id") -> DataFrame:
    """Symmetric edges weighted by the shared part of two neighbour lists.

    The lists (k entries each) are joined to both ends of an edge; no pairs of
    rows that merely share a neighbour are formed.
    """
    lists = neighbors.groupBy(src).agg(F.collect_set(dst).alias("list"))
    ends = neighbors.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    both = (
        ends.join(lists.select(F.col(src).alias("src"), F.col("list").alias("a")), "src")
        .join(lists.select(F.col(src).alias("dst"), F.col("list").alias("b")), "dst"))
    weight = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    edges = both.select("src", "dst", weight.alias("weight"))
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.unionByName(flipped).groupBy("src", "dst").agg(F.max("weight").alias("weight")).where("weight > 0")


def propagate_labels(nodes: DataFrame, edges: DataFrame, node: str = "query_id", max_iter: int | None = None, stage_every: int = 3) -> DataFrame:
    """Communities by weighted label propagation: (node, community).

    Each node takes the label with the largest weight among its neighbours and
    itself; the smaller label wins ties.  Steps go on until no label changes,
    and an error tells when that does not happen; ``max_iter`` asks for so many
    steps instead.  Community ids are dense, the largest community first.
    """
    edges = staged(edges, "edges")
    labels = staged(nodes.select(F.col(node).alias("dst"), F.col(node).alias("label")), "labels")
    own = edges.groupBy("src").agg(F.max("weight").alias("weight"))
    steps = MAX_STEPS if max_iter is None else max_iter
    for step in range(steps):
        heard = edges.join(labels, "dst").select("src", "label", "weight")
        kept = labels.select(F.col("dst").alias("src"), "label").join(own, "src", "left").select(
            "src", "label", F.coalesce("weight", F.lit(1.0)).alias("weight"))
        score = heard.unionByName(kept).groupBy("src", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
        best = score.groupBy("src").agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("m"))
        fresh = best.select(F.col("src").alias("dst"), (-F.col("m.l")).alias("label"))
        if (step + 1) % stage_every == 0 or step == steps - 1:
            fresh = staged(fresh, "labels")
            moved = fresh.join(labels.withColumnRenamed("label", "old"), "dst").where("label <> old").limit(1).count()
            labels = fresh
            if moved == 0:
                break
        else:
            labels = fresh
    else:
        if max_iter is None:
            raise RuntimeError(f"labels still change after {MAX_STEPS} steps")
    names = labels.groupBy("label").agg((-F.count("*")).alias("_n"))
    placed = ordered_pieces(names, ["_n", "label"], GROUP_ROWS)
    before = F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_piece")) - F.col("_c")
    first = as_model(placed.groupBy("_piece").agg(F.count("*").alias("_c")).withColumn("_first", before).drop("_c"))
    place = F.row_number().over(Window.partitionBy("_piece").orderBy("_n", "label"))
    dense = placed.join(first, "_piece").withColumn("community", (F.col("_first") + place - 1).cast("int"))
    return labels.join(dense.select("label", "community"), "label").select(F.col("dst").alias(node), "community")


def graph_clusters(events: DataFrame, k: int = 30, *, node: str = "event_id", x: str = "x", probes: int | None = None, **kw) -> DataFrame:
    """Neighbour graph and its communities in one call.

    ``probes`` searches an index instead of all pairs (see :func:`knn_indexed`), which large cohorts need.
    """
    search = knn if probes is None else partial(knn_indexed, probes=probes)
    found = staged(search(events, events.withColumnRenamed(node, "base_id"), k, query_id=node, base_id="base_id", x=x), "neighbours")
    return propagate_labels(events.select(node), jaccard_edges(found, node, "base_id"), node, **kw)
