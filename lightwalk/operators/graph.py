"""Street graph: arcs and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialize


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges (src, dst, ...) as arcs in both directions; self-loops go."""
    real = edges.where("src != dst")
    back = real.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in real.columns])
    return real.unionByName(back)


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60, at_once: int = 250_000) -> DataFrame:
    """(node_id, component): the smallest node id that each node can reach.

    Edges are dealt by ranges of their source, at most some ``at_once`` to a task, and each task joins what its own edges join.
    What is left are links between such parts: where streets are numbered by place, few. Over those labels spread to
    neighbours and then jump to their label's label, so the rounds follow the logarithm of the longest path.
    """
    known = nodes.select("node_id")
    for end in ("src", "dst"):
        edges = edges.join(known.select(F.col("node_id").alias(end)), end, "left_semi")
    real = materialize(edges.where("src != dst").select("src", "dst"), "arcs")
    slots = edges.sparkSession.sparkContext.defaultParallelism
    dealt = real.repartitionByRange(max(slots, -(-real.count() // at_once)), "src")
    parts = materialize(dealt.mapInPandas(_joined, "node long, root long"), "parts")
    own = parts.groupBy("node").agg(F.min("root").alias("low"))
    links = materialize(parts.join(own, "node").where("root != low").select(F.col("low").alias("src"), F.col("root").alias("dst")).distinct(), "links")
    ends = links.select("src").unionByName(links.select(F.col("dst").alias("src"))).distinct().select(F.col("src").alias("node_id"))
    far = own.join(_spread(ends, links, max_rounds).select(F.col("node_id").alias("low"), "component"), "low", "left").select(F.col("node").alias("node_id"), F.coalesce("component", "low").alias("component"))
    return materialize(known.join(far, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component")), "labels")


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of a part of the edges, each with the smallest that these edges join it to."""
    held = pd.concat([pd.DataFrame({"src": [], "dst": []}, dtype="int64"), *batches])
    ids, at = np.unique(held[["src", "dst"]].to_numpy(np.int64).T.ravel(), return_inverse=True)
    a, b = at[: len(held)], at[len(held) :]
    root = np.arange(len(ids))
    while True:
        ends = root[a], root[b]
        if (ends[0] == ends[1]).all():
            break
        for end in ends:
            np.minimum.at(root, end, np.minimum(*ends))
        while (root[root] != root).any():
            root = root[root]
    yield pd.DataFrame({"node": ids, "root": ids[root]})


def _spread(nodes: DataFrame, edges: DataFrame, max_rounds: int) -> DataFrame:
    """The labels of a graph by rounds. The minimum over a node's neighbours is aggregated before the shuffle; each round's labels are written down."""
    arcs = materialize(both_ways(edges), "arcs")
    labels = materialize(nodes.select(F.col("node_id"), F.col("node_id").alias("component")), "labels")
    if arcs.isEmpty():
        return labels
    for _ in range(max_rounds):
        heard = arcs.join(labels, arcs.src == labels.node_id).groupBy("dst").agg(F.min("component").alias("heard"))
        met = labels.join(heard, labels.node_id == heard.dst, "left").select("node_id", F.col("component").alias("was"), F.least("component", "heard").alias("near"))
        jump = met.select(F.col("node_id").alias("near"), F.col("near").alias("far"))
        after = materialize(met.join(jump, "near", "left").select("node_id", "was", F.least("near", "far").alias("component")), "labels")
        labels = after.select("node_id", "component")
        if not after.where("was != component").limit(1).count():
            return labels
    raise RuntimeError("labels did not settle")
