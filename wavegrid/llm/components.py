"""Connected components of links between ids, by alternating large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from wavegrid.llm.common import discarded, stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as a-b, one for each node but the least of its component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, label[x], label[y])
        np.minimum.at(label, label[y], label[x])
        label = label[label]
        if np.array_equal(label, before) and np.array_equal(label[x], label[y]):
            break
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for each node of a link that isn't its component's least node, that node. Each round is written to the shared folder, and the one before it deleted."""
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = stored(edges, "links")
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        before, edges = edges, stored(small, "links")
        discarded(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
