"""Connected components of a link table, distributed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelworks.llm.shared import drop_stash, stash


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of every node in ``edges`` (u, v: long); a component is named by its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step joins the links with one
    aggregated row a node, so no neighbourhood is ever collected. Those rows are written first: AQE splits a hub's links only
    where both sides of the join come straight out of a shuffle. Each round is written to the shared folder; only a count and two checksums reach the driver. The links
    shrink to stars in a number of rounds that grows with the logarithm of the number of nodes.
    """
    edges = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stash(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = stash(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least_large = stash(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(least_large, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least_large.select("u", F.col("m").alias("v")))
        after = stash(small.distinct(), "links")
        for done in (edges, least, large, least_large):
            drop_stash(done)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def star_links(left: np.ndarray, right: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices below ``size`` reduced to one link from each index to the smallest of its component."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        if np.array_equal(low, label[left]) and np.array_equal(low, label[right]):
            break
        for side in (left, right):
            np.minimum.at(label, label[side], low)
            np.minimum.at(label, side, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
    member = np.flatnonzero(label != np.arange(size))
    return member, label[member]
