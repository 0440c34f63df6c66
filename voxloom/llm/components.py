"""Connected components by alternating large-star and small-star steps over an edge table.

Each step is a partial minimum for every node and a join back to its edges, so a node with
very many neighbours is combined map-side and its join can be split; no neighbourhood is
gathered in one task, and no edge or label passes through the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """edges (a long, b long) -> (id, component): the smallest id reachable, for each id with an edge but
    the smallest of each component, which stands for itself."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before, k = scratch.table(e, f"{name}0"), None, 0
    while True:
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())
        if now == before or not now[0]:
            break
        before, k = now, k + 1
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = scratch.table(small, f"{name}{k}")
        if k > 1:
            scratch.drop(f"{name}{k - 2}")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component"))


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (i, j): the smallest node of each one's component."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root
