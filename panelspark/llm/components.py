"""Connected components of an edge table, by large-star and small-star rounds.

Each round sends every node's neighbours to the smallest node seen: first the
larger ones (large star), then the smaller ones (small star). The edges end as
stars around the smallest node of each component, after a number of rounds
that grows with the logarithm of the nodes. A node's minimum is an aggregate
with partial sums and the edges meet it in a join, so no task gets the
neighbours of a hub as a list.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import saved


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("at"), F.least("at", "low").alias("low"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``u, v``: two longs);
    ``component`` is the smallest node that can be reached. Loops, repeated
    edges and either direction are allowed; no edges, no rows."""
    edges = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(rounds):
        size, digest = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if (size, digest) == state or not size:
            break
        state = (size, digest)
        both = _both_ways(edges)
        large = both.join(_minima(both), F.col("u") == F.col("at")).where("v > u and v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = saved(large.distinct())  # every u is above its v
        low = _minima(large)
        small = large.join(low, F.col("u") == F.col("at")).where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = saved(small.unionAll(low.select(F.col("at").alias("u"), F.col("low").alias("v"))).distinct())
    stars = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return stars.unionAll(edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component")))


class Forest:
    """Classes of the rows 0 to n - 1 of one task, joined pair by pair."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Put the rows ``a[i]`` and ``b[i]`` in one class each."""
        while len(a):
            la, lb = self.label[a], self.label[b]
            on = la != lb
            a, b, la, lb = a[on], b[on], la[on], lb[on]
            if not len(a):
                return
            low, high = np.minimum(la, lb), np.maximum(la, lb)
            root = np.arange(len(self.label))
            np.minimum.at(root, high, low)
            while True:  # to the ends of the chains
                further = root[root]
                if (further == root).all():
                    break
                root = further
            self.label = root[self.label]
