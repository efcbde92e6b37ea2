"""Connected components of an edge table, without gathering edges anywhere.

Rounds of large-star and small-star (Kiveris et al., "Connected Components in MapReduce
and Beyond", 2014): every vertex hands its larger, then its smaller neighbours to the
least of them, until the edges are stars around each component's least vertex.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable index for each of ``n`` vertices with links ``a[i] - b[i]``."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
    return label


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every vertex of ``edges(a, b)`` that has a link to another.

    ``component`` is the least id reachable.  Null ends and loops are left out; repeated
    edges count once; an empty table gives an empty one.  Every round makes the sum of the
    labels smaller or is the last, so it always settles.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = cut(edges.where("a is not null and b is not null and a <> b").select(high.alias("a"), low.alias("b")).distinct())
    seen = None
    while True:  # about as many rounds as the logarithm of the longest path
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Tables of their own, so that Spark can split the joins of vertices with many links.
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        drop_cut(least)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        after = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")
        after = cut(after.distinct())
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_cut(large)
        drop_cut(least)
        drop_cut(now)
        now = after
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    now = now.unionByName(now.select(F.col("b").alias("a"), "b"))
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
