"""Table functions for SQL: ``FROM slices, LATERAL slice_chains(data, dtype, oy, ox, ny, nx)``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import contour

_CHAINS = "contour int, kind string, i int, y int, x int"


class SliceChains:
    """The contours of one slice: each vertex in its stored order, outer chains first.

    A slice without data, or one in which nothing is set, gives no row.
    """

    def eval(self, data: bytes, dtype: str, oy: int, ox: int, ny: int, nx: int):
        on = np.frombuffer(data, "<" + dtype).reshape(ny, nx) != 0 if data else np.zeros((ny, nx), bool)
        for k, (kind, chain, _) in enumerate(contour.outlines(on)[0] if on.any() else []):
            for i, (x, y) in enumerate(chain):
                yield k, kind, i, y + oy, x + ox


def register(spark: SparkSession) -> SparkSession:
    """The session, with the table function ``slice_chains``; rows go to it and come back in Arrow batches."""
    spark.udtf.register("slice_chains", udtf(SliceChains, returnType=_CHAINS, useArrow=True))
    return spark
