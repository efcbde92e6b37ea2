"""Approximate aggregates that can be kept and pooled: distinct values and quantiles of each scan.

A scan's sketches are two binary columns of a few kB, whatever its size.  Those of many scans merge
into those of a pool without reading a voxel again, in any order and grouping.  The exact forms are
``count(DISTINCT v)`` and ``percentile``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the distinct sketch (2^n registers) and size of the quantile sketch.
DISTINCT_BITS, QUANTILE_SIZE = 12, 400


def distinct_error(bits: int = DISTINCT_BITS, deviations: float = 3.0) -> float:
    """The relative error of a count of distinct values that is not exceeded but in one of some hundreds of sketches."""
    return deviations * 1.04 / 2 ** (bits / 2)


def rank_error(size: int = QUANTILE_SIZE) -> float:
    """The error of a quantile's rank, as a share of all values, that 99 of 100 sketches of this size keep, on either side."""
    return 2.446 / size**0.9433


def scan_sketches(df: DataFrame, *keys: str, value: str = "v", bits: int = DISTINCT_BITS, size: int = QUANTILE_SIZE) -> DataFrame:
    """``keys, n, distinct_sketch, quantile_sketch`` of the values that are not null; partial sketches are merged before the shuffle."""
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(value).cast("long"), bits).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("quantile_sketch"))


def pooled_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """The sketches of pools of scans; with no keys, of all."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"))


def distinct_count(sketch: str = "distinct_sketch") -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(share: float, sketch: str = "quantile_sketch") -> Column:
    """The value below which about ``share`` of all lie."""
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(float(share)))


def rank(value: Column, sketch: str = "quantile_sketch") -> Column:
    """The share of all values up to ``value``, about."""
    return F.kll_sketch_get_rank_double(F.col(sketch), value)
