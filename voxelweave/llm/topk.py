"""Exact top-k search (operator 8) by distributed histogram selection.

Queries come in passes of bounded size.  In a pass every vector is scored against all its
queries, and each task hands on a histogram of the scores of each query.  The sums, which
stay distributed, locate the bin of each query's kth value; that bin is divided again, until
the kth value is known or few rows are left above the bin's lower edge.  Then rows from that
edge upwards are filtered, and ranked by score and smaller id.  Ties at the kth value cost
nothing: of equal scores a task hands on the k smallest ids only, which is all that can be
ranked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, prepare, tidied
from .vectors import matrices

#: Queries that are scored at a time, queries and numbers of a pass, and bins of a histogram.
QUERY_BLOCK, PASS_QUERIES, PASS_NUMBERS, BINS = 2048, 16_384, 2_000_000, 256
#: With at most this many times k rows from a bin's lower edge on, it is divided no more.
ENOUGH = 8
#: Scores beyond it count and are returned as this.
MOST = 1 << 61


def quantised(matrix: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(matrix * scale))


def _scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products, exact up to MOST: in double precision where that holds them."""
    large, sums = np.abs(rows).max(axis=1, initial=0), np.minimum(np.abs(queries), 1e300).sum(axis=1)
    with np.errstate(over="ignore", invalid="ignore"):
        bound = large[:, None] * sums
        if bound.max(initial=0) < 2**53:
            return (rows @ queries.T).astype(np.int64)
        if bound.max(initial=0) < MOST:
            return rows.astype(np.int64) @ queries.astype(np.int64).T
        out = np.where(bound < 2**53, rows @ queries.T, 0).astype(np.int64)
    whole = {}
    for i, j in zip(*np.nonzero(~(bound < 2**53))):
        x, y = (whole.setdefault(k, [int(v) for v in m]) for k, m in (((0, i), rows[i]), ((1, j), queries[j])))
        out[i, j] = max(-MOST, min(MOST, sum(map(int.__mul__, x, y))))
    return out


class _Pass:
    """Queries by vector length, with the range of scores still in question."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], most: float):
        self.ids, self.bins = ids, BINS
        self.blocks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for size in sorted({len(v) for v in vectors}):
            at = np.array([i for i, v in enumerate(vectors) if len(v) == size])
            self.blocks[size] = [(at[k : k + QUERY_BLOCK], np.stack([vectors[i] for i in at[k : k + QUERY_BLOCK]])) for k in range(0, len(at), QUERY_BLOCK)]
        with np.errstate(over="ignore", invalid="ignore"):
            bounds = [float(np.abs(v).sum() * most) for v in vectors]
        bound = np.array([MOST if not b < MOST else int(b) + 1 for b in bounds], np.int64)
        self.low, self.high = -bound, bound + 1
        self.above = np.zeros(len(ids), np.int64)
        self.done = np.zeros(len(ids), bool)

    def width(self) -> np.ndarray:
        return -(-(self.high - self.low) // self.bins)

    def scored(self, batch, scale):
        """``(query places, row ids, scores)`` with a query's own row out of the question."""
        for _, ids, matrix in matrices(batch.column(0), batch.column(1)):
            for at, queries in self.blocks.get(matrix.shape[1], ()):
                for k in range(0, len(ids), 4096):
                    s = _scores(quantised(matrix[k : k + 4096], scale), queries)
                    yield at, ids[k : k + 4096], s, ids[k : k + 4096, None] != self.ids[at]

    def refine(self, query: np.ndarray, bin_: np.ndarray, total: np.ndarray, count: np.ndarray, k: int) -> None:
        """From the bin that reaches the kth value of each open query, the rows from it upwards, and its own."""
        short = ~self.done
        short[query] = False  # fewer than k rows in all
        self.low[short], self.done[short] = np.iinfo(np.int64).min, True
        width = self.width()[query]
        self.low[query] += bin_ * width
        self.high[query] = np.minimum(self.high[query], self.low[query] + width)
        whole = self.above[query] + total
        self.above[query] = whole - count
        self.done[query] = (width == 1) | (whole <= ENOUGH * k)


def _histograms(rows: DataFrame, block: _Pass, scale: float, k: int) -> DataFrame:
    """Counts by query and bin; a task leaves out bins below those that hold its own best k."""

    def run(batches):
        total = np.zeros((len(block.ids), block.bins), np.int64)
        width, open_ = block.width(), ~block.done
        for batch in batches:
            for at, _, scores, other in block.scored(batch, scale):
                inside = other & (scores >= block.low[at]) & (scores < block.high[at]) & open_[at]
                bins = (scores - block.low[at]) // width[at]
                place = (np.arange(len(at)) * block.bins + bins)[inside]
                total[at] += np.bincount(place, minlength=len(at) * block.bins).reshape(len(at), -1)
        down = np.cumsum(total[:, ::-1], axis=1)[:, ::-1]
        q, b = np.nonzero((total > 0) & (down - total < k))
        for i in range(0, len(q), 100_000):
            s = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(q[s]), pa.array(b[s]), pa.array(total[q[s], b[s]])], ["query", "bin", "n"])

    return rows.mapInArrow(tidied(run), "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def _located(counts: DataFrame, block: _Pass, k: int) -> DataFrame:
    """For each open query the highest bin from which on there are enough rows: ``query, bin, total, n``."""
    wanted = [(int(q), int(k - block.above[q])) for q in np.flatnonzero(~block.done)]
    need = counts.sparkSession.createDataFrame(wanted, "query long, need long")  # at most PASS_QUERIES rows
    down = Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    total = counts.withColumn("total", F.sum("n").over(down)).join(F.broadcast(need), "query").where("total >= need")
    return total.groupBy("query").agg(F.max("bin").alias("bin"), F.min("total").alias("total"), F.max_by("n", "bin").alias("n"))


def _filtered(rows: DataFrame, block: _Pass, scale: float, k: int) -> DataFrame:
    def best(q, v, s):
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], v[keep], s[keep]

    def run(batches):
        held = (np.zeros(0, np.int64),) * 3
        for batch in batches:
            for at, ids, scores, other in block.scored(batch, scale):
                i, j = np.nonzero(other & (scores >= block.low[at]))
                if len(i):
                    held = best(*(np.concatenate(x) for x in zip(held, (at[j], ids[i], scores[i, j]), strict=True)))
        for i in range(0, len(held[0]), 100_000):
            q, v, s = (x[i : i + 100_000] for x in held)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(tidied(run), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` highest scores, or all if fewer.

    A score is the inner product of the vectors with every component x as floor(scale * x); one
    beyond 2**61 counts as 2**61, one below -2**61 as that.  A query meets every row but those
    of its own id.  Equal scores rank by smaller id; repeated rows of one id are each ranked.
    Rows with a null id, and vectors that are null or empty or hold null or non-finite
    components, take no part; vectors of another length than the query's do not meet it.  Of
    several query rows with one id the first in the order of their components counts.  No query
    or no row gives an empty table; other columns are not read.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = cut(asked.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad).groupBy("vec_id").agg(F.min("v").alias("v")))
    most = rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad).select(F.max(F.array_max(F.transform("v", lambda x: F.abs(x * scale) + 1))).alias("m")).first().m
    asks, numbers = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    passes = max(1, -(-asks // PASS_QUERIES), -(-numbers // PASS_NUMBERS))
    part_of = F.pmod(F.xxhash64("vec_id"), F.lit(passes))
    out = None
    for b in range(passes):
        own = asked.where(part_of == b).orderBy("vec_id").toArrow()  # about PASS_QUERIES rows
        if not own.num_rows:
            continue
        block = _Pass(np.asarray(own.column("vec_id")), [quantised(np.asarray(v), scale) for v in own.column("v").to_pylist()], most or 0.0)
        while not block.done.all():
            found = _located(_histograms(rows, block, scale, k), block, k).toArrow()
            block.refine(*(np.asarray(found.column(c)) for c in ("query", "bin", "total", "n")), k)
        part = _filtered(rows, block, scale, k)
        part = part if passes == 1 else cut(part)
        out = part if out is None else out.unionByName(part)
    drop_cut(asked)
    if out is None:
        out = rows.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    """The query's columns: the 10 best rows of each vector whose id is divisible by 100."""
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
