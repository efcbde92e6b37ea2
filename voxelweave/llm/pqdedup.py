"""Embedding near-duplicates (operator 3) by product quantisation.

Unit vectors are dealt into inverted lists by a coarse quantiser; the residual of each
is coded by product quantisation, with the length of what the code leaves out.  A
vector looks into every list that a near duplicate of its own may be in: those whose
border is nearer than a margin.  Within a list, table look-ups give the distance to each
coded vector; by the triangle inequality a pair can be left out if that is more than the
distance of a link and the coded vector's error.  All other pairs get their exact cosine.
A link that only one of its ends looks for counts for both.

The quantisers are fitted on a bounded sample; every vector is indexed.  Lists are about
LIST_ROWS vectors long up to MAX_LISTS of them; of many lists the centres are the sums of two
smaller sets.  The exact margin for a cosine of 0.9 is 0.447, but a displacement points across
a border with a small part of its length only: in ``d`` directions with about one in the root
of ``d``.  The margin is that many times REACH, or more if links of the sample need more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, cut, prepare, public_id, small, tidied
from .components import components, local_labels
from .vectors import matrices

#: Rows on which the quantisers are fitted at most, and of these how many are compared with each other.
SAMPLE_ROWS, TRIED_ROWS = 8192, 4096
#: Vectors of a list on average, lists at most, and lists whose centres are kept one by one.
LIST_ROWS, MAX_LISTS, FLAT_LISTS = 50, 1 << 22, 1024
SUBSPACES, CODEWORDS = 8, 32
#: The margin in standard deviations of a displacement along one direction, and how much more than links of the sample need.
REACH, SLACK = 1.6, 1.25
#: Vectors of a list, and visitors to it, that a task compares at a time.
LIST_BLOCK, VISIT_BLOCK = 1024, 4096
#: Lengths of vectors that get an index of their own: the most frequent; of others all pairs of a length are compared.
INDEXED_LENGTHS = 16


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; neither overflows nor underflows."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def k_means(rows: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids; of fewer distinct rows than ``k``, those rows."""
    rows = np.unique(rows, axis=0)
    if len(rows) <= k:
        return rows
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        own = nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        counts = np.bincount(own, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, but for rounding."""
    return (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)


class Quantiser:
    """Coarse centroids, and codewords of the residuals for each subspace.

    Up to FLAT_LISTS lists each have a centroid; beyond, list ``i * k + j`` has the sum of
    centroid ``i`` and of codeword ``j`` of the residuals, so ``n`` lists need about twice the
    root of ``n`` vectors.
    """

    def __init__(self, sample: np.ndarray, lists: int, cosine: float = 0.9, margin: float | None = None):
        far = math.sqrt(2 - 2 * cosine)
        whole = lists if lists <= FLAT_LISTS else min(len(sample) // 4, math.ceil(math.sqrt(lists)))
        self.coarse = k_means(sample, whole)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.fine = np.zeros((1, sample.shape[1])) if lists <= FLAT_LISTS else k_means(rest, min(len(sample) // 4, -(-lists // len(self.coarse))))
        self.apart = np.sqrt(np.maximum(0, _squares(self.coarse, self.coarse))) if len(self.fine) == 1 else None
        self.cross = 2 * self.coarse @ self.fine.T + (self.fine**2).sum(axis=1) + (self.coarse**2).sum(axis=1)[:, None]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.margin, self.groups = far, np.inf
        own, *_ = self.visits(sample, 0.0)
        rest = sample - self.centre(own)
        self.words = [k_means(rest[:, p], CODEWORDS) for p in self.parts]
        self.margin = self._margin(sample, rest, own, cosine) if margin is None else margin
        self.groups = np.inf if self.margin >= far else 2 * self.margin

    def centre(self, cell) -> np.ndarray:
        i, j = np.divmod(cell, len(self.fine))
        return self.coarse[i] + self.fine[j]

    def _margin(self, sample, rest, own, cosine) -> float:
        spread = np.linalg.eigvalsh(rest.T @ rest) if len(rest) else np.zeros(1)
        directions = max(1.0, spread.sum() ** 2 / max((spread**2).sum(), 1e-300))
        far, need = math.sqrt(2 - 2 * cosine), 0.0
        tried = sample[:TRIED_ROWS]
        for at in range(0, len(tried), 512):
            a, b = np.nonzero(tried[at : at + 512] @ tried.T >= cosine)
            a, b = a[a + at < b] + at, b[a + at < b]
            for k in range(0, len(a), 50_000):
                x, y = a[k : k + 50_000], b[k : k + 50_000]
                need = max(need, np.minimum(self._beyond(tried[x], own[x], own[y]), self._beyond(tried[y], own[y], own[x])).max(initial=0.0))
        return min(far, max(REACH * far / math.sqrt(directions), SLACK * need))

    def _beyond(self, rows, own, other) -> np.ndarray:
        """How far each row is from the border of another list."""
        a, b = self.centre(own), self.centre(other)
        apart = np.sqrt(((a - b) ** 2).sum(axis=1))
        return np.where(own == other, 0, (((rows - b) ** 2).sum(axis=1) - ((rows - a) ** 2).sum(axis=1)) / (2 * np.maximum(apart, 1e-12)))

    def codes(self, rows: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the lengths of the errors."""
        rest = rows - self.centre(own)
        codes = np.stack([nearest(rest[:, p], w) for p, w in zip(self.parts, self.words, strict=True)], axis=1).astype(np.uint8)
        error = sum(((rest[:, p] - w[codes[:, m]]) ** 2).sum(axis=1) for m, (p, w) in enumerate(zip(self.parts, self.words, strict=True)))
        return codes, np.sqrt(error)

    def visits(self, rows: np.ndarray, margin: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's own list, and pairs of rows with all lists that they look into."""
        margin = self.margin if margin is None else margin
        own, at, cell = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, 4_000_000 // (len(self.coarse) * len(self.fine) if self.groups == np.inf else 64 * len(self.fine)))
        for k in range(0, len(rows), step):
            found = self._visits(rows[k : k + step], margin)
            for out, x, more in zip((own, at, cell), found, (0, k, 0), strict=True):
                out.append(x + more)
        return tuple(np.concatenate(x) for x in (own, at, cell))

    def _visits(self, rows, margin):
        far = _squares(rows, self.coarse)
        if len(self.fine) == 1:
            own = far.argmin(axis=1)
            near = far - far[np.arange(len(rows)), own][:, None] <= 2 * margin * self.apart[own]
            near[np.arange(len(rows)), own] = True
            return own, *np.nonzero(near)
        # Groups of lists first, where lists stand in groups.
        if self.groups == np.inf:
            row, group = (x.ravel() for x in np.indices(far.shape))
        else:
            best = far.argmin(axis=1)
            apart = np.sqrt(np.maximum(0, _squares(self.coarse[best], self.coarse)))
            near = far - far[np.arange(len(rows)), best][:, None] <= 2 * self.groups * apart
            near[np.arange(len(rows)), best] = True
            row, group = np.nonzero(near)

        def to_lists(x):  # squared distances of each pair's row to the lists of its group
            return (x * x).sum(axis=1)[row][:, None] - 2 * ((x @ self.coarse.T)[row, group][:, None] + (x @ self.fine.T)[row]) + self.cross[group]

        square = to_lists(rows)
        start = np.searchsorted(row, np.arange(len(rows)))
        least = np.minimum.reduceat(square.min(axis=1), start)
        pair, j = np.nonzero(square <= least[row][:, None])
        first = np.unique(row[pair], return_index=True)[1]
        own = group[pair[first]] * len(self.fine) + j[first]
        apart = np.sqrt(np.maximum(0, to_lists(self.centre(own))))
        pair, j = np.nonzero(square - least[row][:, None] <= 2 * margin * apart)
        cell = group[pair] * len(self.fine) + j
        at = row[pair]
        home = np.ones(len(at), bool)
        home[cell == own[at]] = False  # one's own list is always looked into, once
        return own, np.r_[at[home], np.arange(len(rows))], np.r_[cell[home], own]

    def tables(self, rows: np.ndarray, cell: int) -> list[np.ndarray]:
        """Squared distances of each row's residual in the list to the codewords."""
        rest = rows - self.centre(np.array([cell]))
        return [_squares(rest[:, p], w) for p, w in zip(self.parts, self.words, strict=True)]


def compare(q: Quantiser | None, cell: int, ids, rows, codes, error, other_ids, other_rows, cosine: float):
    """Links of visitors to the rows of a list: ``(visitor place, row place)``, exact cosines."""
    far = math.sqrt(2 - 2 * cosine)
    for at in range(0, len(other_ids), 256):
        part = other_rows[at : at + 256]
        if q is None:
            a, b = (x.ravel() for x in np.indices((len(part), len(ids))))
        else:
            square = np.zeros((len(part), len(ids)))
            for m, table in enumerate(q.tables(part, cell)):
                square += table[:, codes[:, m]]
            a, b = np.nonzero(square <= (far + error + 1e-6) ** 2)
        for k in range(0, len(a), 200_000):
            x, y = a[k : k + 200_000], b[k : k + 200_000]
            near = np.einsum("ij,ij->i", part[x], rows[y]) >= cosine
            near &= other_ids[at + x] != ids[y]
            yield at + x[near], y[near]


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, margin: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(did, n_links, component)`` for each row of ``vectors``.

    ``n_links``: how many other rows are linked to it (cosine of at least ``cosine``, in
    double precision); ``component``: the least id reachable.  Vectors that are null, empty
    or zero, or hold null or non-finite components, link with nothing, and neither do
    vectors of different lengths.  Equal vectors are one in the index and count as often as
    they occur.  A null id is larger than any other; rows of one id are rows like any.  With
    a ``margin`` of the distance of a link no link is lost.  An empty table gives an empty one;
    no other column is read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    base = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.col(vector_col).cast("array<double>").alias("v"))
    base = base.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    bad = F.col("v").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    usable = base.where(~F.coalesce(bad, F.lit(True)))
    classes = cut(usable.groupBy("h1", "h2").agg(F.min("did").alias("did"), F.count("*").alias("n"), F.first("v").alias("v")).withColumn("cid", F.col("h1")))
    sizes = classes.groupBy(F.size("v").alias("size")).count()
    often = sizes.orderBy(F.desc("count"), "size").limit(INDEXED_LENGTHS).collect()
    parts = [_links(classes.where(F.size("v") == r["size"]), r["count"], cosine, margin, single) for r in often]
    if len(often) == INDEXED_LENGTHS:
        parts.append(_links(classes.where(~F.size("v").isin([r["size"] for r in often])), 0, cosine, margin, single))
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = cut(found)
    else:
        found = spark.createDataFrame([], "cid long, did long, n long, root long")
    twins = usable.join(classes.where("n > 1").select("h1", "h2", F.col("did").alias("rep")), ["h1", "h2"]).select(F.col("did").alias("a"), F.col("rep").alias("b"))
    group = components(found.where("root is not null").select(F.col("did").alias("a"), F.col("root").alias("b")).unionByName(twins))
    links = found.groupBy("cid").agg(F.sum("n").alias("links"))
    whole = classes.select("h1", "h2", "cid", F.col("did").alias("rep"), "n").join(links, "cid", "left").join(group, F.col("rep") == F.col("id"), "left")
    whole = whole.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"), F.lit(True).alias("ok"))
    out = base.select("did", "h1", "h2", F.coalesce(bad, F.lit(True)).alias("bad")).join(whole, ["h1", "h2"], "left")
    return out.select("did", F.when(F.col("bad"), 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(F.col("bad"), F.col("did")).otherwise(F.col("component")).alias("component"))


def fit(classes: DataFrame, rows: int, cosine: float, margin: float | None) -> Quantiser:
    """The quantisers of ``rows`` vectors of one length, from the first SAMPLE_ROWS in the order of a hash."""
    sample = classes.orderBy("h2", "h1").limit(SAMPLE_ROWS).select("v").toArrow().column("v").combine_chunks()
    vectors = unit(next(m for *_, m in matrices(pa.array(np.arange(len(sample))), sample)))
    return Quantiser(vectors, max(1, min(MAX_LISTS, rows // LIST_ROWS)), cosine, margin)


def _links(classes: DataFrame, rows: int, cosine: float, margin: float | None, single: bool) -> DataFrame:
    """``(cid, did, n, root)``: links found by a task, and the least id it joins a vector to.

    ``rows`` vectors of one length get an index.  With no ``rows`` they are of many lengths, and
    each length is one list that is compared without codes.
    """
    q = fit(classes, rows, cosine, margin) if rows else None
    real = np.float32 if single else np.float64

    def binary(rows: np.ndarray) -> pa.Array:
        width = rows.dtype.itemsize * rows.shape[1]
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())

    def index(batches):
        for batch in batches:
            for places, _, m in matrices(batch.column("did"), batch.column("v")):
                if q is None:
                    own = np.full(len(m), m.shape[1], np.int64)
                    row, cell, codes, error = np.arange(len(m)), own, np.zeros((len(m), 1), np.uint8), np.zeros(len(m))
                else:
                    vectors = unit(m)
                    own, row, cell = q.visits(vectors)
                    codes, error = q.codes(vectors, own)
                home = own[row] == cell
                order = np.argsort(row, kind="stable")
                ends = np.searchsorted(row[order], np.arange(len(m) + 1))
                # A vector's row in its own list says which lists it looks into.
                lists = [cell[order[ends[r] : ends[r + 1]]] if h else cell[:0] for r, h in zip(row, home)]
                seen = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in lists])], pa.int32()), pa.array(np.concatenate([cell[:0], *lists]), pa.int64()))
                take = pa.array(places[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(own[row]), *(batch.column(c).take(take) for c in ("cid", "did", "n")), binary(m[row].astype(real)), binary(codes[row]), pa.array(error[row]), seen],
                    ["cell", "own", "cid", "did", "n", "vector", "code", "error", "seen"],
                )

    dealt = cut(classes.select("cid", "did", "n", "v").mapInArrow(tidied(index), "cell long, own long, cid long, did long, n long, vector binary, code binary, error double, seen array<long>"))
    sizes = cut(dealt.groupBy("cell").agg(F.ceil(F.count_if(F.col("own") == F.col("cell")) / LIST_BLOCK).cast("int").alias("lists"), F.ceil(F.count("*") / VISIT_BLOCK).cast("int").alias("visits")).where("lists > 0"))
    rows_ = dealt.join(small(sizes), "cell")
    side = F.pmod(F.xxhash64("cid"), F.col("lists")), F.pmod(F.xxhash64(F.lit(3), "cid"), F.col("visits"))
    held = rows_.where("own = cell").withColumn("i", side[0]).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("visits") - 1))).withColumn("visit", F.lit(False))
    come = rows_.withColumn("j", side[1]).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lists") - 1))).withColumns({"visit": F.lit(True), "code": F.lit(None).cast("binary"), "seen": F.lit(None).cast("array<long>")})
    columns = ["cell", "own", "cid", "did", "n", "vector", "code", "error", "seen", "visit", "i", "j"]
    fix = lambda df: df.withColumns({"i": F.col("i").cast("int"), "j": F.col("j").cast("int")}).select(*columns)
    pairs = fix(held).unionByName(fix(come))

    def run(key, table):
        cell = key[0].as_py()
        visit = np.asarray(table.column("visit").combine_chunks())
        did, n, cid, own = (np.asarray(table.column(c).combine_chunks()) for c in ("did", "n", "cid", "own"))
        vector = unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), real).reshape(len(did), -1).astype(np.float64))
        here, come = np.flatnonzero(~visit), np.flatnonzero(visit)
        at_home = table.filter(pa.array(~visit))
        codes = np.frombuffer(b"".join(at_home.column("code").to_pylist()), np.uint8).reshape(len(here), -1) if len(here) else np.zeros((0, 1), np.uint8)
        error = np.asarray(at_home.column("error").combine_chunks())
        seen = at_home.column("seen").combine_chunks()
        looks = {(h, c) for h, some in enumerate(seen.to_pylist()) for c in some}
        links, ends = np.zeros(len(did), np.int64), ([], [])
        for a, b in compare(q, cell, cid[here], vector[here], codes, error, cid[come], vector[come], cosine):
            np.add.at(links, come[a], n[here[b]])
            # Rows of the list that do not look into the visitor's own list would miss it.
            lost = np.fromiter((p not in looks for p in zip(b.tolist(), own[come[a]].tolist())), bool, len(a))
            np.add.at(links, here[b[lost]], n[come[a[lost]]])
            ends[0].append(come[a])
            ends[1].append(here[b])
        order = np.argsort(did, kind="stable")
        place = np.empty(len(did), np.int64)
        place[order] = np.arange(len(did))
        a, b = (place[np.concatenate(e)] if e else np.zeros(0, np.int64) for e in ends)
        root = did[order[local_labels(len(did), a, b)]][place]
        keep = (links > 0) | (root != did)
        return pa.table({"cid": cid[keep], "did": did[keep], "n": links[keep], "root": pa.array(root[keep], mask=(root == did)[keep])})

    return pairs.groupBy("cell", "i", "j").applyInArrow(run, "cid long, did long, n long, root long")


def digest(vectors: DataFrame) -> DataFrame:
    """The query's columns: ``vec_id``, ``n_links``, ``component_id`` and whether the vector is ``kept``."""
    out = near_duplicates(vectors)
    component = F.when(F.col("component") != NO_ID, F.col("component"))
    return out.select(public_id().alias("vec_id"), "n_links", component.alias("component_id"), (F.col("did") == F.col("component")).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
      AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT l.a, r.root FROM r JOIN l ON l.b = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.id = c.component_id AS kept FROM c LEFT JOIN n ON n.a = c.id
"""
