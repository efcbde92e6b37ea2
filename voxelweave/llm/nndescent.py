"""Approximate nearest neighbours (operator 11) by NN-descent and greedy graph search.

``build`` makes a neighbour graph.  Random hyperplanes deal vectors into buckets, and the best
pairs inside each are the first graph.  Then rounds of joins: every node gathers its
neighbours and those that it is a neighbour of, any two of them are compared, and whoever
finds a better neighbour takes it.  A pair is compared again only if one of its ends is new in
that neighbourhood; rounds end when hardly any neighbour is new.

``search`` answers queries on the graph, all at the same time: each has a beam of the best
nodes found so far, and every round joins the nodes of the beam that were not opened yet with
their neighbours.  A query that is a row of the table starts at its own node as well as at the
nearest of some sampled nodes.  What remains is ranked by the exact inner product.

Equal vectors are one node.  Vectors get one more component that makes all of them equally
long (zero for the longest), so the largest inner product is the least distance, and are
compared by one byte a component with a scale for each vector.  Neither a node's neighbours nor
a query's beam are ever gathered beyond a fixed number; neighbourhoods of more than MEMBERS
nodes (of a node that many have as their neighbour) are dealt anew into blocks each round.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, prepare, shared_dir, small, tidied
from .vectors import matrices

#: Neighbours of a node in the graph, and at most with those that it is a neighbour of, for the search.
NEIGHBOURS, DEGREE = 32, 64
#: Tables of hyperplanes that the first graph comes from, and vectors of a bucket on average at most.
TABLES, BUCKET = 10, 1024
#: Nodes of a neighbourhood (or of a bucket, BUCKET) that are compared with each other in one block.
MEMBERS = 128
#: Rounds at most, and the share of new neighbours below which the graph is settled.
ROUNDS, SETTLED = 8, 0.03
#: Nodes of a beam, rounds of the search at most, and nodes of a beam that are ranked exactly for one wanted.
BEAM, SEARCHES, RANKED = 144, 8, 3
#: Vectors that borders of buckets are taken from, sampled nodes a query may start at, and at how many it does.
SAMPLE_ROWS, PIVOTS, STARTS = 4096, 1024, 8
#: Lengths of vectors that get buckets of their own size; those of rarer lengths are one bucket each, in blocks.
LENGTHS = 1000
#: Rows of a task.
TASK_ROWS = 60_000

_CODE = "nid long, code binary, scale float"


@dataclass(frozen=True)
class Graph:
    """An index: ``nodes(nid, v, ids, h1, h2)``, their codes, the lists of neighbours, and the table that is searched."""

    nodes: DataFrame
    codes: DataFrame
    neighbours: DataFrame
    table: str
    rounds: int

    def drop(self) -> None:
        """Remove its tables once nothing reads them any more."""
        spark = self.nodes.sparkSession
        for t in (self.nodes, self.codes, self.neighbours, spark.table(self.table)):
            drop_cut(t)  # dropping an external table alone would leave its files
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")


# ---- tasks


def _whole_runs(batches, key: str, most: int):
    """Tables of about ``most`` rows from batches sorted by ``key``; no key is in two tables."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = np.asarray(table.column(key))
            end = int(np.searchsorted(keys, keys[-1]))
            if end:
                yield table.slice(0, end)
            held = table.slice(end).to_batches()
            rows = table.num_rows - end
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(values, kind))


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and counts of a column of lists."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return np.asarray(lists.flatten()), np.diff(np.asarray(lists.offsets))


def _by_length(codes):
    """``(places, matrix of bytes)`` for each length of code."""
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
    codes = codes.cast(pa.large_binary())
    offsets = np.frombuffer(codes.buffers()[1], np.int64)[codes.offset : codes.offset + len(codes) + 1]
    data, sizes = np.frombuffer(codes.buffers()[2] or b"", np.int8), np.diff(offsets)
    for size in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == size)
        yield places, data[offsets[places][:, None] + np.arange(size)]


def encoded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte a component, and what one unit of each row's bytes stands for."""
    most = np.abs(unit).max(axis=1, initial=0)
    scale = np.where(most > 0, most / 127, 1)
    return np.rint(unit / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.dtype.itemsize * rows.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def pairs_within(group: np.ndarray, vectors: np.ndarray, fresh: np.ndarray, worst: np.ndarray, k: int):
    """``(place, other place, score)``: for each row of sorted groups the up to ``k`` best others of its
    group that are better than its ``worst``; of two rows one at least is fresh."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    order = np.argsort(size, kind="stable")
    at = int(np.searchsorted(size[order], 2))  # one row alone meets none
    while at < len(order):
        most = int(size[order[at]])
        end = at + 1
        while end < len(order) and (end + 1 - at) * int(size[order[end]]) ** 2 <= 2_000_000:
            end += 1
        some, at = order[at:end], end
        most = int(size[some].max())
        place = start[some][:, None] + np.arange(most)
        real = np.arange(most) < size[some][:, None]
        place = np.where(real, place, 0)
        x = vectors[place]
        score = x @ x.transpose(0, 2, 1)
        new = fresh[place] & real
        use = (new[:, :, None] | new[:, None, :]) & real[:, :, None] & real[:, None, :] & (score > worst[place][:, :, None])
        use[:, np.arange(most), np.arange(most)] = False
        score[~use] = -np.inf
        if most > k:
            top = np.argpartition(-score, k - 1, axis=2)[:, :, :k]
            score = np.take_along_axis(score, top, axis=2)
        else:
            top = np.broadcast_to(np.arange(most), score.shape)
        g, i, j = np.nonzero(score > -np.inf)
        yield place[g, i], place[g, top[g, i, j]], score[g, i, j]


def _local_join(members: DataFrame, state: DataFrame, rows: int, k: int) -> DataFrame:
    """``(key, ids, scores, flags)``: what each node finds in the blocks ``members(g, nid, fresh)`` it is in."""

    def run(batches):
        for table in _whole_runs(batches, "g", 20_000):
            nid, g, fresh, worst, scale = (np.asarray(table.column(c)) for c in ("nid", "g", "fresh", "worst", "scale"))
            for places, codes in _by_length(table.column("code")):
                vectors = codes.astype(np.float32) * scale[places, None]
                for a, b, score in pairs_within(g[places], vectors, fresh[places], worst[places], k):
                    order = np.argsort(a, kind="stable")
                    a, b, score = places[a[order]], places[b[order]], score[order]
                    own = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
                    counts = np.diff(np.r_[own, len(a)])
                    for i in range(0, len(own), 2000):
                        s, e = own[i], (own[i + 2000] if i + 2000 < len(own) else len(a))
                        n = counts[i : i + 2000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(nid[a[own[i : i + 2000]]]), _lists(nid[b[s:e]], n, pa.int64()), _lists(score[s:e], n, pa.float32()), _lists(np.zeros(e - s, bool), n, pa.bool_())],
                            ["key", "ids", "scores", "flags"],
                        )

    joined = members.join(state, "nid").select("g", "nid", "fresh", "code", "scale", "worst")
    return joined.repartition(max(1, -(-rows // TASK_ROWS)), "g").sortWithinPartitions("g").mapInArrow(tidied(run), "key long, ids array<long>, scores array<float>, flags array<boolean>")


def _merged(lists: DataFrame, parts: int, k: int) -> DataFrame:
    """The ``k`` best of each ``key``'s ``ids``; the flag of an id is true if one of its is.  ``worst``: the kth score."""

    def run(batches):
        for table in _whole_runs(batches, "key", 20_000):
            ids, counts = _flat(table.column("ids"))
            key, score, flag = np.repeat(np.asarray(table.column("key")), counts), _flat(table.column("scores"))[0], _flat(table.column("flags"))[0]
            order = np.lexsort((~flag, ids, key))
            key, ids, score, flag = (x[order] for x in (key, ids, score, flag))
            once = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])] if len(key) else np.zeros(0, bool)
            key, ids, score, flag = (x[once] for x in (key, ids, score, flag))
            order = np.lexsort((ids, -score, key))
            key, ids, score, flag = (x[order] for x in (key, ids, score, flag))
            keep = np.arange(len(key)) - np.searchsorted(key, key) < k
            key, ids, score, flag = (x[keep] for x in (key, ids, score, flag))
            own = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            counts = np.diff(np.r_[own, len(key)])
            worst = np.where(counts == k, score[own + counts - 1], -np.inf) if len(own) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[own]), _lists(ids, counts, pa.int64()), _lists(score, counts, pa.float32()), _lists(flag, counts, pa.bool_()), pa.array(worst, pa.float32())],
                ["key", "ids", "scores", "flags", "worst"],
            )

    return lists.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidied(run), "key long, ids array<long>, scores array<float>, flags array<boolean>, worst float")


# ---- the graph


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("v")
    bad = v.isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True))).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})


def _matrix(rows: list, length: int) -> np.ndarray:
    return np.array([r for r in rows if len(r) == length], np.float64).reshape(-1, length)


def _blocks(members: DataFrame, most: int, seed: int) -> DataFrame:
    """``members(g, nid, fresh)`` with groups of more than ``most`` dealt into blocks of about so many."""
    crowded = cut(members.groupBy("g").count().where(F.col("count") > most).select("g", F.ceil(F.col("count") / most).cast("int").alias("blocks")))
    block = F.when(F.col("blocks").isNull(), F.col("g")).otherwise(F.xxhash64("g", F.pmod(F.xxhash64(F.lit(seed), "nid"), F.col("blocks"))))
    return members.join(small(crowded), "g", "left").select(block.alias("g"), "nid", "fresh")


def _padded(m: np.ndarray, scale: float, longest: float) -> np.ndarray:
    """Rows by the longest length, with the component that makes all of them equally long."""
    m = m / scale / longest
    return np.column_stack((m, np.sqrt(np.maximum(0, 1 - (m * m).sum(axis=1)))))


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", neighbours: int = NEIGHBOURS, copies: int = 21, rounds: int = ROUNDS) -> Graph | None:
    """The neighbour graph of all usable rows; None if there is none.

    Rows with a null id and vectors that are null, empty or zero or hold null or non-finite
    components take no part.  Equal vectors are one node, which knows its ``copies`` smallest
    ids (a search for ``copies - 1`` needs no more).  Vectors of different lengths are never
    neighbours.  Borders of buckets are fitted on SAMPLE_ROWS rows; every row is a node.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    usable = _usable(vectors, id_col, vector_col)
    first = usable.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("r") <= copies)
    nodes = first.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("nid"), "v", "ids", "h1", "h2"))
    count, scale = nodes.agg(F.count("*"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    if not count:
        drop_cut(nodes)
        return None
    longest = nodes.select(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x / F.lit(scale) * x / F.lit(scale))).alias("n")).agg(F.max("n")).first()[0]
    lengths = {r["size"]: r["count"] for r in nodes.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(LENGTHS).collect()}
    bits = {size: max(0, int(np.ceil(np.log2(n / BUCKET)))) if n > BUCKET else 0 for size, n in lengths.items()}
    sample = [r["v"] for r in nodes.orderBy("h2", "h1").limit(SAMPLE_ROWS).select("v").collect()]
    planes, borders = {}, {}
    for size, b in bits.items():
        if b:
            planes[size] = np.random.default_rng(size).standard_normal((size + 1, TABLES * b))
            own = _matrix(sample, size)
            borders[size] = np.median(_padded(own, scale, longest) @ planes[size], axis=0) if len(own) else np.zeros(TABLES * b)

    def code(batches):
        for batch in batches:
            for places, _, m in matrices(batch.column("nid"), batch.column("v")):
                unit = _padded(m, scale, longest)
                codes, step = encoded(unit)
                size = m.shape[1]
                marks = np.zeros((len(m), TABLES), np.int64)
                if size in planes:
                    high = unit @ planes[size] > borders[size]
                    marks = high.reshape(len(m), TABLES, -1) @ (1 << np.arange(bits[size], dtype=np.int64))
                counts = np.full(len(m), TABLES)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("nid").take(pa.array(places)), _binary(codes), pa.array(step), pa.array(np.full(len(m), size), pa.int32()), _lists(marks.ravel(), counts, pa.int64())],
                    ["nid", "code", "scale", "size", "marks"],
                )

    codes = cut(nodes.select("nid", "v").mapInArrow(tidied(code), _CODE + ", size int, marks array<long>"))
    parts = max(1, -(-count // 10_000), min(12, count // 500))
    held = codes.select("nid", F.posexplode("marks").alias("t", "mark"), "size").select(F.xxhash64("size", "t", "mark").alias("g"), "nid", F.lit(True).alias("fresh"))
    lone = codes.select("nid", "code", "scale", F.lit(float("-inf")).cast("float").alias("worst"))
    graph = cut(_merged(_local_join(_blocks(held, BUCKET, 0), lone, count * TABLES, neighbours), parts, neighbours))
    done = 0
    while done < rounds:
        done += 1
        edge = graph.select("key", F.explode(F.arrays_zip("ids", "flags")).alias("e")).select("key", F.col("e.ids").alias("other"), (~F.col("e.flags")).alias("fresh"))
        both = edge.select(F.col("key").alias("g"), F.col("other").alias("nid"), "fresh").unionByName(edge.select(F.col("other").alias("g"), F.col("key").alias("nid"), "fresh"))
        members = cut(both.groupBy("g", "nid").agg(F.max("fresh").alias("fresh")))
        state = codes.select("nid", "code", "scale").join(graph.select(F.col("key").alias("nid"), "worst"), "nid", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf")).cast("float")))
        found = _local_join(_blocks(members, MEMBERS, done), state, count * neighbours * 2, neighbours)
        old = graph.select("key", "ids", "scores", F.transform("flags", lambda _: F.lit(True)).alias("flags"))
        after = cut(_merged(old.unionByName(found), parts, neighbours))
        drop_cut(members)
        drop_cut(graph)
        graph = after
        new = graph.select(F.coalesce(F.sum(F.size(F.filter("flags", lambda f: ~f))), F.lit(0))).first()[0]
        if new <= SETTLED * count * neighbours:
            break
    return Graph(nodes, codes, graph, _opened(graph, codes, count), done)


def _opened(graph: DataFrame, codes: DataFrame, count: int) -> str:
    """A bucketed table ``(g, ids, scales, codes)`` of each node's neighbours, either way, and their codes: the search
    joins it every round, and only the short rows of its beams are shuffled."""
    spark = graph.sparkSession
    edge = graph.select("key", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("key", F.col("e.ids").alias("other"), F.col("e.scores").alias("score"))
    both = edge.select(F.col("key").alias("g"), F.col("other").alias("nid"), "score").unionByName(edge.select(F.col("other").alias("g"), F.col("key").alias("nid"), "score"))
    both = both.groupBy("g", "nid").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "nid"))
    best = both.withColumn("r", rank).where(F.col("r") <= DEGREE).select("g", "nid")

    def run(batches):
        for table in _whole_runs(batches, "g", 5_000):
            g, nid, scale = (np.asarray(table.column(c)) for c in ("g", "nid", "scale"))
            for places, rows in _by_length(table.column("code")):
                own = np.flatnonzero(np.r_[True, g[places][1:] != g[places][:-1]])
                counts = np.diff(np.r_[own, len(places)])
                ends = pa.array(np.r_[0, np.cumsum(counts)] * rows.shape[1], pa.int32())
                blob = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows))])
                yield pa.RecordBatch.from_arrays([pa.array(g[places][own]), _lists(nid[places], counts, pa.int64()), _lists(scale[places], counts, pa.float32()), blob], ["g", "ids", "scales", "codes"])

    parts = min(10_000, max(spark.sparkContext.defaultParallelism, -(-count // 10_000)))
    dealt = best.join(codes.select("nid", "code", "scale"), "nid").repartition(parts, "g").sortWithinPartitions("g")
    name = f"neighbours_{uuid.uuid4().hex}"
    out = dealt.mapInArrow(tidied(run), "g long, ids array<long>, scales array<float>, codes binary")
    out.repartition(parts, "g").write.bucketBy(parts, "g").sortBy("g").option("path", f"{shared_dir(spark)}/voxelweave/{uuid.uuid4().hex}").saveAsTable(name)
    return name


# ---- the search


def _asked(graph: Graph, queries: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(qid, v, code, scale, starts)``: queries with the sampled nodes nearest to them and their own node."""
    spark = queries.sparkSession
    asked = _usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min(F.struct("v", "h1", "h2")).alias("q")).select(F.col("vec_id").alias("qid"), "q.*")
    asked = asked.join(graph.nodes.select("h1", "h2", "nid"), ["h1", "h2"], "left")
    pivots = graph.nodes.orderBy("h1", "h2").limit(PIVOTS).select("nid", "v").collect()  # PIVOTS rows at most
    own = np.array([p["nid"] for p in pivots], np.int64)
    sizes = np.array([len(p["v"]) for p in pivots])
    held = {s: (own[sizes == s], _matrix([p["v"] for p in pivots], s)) for s in np.unique(sizes).tolist()}

    def run(batches):
        for batch in batches:
            for places, _, m in matrices(batch.column("qid"), batch.column("v")):
                unit = m / np.abs(m).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                codes, step = encoded(np.column_stack((unit, np.zeros(len(m)))))
                ids, rows = held.get(m.shape[1], (own[:0], np.zeros((0, m.shape[1]))))
                starts = ids[np.argsort(-(unit @ rows.T), axis=1)[:, :STARTS]]
                nid = batch.column("nid").take(pa.array(places)).to_pylist()
                starts = [[*dict.fromkeys([*([n] if n is not None else []), *s])] for n, s in zip(nid, starts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(places)), batch.column("v").take(pa.array(places)), _binary(codes), pa.array(step), pa.array(starts, pa.list_(pa.int64()))], ["qid", "v", "code", "scale", "starts"])

    kind = asked.schema["v"].dataType.simpleString()
    return cut(asked.select("qid", "v", "nid").mapInArrow(tidied(run), f"qid long, v {kind}, code binary, scale float, starts array<long>"))


def _opened_scores(batches):
    """Scores of the neighbours of each row's node that are better than the query's worst."""
    for batch in batches:
        ids, counts = _flat(batch.column("ids"))
        scales = _flat(batch.column("scales"))[0]
        at = np.repeat(np.arange(batch.num_rows), counts)
        start = np.cumsum(counts) - counts
        worst, own_scale = np.asarray(batch.column("worst")), np.asarray(batch.column("scale"))
        codes = batch.column("codes")
        score = np.full(len(ids), -np.inf, np.float32)
        for places, rows in _by_length(batch.column("code")):
            for p, row in zip(places.tolist(), rows.astype(np.float32)):
                near = np.frombuffer(codes[p].as_buffer(), np.int8).reshape(counts[p], -1)
                span = slice(start[p], start[p] + counts[p])
                score[span] = (near.astype(np.float32) @ row) * scales[span] * own_scale[p]
        keep = score > worst[at]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), *(_lists(x[keep], np.bincount(at[keep], minlength=batch.num_rows), kind) for x, kind in ((ids, pa.int64()), (score, pa.float32()), (np.zeros(len(ids), bool), pa.bool_())))],
            ["key", "ids", "scores", "flags"],
        )


def search(graph: Graph | None, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest that each query's search found, by inner product.

    A query never meets rows of its own id; equal scores rank by smaller id.  Queries with a
    null id or an unusable vector give no row; of several with one id the least vector counts.
    """
    spark = queries.sparkSession
    if graph is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = _asked(graph, queries, id_col, vector_col)
    count = asked.count()
    parts = max(1, -(-count // 2000), min(12, count // 100))
    index = spark.table(graph.table)
    code = asked.select(F.col("qid").alias("key"), "code", "scale")
    # A start has no score yet: its node is opened first, then found again by its neighbours or scored at the end.
    state = cut(asked.select(F.col("qid").alias("key"), F.col("starts").alias("ids"), F.transform("starts", lambda _: F.lit(-2.0).cast("float")).alias("scores"), F.transform("starts", lambda _: F.lit(False)).alias("flags"), F.lit(float("-inf")).cast("float").alias("worst")))
    for _ in range(SEARCHES):
        front = state.select("key", "worst", F.explode(F.arrays_zip("ids", "flags")).alias("e")).where("not e.flags").select("key", "worst", F.col("e.ids").alias("g"))
        rows = front.join(code, "key").join(index, "g").select("key", "worst", "code", "scale", "ids", "scales", "codes")
        found = rows.mapInArrow(tidied(_opened_scores), "key long, ids array<long>, scores array<float>, flags array<boolean>").where(F.size("ids") > 0)
        opened = state.select("key", "ids", "scores", F.transform("flags", lambda _: F.lit(True)).alias("flags"))
        after = cut(_merged(opened.unionByName(found), parts, beam))
        drop_cut(state)
        state = after
        left = state.select(F.coalesce(F.sum(F.size(F.filter("flags", lambda f: ~f))), F.lit(0))).first()[0]
        if left <= count:  # about one node a query: another round would find hardly anything
            break
    starts = asked.select("qid", F.explode("starts").alias("nid"))
    pair = state.select(F.col("key").alias("qid"), F.explode(F.slice("ids", 1, RANKED * k)).alias("nid")).unionByName(starts).distinct()
    pair = pair.join(graph.nodes.select("nid", "ids", F.col("v").alias("other")), "nid").join(asked.select("qid", "v"), "qid")

    def exact(batches):
        for batch in batches:
            score = np.zeros(batch.num_rows)
            theirs = {int(p): r for places, _, m in matrices(batch.column("qid"), batch.column("other")) for p, r in zip(places, m)}
            for places, _, m in matrices(batch.column("qid"), batch.column("v")):
                score[places] = np.einsum("ij,ij->i", m, np.stack([theirs[int(p)] for p in places]))
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("ids"), pa.array(score)], ["query_id", "ids", "score"])

    ranked = pair.select("qid", "ids", "v", "other").mapInArrow(tidied(exact), "query_id long, ids array<long>, score double")
    ranked = ranked.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank: Column = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = cut(ranked.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    for t in (state, asked):
        drop_cut(t)
    return out


def digest(vectors: DataFrame) -> DataFrame:
    """The query's columns: the 20 nearest rows found for each vector whose id is divisible by 20.

    Ties rank by smaller id; null ids and unusable vectors take no part; an empty table gives an empty one.
    """
    graph = build(vectors)
    out = search(graph, vectors.where(F.col("vec_id") % 20 == 0))
    if graph is not None:
        graph.drop()
    return out
