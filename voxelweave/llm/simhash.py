"""SimHash near-duplicates (operator 10), found in a Gray-order hierarchical index.

Fingerprints are kept in Gray-code order.  The top nodes of the index mask some bits of a
code; a node is the unit that is dealt out.  There is one set of top nodes for each mask,
and the masks are chosen so that, by the pigeonhole principle, two fingerprints within the
limit agree under at least one of them.  Below a top node ``graytree`` follows the tree.

``near_duplicates`` links fingerprints of a few differing bits.  ``similar_documents`` links
texts whose sets of shingles have a similarity of at least 0.8.  Such texts differ in about
ten of 64 bits, so they get ten fingerprints of their sets and meet under any of the 40
masks of 16 bits; what lies within the limits of the tree is compared by whole sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, cut, drop_cut, keyed, prepare, public_id, small, tidied
from .components import components, local_labels
from .graytree import linked
from .wordhash import mix, split_words, window_hashes, word_hashes

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LANES = np.uint64(0x0101010101010101)
#: Codes of one node that a task holds; larger nodes are dealt out as pairs of blocks.
NODE_CODES = 40_000
#: Codes that a top node has on average at most before masks of more bits are taken.
CROWD = 4096
#: Rows a task of the search gets on average.
TASK_ROWS = 100_000
#: Fingerprints of a set, and the differing bits of 64 and of 128 up to which two sets are
#: compared.  At similarity 0.8 they are 9.7 +- 2.9 and 19.4 +- 4.1.
SKETCHES, SKETCH_LIMIT, PAIR_LIMIT = 10, 17, 30
#: Shingles of one block of a group, of the part of a group that may meet every block, and of a
#: task, in the comparison of sets; and how many sets of a group all its blocks hold, on average.
BLOCK_SHINGLES, REST_SHINGLES, TASK_SHINGLES, PIVOTS = 16_000, 500_000, 500_000, 8
#: Shingles from which on a block is compared in slices of the range of hashes, and bytes of shingles sent on at a time.
SLICE_SHINGLES, SEND_BYTES = 1_000_000, 4 << 20
_DEALT = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())


def bit_counts(hashes: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, least bit first.

    With ``starts`` (ascending, of groups that are not empty) a row for each group.
    """
    heads = np.zeros(1, np.int64) if starts is None else starts
    if not len(hashes):
        return np.zeros(64, np.int64) if starts is None else np.zeros((0, 64), np.int64)
    # Eight counters of a byte each side by side, so at most 255 hashes are summed at a time.
    sizes = np.diff(np.r_[heads, len(hashes)])
    per = -(-sizes // 255)
    first = np.cumsum(per) - per
    parts = np.repeat(heads, per) + 255 * (np.arange(per.sum()) - np.repeat(first, per))
    total = np.empty((len(heads), 8, 8), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, parts)
        total[:, :, k] = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int64)
    total = total.reshape(-1, 64)
    return total[0] if starts is None else total


def _codes(counts: np.ndarray, sizes) -> np.ndarray:
    """Codes whose bits are those that more than half of the hashes have."""
    bits = counts * 2 > np.asarray(sizes)[..., None]
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")[..., 0].astype(np.uint64)


def shingle_hashes(text: str, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle; a text of fewer words is one shingle, one without words none."""
    found = text.encode().translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    if len(found) > words:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends - 1).tolist(), strict=True)], np.uint64, len(starts))


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """A bit is set if more than half of the shingles' XXH64 have it; no word gives zero."""
    hashes = shingle_hashes(text, words, seed)
    return int(_codes(bit_counts(hashes), len(hashes))) if len(hashes) else 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).astype(np.uint64).view(np.int64), pa.int64())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(did, rk, fp)``: the fingerprint of each row's whole text, as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("rk"), _signed(fps)], ["did", "rk", "fp"])

    return keyed(docs, id_col, text_col).mapInArrow(tidied(run), "did long, rk long, fp long")


# ---- the index


def masks(rows: int, limit: int = 3) -> list[int]:
    """Masks of as many bits as keep top nodes small, such that any two codes that differ in
    at most ``limit`` bits agree under one of them: all but ``limit`` of some ranges of bits."""
    ranges = limit + 1
    while ranges < 8 and rows >> (64 * (ranges - limit) // ranges) >= CROWD:
        ranges += 1
    edge = [64 * k // ranges for k in range(ranges + 1)]
    part = [(1 << b) - (1 << a) for a, b in zip(edge, edge[1:])]
    return [sum(some) for some in combinations(part, ranges - limit)]


def _masked(code: Column, mask: int) -> Column:
    return code.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def _together(label: np.ndarray, ends: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*ends, strict=True) if ends else ((), ())))
    return local_labels(len(label), label[a], label[b])[label]


def search(nodes: DataFrame, tables: int, rows: int, limit: int = 3, wide_limit: int = 0, node_codes: int = NODE_CODES) -> DataFrame:
    """Edges ``(a, b)`` that connect all ``id`` of ``nodes(id, code, wide, node)`` that are close in a node.

    With ``wide_limit`` the 64 bits of ``wide`` count too.  ``rows`` and ``tables``: how many ids there
    are, and how often each stands in ``nodes``.
    """
    crowded = cut(nodes.groupBy("node").count().select("node", F.ceil(F.col("count") / node_codes).cast("int").alias("blocks")).where("blocks > 1"))
    dealt = nodes.join(small(crowded), "node", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("code", "wide"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "code", "wide", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("key"))

    def run(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        own, code, wide, key = (np.asarray(table.column(c)) for c in ("id", "code", "wide", "key"))
        ids, at = np.unique(own, return_inverse=True)
        every, ends = np.arange(len(ids)), []
        label = every
        more = {"wide": wide.view(np.uint64), "wide_limit": wide_limit} if wide_limit else {}
        for a, b in linked(key, code.view(np.uint64), limit, **more):
            ends.append((at[a], at[b]))
            if sum(len(x) for x, _ in ends) > 2_000_000:
                label, ends = _together(label, ends), []
        label = _together(label, ends)
        far = label != every
        yield pa.RecordBatch.from_arrays([pa.array(ids[far], pa.int64()), pa.array(ids[label[far]], pa.int64())], ["a", "b"])

    return dealt.repartition(max(1, -(-tables * rows // TASK_ROWS), min(12, rows // 500)), "key").mapInArrow(tidied(run), "a long, b long")


def links(classes: DataFrame, limit: int = 3, node_codes: int = NODE_CODES) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints ``fp`` which differ in at most ``limit`` bits."""
    rows = classes.count()
    wanted = masks(rows, limit)
    tops = F.array(*[F.xxhash64(F.lit(k), _masked(F.col("fp"), m)) for k, m in enumerate(wanted)])
    nodes = classes.select(F.col("fp").alias("id"), F.col("fp").alias("code"), F.lit(0).cast("long").alias("wide"), F.explode(tops).alias("node"))
    return search(nodes, len(wanted), rows, limit, node_codes=node_codes)


def representatives(own: DataFrame, *more: str) -> DataFrame:
    """A row for each ``fp``: the first document that has it, with the key of a text of its (of null ids: the least key)."""
    out = own.groupBy("fp").agg(F.min("did").alias("did"), F.min_by("rk", "did").alias("rk"), F.min("rk").alias("least"), *[F.first(c).alias(c) for c in more])
    head = F.struct("did", F.when(F.col("did") == NO_ID, F.col("least")).otherwise(F.col("rk")).alias("rk"))
    return cut(out.select("fp", head.alias("head"), *more))


def joined(own: DataFrame, edges: DataFrame, classes: DataFrame) -> DataFrame:
    """``(did, rk, fp, component, head)`` from rows, the links of their ``fp`` and its classes.

    ``head`` is the first document of the group with the key of its text.  Texts of one id are
    one document; rows with a null id are documents of their own.
    """
    known = own.where(F.col("did") != NO_ID)
    shared = known.groupBy("did").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("did", "x")
    tie = known.join(shared, "did").select(F.col("fp").alias("a"), F.col("x").alias("b"))
    found = cut(components(edges.unionByName(tie)))
    heads = found.join(classes.select(F.col("fp").alias("id"), "head"), "id").groupBy("component").agg(F.min("head").alias("top"))
    top = cut(found.join(heads, "component").select(F.col("id").alias("fp"), "top"))
    whole = classes.select("fp", "head").join(small(top), "fp", "left").select("fp", F.coalesce("top", "head").alias("head"))
    return own.join(whole, "fp").select("did", "rk", "fp", F.col("head.did").alias("component"), "head")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, limit: int = 3) -> DataFrame:
    """``(did, rk, fp, component, head)`` for each row; ``component`` is the least id reachable.

    Texts that are null or without words have fingerprint zero and link like any other.
    Rows that share an id are one document.  A null id counts as the largest id of all, and
    each row that has one is a document of its own.  Copies have one fingerprint, so a group
    of exact copies is one code in the index.  An empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    own = cut(fingerprints(docs, id_col, text_col, words).select("did", "rk", "fp"))
    classes = representatives(own)
    return joined(own, links(classes, limit), classes)


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: ``doc_id``, its ``fingerprint`` in hex and ``component_id`` (null ids: null)."""
    out = near_duplicates(docs)
    return out.select(public_id().alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"))


# ---- similarity of whole sets


def batch_sets(texts, words: int) -> list[np.ndarray]:
    """The distinct shingles of each text as ascending hashes; words are lower-cased in A-Z.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    coded, offsets = split_words(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    own = word_hashes(coded)
    all_, out = window_hashes(own, words), []
    for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(all_[a : b - words + 1]))
        elif b > a:
            whole = own[a : a + 1]
            for k in range(a + 1, b):
                whole = mix(mix(whole, own[k : k + 1]), np.full(1, k - a, np.uint64))
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(own: np.ndarray) -> int:
    """One hash for a whole set; zero if it is empty."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) if len(own) else 0


def sketches(sets: list[np.ndarray], count: int = SKETCHES) -> np.ndarray:
    """``count`` fingerprints of each set; an empty one has zeros."""
    out = np.zeros((len(sets), count), np.uint64)
    full = np.flatnonzero([len(s) > 0 for s in sets])
    if not len(full):
        return out
    sizes = np.array([len(sets[k]) for k in full])
    starts, flat = np.cumsum(sizes) - sizes, np.concatenate([sets[k] for k in full])
    for k in range(count):
        other = flat if k == 0 else mix(flat, np.full(1, k, np.uint64))
        out[full, k] = _codes(bit_counts(other, starts), sizes)
    return out


def similar_forest(sets: list[np.ndarray], similarity: float):
    """Pairs of places that connect all sets whose similarity (shared by all) is enough.

    From one set after the other, all that no set has reached yet are compared with it; the
    pairs form a forest, so a group of ``n`` sets gives ``n - 1`` pairs.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    words, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *[sets[k] for k in order.tolist()]]), return_inverse=True)
    marked, a, b = np.zeros(len(words), bool), [], []
    left, per = order, sizes[order]  # the sets that are reached by none, by size, and their shingles one after the other
    heads = np.r_[0, np.cumsum(per)]
    stack: list[tuple[int, np.ndarray]] = []
    while len(left):
        if not stack:
            stack.append((int(left[0]), flat[: per[0]]))
            left, per, flat = left[1:], per[1:], flat[per[0] :]
            heads = np.r_[0, np.cumsum(per)]
            continue
        own, mine = stack.pop()
        # Only sets of about the same size can be similar.
        low, high = np.searchsorted(per, similarity * len(mine) - 1e-9), np.searchsorted(per, len(mine) / similarity + 1e-9, side="right")
        if not len(mine) or low == high:
            continue
        marked[mine] = True
        both = np.add.reduceat(marked[flat[heads[low] : heads[high]]], heads[low:high] - heads[low], dtype=np.int64)
        marked[mine] = False
        hit = np.flatnonzero(both + 1e-9 >= similarity * (len(mine) + per[low:high] - both)) + low
        if len(hit):
            a.append(np.full(len(hit), own))
            b.append(left[hit])
            stack += [(int(left[k]), flat[heads[k] : heads[k + 1]]) for k in hit.tolist()]
            stay = np.ones(len(left), bool)
            stay[hit] = False
            flat, left, per = flat[np.repeat(stay, per)], left[stay], per[stay]
            heads = np.r_[0, np.cumsum(per)]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))


def slice_counts(own: np.ndarray, sets: list[np.ndarray], step: int = 50_000):
    """``(i, j, shared)`` for places ``i < j`` of sets (``own``: their numbers) that share hashes."""
    words, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(flat, kind="stable")
    flat, at = flat[order], at[order]
    for low in range(0, len(words), step):
        i, j = np.searchsorted(flat, (low, low + step))
        held = np.zeros((min(step, len(words) - low), len(sets)), np.float32)
        held[flat[i:j] - low, at[i:j]] = 1
        shared += (held.T @ held).astype(np.int64)
    i, j = np.nonzero(np.triu(shared, 1))
    return own[i], own[j], shared[i, j]


def _tasks(members: DataFrame) -> tuple[DataFrame, bool]:
    """``(did, rk, fp, n, at)``: the tasks of each set as ``(key, slices)``, and whether any task has several slices.

    A task of more than SLICE_SHINGLES is dealt into slices of the range of hashes, so that a task
    holds about so many of them, however long its sets are.
    """
    each = members.select("did", "rk", "fp", "n", F.explode("tasks").alias("key"))
    sizes = cut(each.groupBy("key").agg(F.ceil(F.sum("n") / SLICE_SHINGLES).cast("int").alias("slices")).where("slices > 1"))
    if not sizes.limit(1).count():
        drop_cut(sizes)
        return members.select("did", "rk", "fp", "n", F.transform("tasks", lambda t: F.struct(t.alias("key"), F.lit(1).alias("slices"))).alias("at")), False
    each = each.join(small(sizes), "key", "left").select("did", "rk", "fp", "n", F.struct("key", F.coalesce("slices", F.lit(1)).alias("slices")).alias("t"))
    return cut(each.groupBy("did", "rk", "fp").agg(F.first("n").alias("n"), F.collect_list("t").alias("at"))), True


def dealt_sets(keys: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """``(key, slice, slices, fp, n, shingles)``: each set, or the slices of it, for each of its tasks ``at``.

    Nothing but the slice that a task compares is sent to it; a set's texts are cut once.
    """
    names = ["key", "slice", "slices", "fp", "n", "shingles"]

    def sets(batches):
        seen: set[int] = set()  # a text that many rows of one id have goes on once
        for batch in batches:
            fps = batch.column("fp").to_pylist()
            batch = batch.take(pa.array([k for k, f in enumerate(fps) if not (f in seen or seen.add(f))], pa.int64()))
            out, held = [], 0
            for own, fp, at in zip(batch_sets(batch.column("text"), words), batch.column("fp").to_pylist(), batch.column("at").to_pylist()):
                for task in at:
                    slices = task["slices"]
                    edge = np.searchsorted((own >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32), np.arange(slices + 1)).tolist()
                    for k, (i, j) in enumerate(zip(edge, edge[1:])):
                        out.append((task["key"], k, slices, fp, len(own), own[i:j].tobytes()))
                        held += 8 * (j - i)
                        if held > SEND_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _DEALT)], names)
                            out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _DEALT)], names)

    texts = keys.join(small(members.select("did", "rk", "fp", "at")), ["did", "rk"])
    return texts.mapInArrow(tidied(sets), "key long, slice int, slices int, fp long, n long, shingles binary")


def _forests(keys: DataFrame, members: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links ``(a, b)`` of ``members(did, rk, fp, n, tasks)``: those whose arrays of tasks share one are compared there."""
    members, sliced = _tasks(members)

    def compare(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("key", "ascending"), ("slice", "ascending")])
        key, part, slices, fp, n = (np.asarray(table.column(c)) for c in ("key", "slice", "slices", "fp", "n"))
        raw = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        edge = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1, len(key)].tolist()
        for i, j in zip(edge, edge[1:]):
            _, once = np.unique(fp[i:j], return_index=True)
            sets = [raw[i + k] for k in once.tolist()]
            if slices[i] == 1:  # decided here
                a, b = (once[x] for x in similar_forest(sets, similarity))
                both, na, nb = (np.ones(len(a), np.int64) for _ in range(3))
            else:
                a, b, both = slice_counts(once, sets)
                na, nb = n[i + a], n[i + b]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(a), key[i]), fp[i:j][a], fp[i:j][b], both, na, nb)], ["key", "a", "b", "both", "na", "nb"])

    total = members.agg(F.sum(F.col("n") * F.size("at"))).first()[0] or 0
    parts = max(keys.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_SHINGLES))
    found = dealt_sets(keys, members, words).repartition(parts, "key", "slice").mapInArrow(tidied(compare), "key long, a long, b long, both long, na long, nb long")
    if sliced:
        found = found.groupBy("key", "a", "b").agg(F.sum("both").alias("both"), F.first("na").alias("na"), F.first("nb").alias("nb"))
        found = found.where(F.col("both") + 1e-9 >= similarity * (F.col("na") + F.col("nb") - F.col("both")))
    out = cut(found.select("a", "b"))
    if sliced:
        drop_cut(members)
    return out


def placed_sets(group: DataFrame) -> DataFrame:
    """``(did, rk, fp, component, n, blocks, own, pivot, tasks)``: the blocks in which each set of a group is compared.

    A small group is one block.  A large one has at least four times as many sets of its own in
    each block as there are pivots, the few sets that all its blocks hold, so a group of few long
    texts is one block too and hardly more than the group itself is sent anywhere.
    """
    sizes = group.groupBy("component").agg(F.sum("n").alias("all"), F.count("*").alias("sets"), F.min("head").alias("first"))
    blocks = F.least(F.ceil(F.col("all") / BLOCK_SHINGLES), F.ceil(F.col("sets") / (4 * PIVOTS))).cast("int")
    large = cut(sizes.withColumn("blocks", blocks).where("blocks > 1").select("component", "blocks", "sets", "first"))
    placed = group.join(small(large), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    pivot = (F.col("head") == F.col("first")) | (F.pmod(F.xxhash64(F.lit(5), "id"), F.col("sets")) < PIVOTS)
    placed = placed.withColumns({"own": F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), "pivot": F.coalesce(pivot, F.lit(False))})
    tasks = F.transform(F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own")), lambda b: F.xxhash64("component", b))
    return cut(placed.select(F.col("head.did").alias("did"), F.col("head.rk").alias("rk"), F.col("id").alias("fp"), "component", "n", "blocks", "own", "pivot", tasks.alias("tasks")))


def _compared(keys: DataFrame, group: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links of the sets of ``group(id, component, head, n)`` that are similar enough.

    A small group is compared in one task.  A large one is dealt into blocks, and each block
    holds a few sets of the whole group besides its own.  That connects most of a group of near
    copies; the sets which it leaves apart from the group's main part then meet every block.
    """
    placed = placed_sets(group)
    first = _forests(keys, placed, words, similarity)
    # What is apart from the main part of a large group.
    many = placed.where("blocks > 1")
    part = components(first.join(small(cut(many.select(F.col("fp").alias("a")))), "a", "left_semi"))
    many = cut(many.join(part.select(F.col("id").alias("fp"), F.col("component").alias("part")), "fp", "left").withColumn("part", F.coalesce("part", "fp")))
    main = many.groupBy("component", "part").agg(F.sum("n").alias("n")).groupBy("component").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    many = cut(many.join(small(cut(main)), "component").withColumn("apart", F.col("part") != F.col("main")))
    parts = F.least(F.ceil(F.sum("n") / REST_SHINGLES), F.ceil(F.count("*") / (4 * PIVOTS))).cast("int")
    rest = cut(many.where("apart").groupBy("component").agg(parts.alias("parts")))
    if not rest.limit(1).count():
        return first
    many = many.join(small(rest), "component")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.xxhash64("component", "own", p))
    visits = F.transform(every, lambda b: F.xxhash64("component", b, F.pmod(F.xxhash64(F.lit(6), "fp"), F.col("parts")).cast("int")))
    second = _forests(keys, cut(many.withColumn("tasks", F.when(F.col("apart"), F.array_union(meets, visits)).otherwise(meets)).select("did", "rk", "fp", "n", "tasks")), words, similarity)
    return first.unionByName(second)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(did, rk, fp, component, head)`` for each row; ``component`` is the least id reachable.

    Texts are linked whose sets of shingles have at least the similarity (shared by all), if
    the index finds them: of pairs at 0.8 it misses about one in twenty, at 0.85 one in a
    hundred, at 0.9 none in a thousand.  No pair below the similarity is linked.  Texts
    without words (null and empty ones too) are copies of each other.  ``fp`` is the hash of
    the set.  Ids as in ``near_duplicates``.
    """
    prepare(docs.sparkSession)
    keys = keyed(docs, id_col, text_col)
    names = [f"c{k}" for k in range(SKETCHES)]

    def first(batches):
        for batch in batches:
            sets = batch_sets(batch.column("text"), words)
            codes = sketches(sets)
            fps = np.fromiter(map(set_key, sets), np.uint64, len(sets))
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("rk"), _signed(fps), pa.array([len(s) for s in sets], pa.int64()), *(_signed(codes[:, k]) for k in range(SKETCHES))], ["did", "rk", "fp", "n", *names])

    rows = cut(keys.mapInArrow(tidied(first), "did long, rk long, fp long, n long, " + ", ".join(f"{c} long" for c in names)))
    classes = representatives(rows, "n", *names)
    count = classes.count()
    quarter = masks(0, 3)
    tops = F.array(*[F.struct(F.col(c).alias("code"), F.col(names[k - 1]).alias("wide"), F.xxhash64(F.lit(4 * k + r), _masked(F.col(c), m)).alias("node")) for k, c in enumerate(names) for r, m in enumerate(quarter)])
    nodes = classes.where("n > 0").select(F.col("fp").alias("id"), F.explode(tops).alias("t")).select("id", "t.*")
    found = cut(search(nodes, len(quarter) * SKETCHES, count, SKETCH_LIMIT, PAIR_LIMIT))
    group = cut(components(found).join(classes.select(F.col("fp").alias("id"), "head", "n"), "id"))
    close = _compared(keys, group, words, similarity)
    out = joined(rows.select("did", "rk", "fp"), close, classes)
    for t in (found, group):
        drop_cut(t)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, limit: int | None = None) -> DataFrame:
    """Rows of ``docs`` whose document is the first of its group; all columns stay.

    Groups are those of ``similar_documents``, or with ``limit`` those of ``near_duplicates``.  The
    least id stays.  Of a group whose ids are all null one row stays.  A null or empty text is
    a text like any other, and an empty table gives an empty one.
    """
    found = similar_documents(docs, id_col, text_col, words, similarity) if limit is None else near_duplicates(docs, id_col, text_col, words, limit)
    found = cut(found)
    gone = found.where(f"component <> did AND did <> {NO_ID}").select(F.col("did").alias("__gone")).distinct()
    known = docs.where(docs[id_col].isNotNull())
    known = known.join(small(cut(gone)), known[id_col].cast("long") == F.col("__gone"), "left_anti")
    # Rows without an id are told apart by their text alone.
    heads = found.where(f"did = {NO_ID} AND component = {NO_ID} AND rk = head.rk").select(F.col("rk").alias("__head")).distinct()
    rest = docs.where(docs[id_col].isNull()).withColumn("__head", F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    rest = rest.dropDuplicates(["__head"]).join(heads, "__head", "left_semi").select(*docs.columns)
    return known.unionByName(rest)
