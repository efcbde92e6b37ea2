import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from voxelweave.llm import simhash

from .cases import documents, empty


def plain_sets(text, words=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def plain_kept(rows, similarity=0.8):
    ids, sets = [r[0] for r in rows], [plain_sets(r[1]) for r in rows]
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both, all_ = len(a & sets[j]), len(a | sets[j])
            if not all_ or (5 * both >= 4 * all_ if similarity == 0.8 else both >= similarity * all_):
                x, y = find(ids[i]), find(ids[j])
                top[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def near_copies(texts=30, length=100, edits=range(1, 5), seed=4):
    """Texts of some words, and copies with some words changed."""
    rng = random.Random(seed)
    rows = []
    for k in range(texts):
        words = [f"w{rng.randrange(5000)}" for _ in range(length)]
        rows.append((10 * k, " ".join(words)))
        for n, c in enumerate(edits, 1):
            other = list(words)
            for at in rng.sample(range(length), c):
                other[at] = f"x{rng.randrange(10**9)}"
            rows.append((10 * k + n, " ".join(other)))
    return rows


def test_stage_drops_near_copies(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_kept(rows)
    assert 30 <= len(want) < 100
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert want <= got and len(got - want) <= 0.04 * (len(rows) - len(want))  # no false link, few missed ones


def test_recall(spark):
    """Pairs at 0.8 (3 to 4 words of 145 changed) and at 0.9 and more."""
    for edits, least in (([3], 0.9), ([1], 0.995)):
        rows = near_copies(400, 100, edits, seed=7) if edits == [1] else near_copies(400, 145, [4], seed=7)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        links = len(rows) - len(plain_kept_pairs(rows))
        gone = len(rows) - simhash.keep_first(docs).count()
        assert least * links <= gone <= links


def plain_kept_pairs(rows):
    """As plain_kept where only a text and its copy can be similar."""
    texts = dict(rows)
    out = set(texts)
    for i, t in rows:
        if i % 10:
            a, b = plain_sets(t), plain_sets(texts[i - i % 10])
            if 5 * len(a & b) >= 4 * len(a | b):
                out.discard(i)
    return out


def test_against_brute_force(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()]
    kept = simhash.keep_first(docs.where("doc_id is not null"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == plain_kept(rows)
    assert simhash.keep_first(empty(spark)).count() == 0


def test_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(7, text), (None, text + " x"), (9, "other words of another text that stays here"), (None, "other words of another text that stays here"), (None, "alone " * 3), (None, "alone " * 3), (None, "on its own and unlike any other text"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, simhash.keep_first(docs).select("doc_id", "text").collect()))
    texts = [(r.doc_id, (r.text or "").strip()) for r in simhash.keep_first(docs).collect()]
    assert len(got) == 5 and sorted(t for i, t in texts if i is None) == ["", "alone alone alone", "on its own and unlike any other text"]
    assert {i for i, _ in texts} == {7, 9, None}
    close = simhash.keep_first(docs, words=3, limit=3)
    assert {r.doc_id for r in close.collect()} >= {9, None} and close.where("text like 'alone%'").count() == 1


def test_sets_and_sketches():
    texts = ["Alpha beta  gamma\tdelta epsilon zeta", "one two", "", None, "a b c d e a b c d e a b c d e"]
    sets = simhash.batch_sets(pa.array(texts), 5)
    assert [len(s) for s in sets] == [2, 1, 0, 0, 5]
    again = simhash.batch_sets(pa.array(["two one", "alpha BETA gamma delta epsilon", "one two"]), 5)
    assert again[0] != sets[1] and again[1][0] in sets[0] and again[2] == sets[1]
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 0, 3, 700, 256, 255)]
    codes = simhash.sketches(sets, 3)
    for s, own in zip(sets, codes):
        want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s)) if len(s) else 0
        assert int(own[0]) == want and (len(s) == 0) == (own[1] == own[2])


def test_forest():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = []
    for _ in range(25):
        base = rng.choice(pool, 30, replace=False)
        sets += [np.unique(np.r_[base[k:], rng.choice(pool, k)]) for k in range(5)]
    a, b = simhash.similar_forest([*sets, np.zeros(0, np.uint64)], 0.8)
    i, j = zip(*[(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) - 1e-9])
    n = len(sets) + 1
    want = simhash.local_labels(n, np.array(i), np.array(j))
    assert (simhash.local_labels(n, a, b) == want).all() and len(a) == n - len(set(want.tolist()))
    assert len(simhash.similar_forest([], 0.8)[0]) == 0


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 200)
    monkeypatch.setattr(simhash, "REST_SHINGLES", 300)
    monkeypatch.setattr(simhash, "NODE_CODES", 4)
    monkeypatch.setattr(simhash, "PIVOTS", 1)
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(90)]
    rows = [(k, " ".join([*base[: 3 + k], f"y{k}", *base[4 + k :]])) for k in range(80)]
    docs = spark.createDataFrame(rows + [(100 + k, rows[3][1]) for k in range(20)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} == {0}


def test_group_in_parts(spark, monkeypatch):
    """One group of the index that falls into parts and chains, dealt over blocks: as one forest of all its sets."""
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(simhash, "REST_SHINGLES", 400)
    monkeypatch.setattr(simhash, "PIVOTS", 1)
    rng = random.Random(8)
    pool = [f"w{k}" for k in range(3000)]
    texts = []
    for k in range(12):
        words = [rng.choice(pool) for _ in range(60)]
        for _ in range(rng.choice([1, 4, 12])):
            texts.append(" ".join(words))
            at = rng.randrange(55)
            words = [*words[:at], f"n{rng.randrange(10**9)}", *words[at + 1 :]]  # a chain: each text is like the one before it
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = simhash.keyed(docs)
    sets = simhash.batch_sets(pa.array(texts), 5)
    fps = [int(np.uint64(simhash.set_key(s)).view(np.int64)) for s in sets]
    rk = {r.did: r.rk for r in keys.collect()}
    group = spark.createDataFrame([(f, 1, (i, rk[i]), len(s)) for i, (f, s) in enumerate(zip(fps, sets))], "id long, component long, head struct<did: long, rk: long>, n long")
    place = {f: i for i, f in enumerate(fps)}
    ends = [(place[r.a], place[r.b]) for r in simhash._compared(keys, simhash.cut(group), 5, 0.8).collect()]
    want = simhash.local_labels(len(sets), *simhash.similar_forest(sets, 0.8))
    assert (simhash.local_labels(len(sets), *map(np.array, zip(*ends))) == want).all() and 5 < len(set(want.tolist())) < len(sets)


def test_slices_count_like_sets():
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 2**63, 900).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(rng.choice(pool, n)) for n in (0, 1, 400, 700, 700)]
    a, b, both = simhash.slice_counts(np.arange(10, 15), sets, step=100)
    want = [(10 + i, 10 + j, len(set(sets[i].tolist()) & set(sets[j].tolist()))) for i in range(5) for j in range(i + 1, 5)]
    assert list(zip(a.tolist(), b.tolist(), both.tolist())) == [w for w in want if w[2]]


def test_slices_and_blocks_give_the_same(spark, monkeypatch):
    """Groups compared in slices, in blocks with pivots and in parts, against brute force."""
    rng = random.Random(12)
    rows = near_copies(6, 120, [1, 2, 3, 1, 2, 1], seed=3)
    base = [f"v{k}" for k in range(150)]
    for k in range(90):  # one large group of near copies, and others that are only like some of them
        words = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 6])):
            words[at] = f"y{k}"
        rows.append((1000 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_kept(rows)
    for sizes in ({"SLICE_SHINGLES": 200}, {"BLOCK_SHINGLES": 500, "PIVOTS": 1, "SLICE_SHINGLES": 100, "REST_SHINGLES": 300}):
        with monkeypatch.context() as m:
            for name, value in sizes.items():
                m.setattr(simhash, name, value)
            got = {r.doc_id for r in simhash.keep_first(docs).collect()}
        assert want <= got and len(got - want) <= 2


def test_several_very_long_near_copies(spark):
    """Six texts of two million words each: they are one block in slices, and little more than themselves is sent."""
    from pyspark.sql import functions as F

    words = [f"w{k % 99991}x{k}" for k in range(2_000_000)]
    rows = []
    for k in range(6):
        own = list(words)
        own[1000 * k : 1000 * k + 500] = [f"z{k}"] * 500
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_first(docs).collect()] == [0]
    keys = simhash.cut(simhash.keyed(docs))
    group = keys.select(F.lit(0).alias("component"), F.col("did").alias("id"), F.struct("did", "rk").alias("head"), F.lit(2_000_000).cast("long").alias("n"))
    placed = simhash.placed_sets(group)
    members, sliced = simhash._tasks(placed)
    sent = simhash.dealt_sets(keys, members, 5).agg(F.sum(F.length("shingles")), F.max(F.length("shingles"))).first()
    assert sliced and sent[0] < 8 * 3 * 6 * 2_000_000 and sent[1] < 8 * simhash.SLICE_SHINGLES
