import math

import numpy as np
import pytest

from voxelweave.llm import pqdedup, topk

SCHEMA = "vec_id long, embedding array<float>, label int, extra string"


def table(spark, n=300, seed=4, size=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, size))
    base[n // 2 :] = base[: n - n // 2] + rng.normal(size=(n - n // 2, size)) * rng.choice([0.05, 0.3, 0.5], (n - n // 2, 1))
    rows = [(i, [float(np.float32(x)) for x in v], i % 3, "x") for i, v in enumerate(base)]
    nan, inf = float("nan"), float("inf")
    rows += [(n, None, 0, None), (n + 1, [0.0] * size, None, ""), (n + 2, [nan] * size, 1, ""), (n + 3, [inf] + [1.0] * (size - 1), 1, ""), (n + 4, [None] + [1.0] * (size - 1), 1, ""), (n + 5, [], 1, "")]
    rows += [(n + 6 + k, rows[3][1], 1, "copy") for k in range(30)] + [(None, rows[2][1], 1, "no id"), (n + 50, [1.0, 2.0], 1, ""), (n + 51, [2.0, 4.1], 1, "")]
    rng.shuffle(order := list(range(len(rows))))
    return spark.createDataFrame([rows[i] for i in order], SCHEMA)


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def plain_links(rows, cosine=0.9):
    big = (1 << 63) - 1
    ids = [big if r.vec_id is None else r.vec_id for r in rows]
    n, top = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, r in enumerate(rows):
        for j in range(i):
            a, b = r.embedding, rows[j].embedding
            if good(a) and good(b) and len(a) == len(b) and any(a) and any(b):
                a, b = np.array(a), np.array(b)
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine:
                    n[i] += 1
                    n[j] += 1
                    top[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), big), ids[i])
    return sorted((ids[i], n[i], least[find(i)]) for i in range(len(rows)))


@pytest.mark.parametrize("blocks", [(1024, 4096), (16, 48)])
def test_links(spark, monkeypatch, blocks):
    monkeypatch.setattr(pqdedup, "LIST_BLOCK", blocks[0])
    monkeypatch.setattr(pqdedup, "VISIT_BLOCK", blocks[1])
    vectors = table(spark)
    got = sorted((r.did, r.n_links, r.component) for r in pqdedup.near_duplicates(vectors, margin=0.45).collect())
    assert got == plain_links(vectors.collect())


def test_recall_of_the_margin(spark):
    vectors = table(spark, n=600, size=32)
    want = {i: n for i, n, _ in plain_links(vectors.collect())}
    got = {r.did: r.n_links for r in pqdedup.near_duplicates(vectors).collect()}
    assert all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.9 * sum(want.values())


def links_of(spark, rows, **how):
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    return plain_links(table.collect()), sorted((r.did, r.n_links, r.component) for r in pqdedup.near_duplicates(table, **how).collect())


def test_tiny_and_huge_components(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(200, 24))
    rows[100:] = rows[:100] + 0.1 * rng.normal(size=(100, 24))
    rows[::9] *= 1e-200
    rows[1::9] *= 1e200
    plain, got = links_of(spark, rows / np.abs(rows).max(axis=1, keepdims=True))
    with np.errstate(all="ignore"):
        _, scaled = links_of(spark, rows)
    assert got == plain and scaled == plain and sum(n for _, n, _ in got) >= 200


def test_hot_cluster_of_few_directions(spark, monkeypatch):
    """A third of the vectors vary along three directions, where displacements cross borders."""
    monkeypatch.setattr(pqdedup, "LIST_ROWS", 10)
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(600, 32))
    rows[:200] = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 32))
    plain, got = links_of(spark, rows)
    found, all_ = sum(n for _, n, _ in got), sum(n for _, n, _ in plain)
    assert all(a <= b for (_, a, _), (_, b, _) in zip(got, plain)) and all_ > 2000 and found >= 0.97 * all_
    # What one end finds counts for both.
    ours = {i: n for i, n, _ in got}
    assert sum(ours.values()) % 2 == 0


def test_lists_of_two_parts(spark, monkeypatch):
    monkeypatch.setattr(pqdedup, "FLAT_LISTS", 4)
    monkeypatch.setattr(pqdedup, "LIST_ROWS", 8)
    monkeypatch.setattr(pqdedup, "INDEXED_LENGTHS", 1)
    vectors = table(spark)
    want = plain_links(vectors.collect())
    assert sorted((r.did, r.n_links, r.component) for r in pqdedup.near_duplicates(vectors, margin=0.45).collect()) == want
    got = {r.did: r.n_links for r in pqdedup.near_duplicates(vectors).collect()}
    assert all(got[i] <= n for i, n, _ in want) and sum(got.values()) >= 0.9 * sum(n for _, n, _ in want)


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pqdedup.digest(none).count() == 0
    assert topk.digest(none).count() == 0
    only = spark.createDataFrame([(0, None, 1, ""), (200, [0.0], 1, "")], SCHEMA)
    assert sorted(tuple(r) for r in pqdedup.digest(only).collect()) == [(0, 0, 0, True), (200, 0, 200, True)]
    assert topk.digest(only).count() == 0


@pytest.mark.parametrize("k,bins,enough,block,queries", [(10, 256, 8, 2048, 100), (3, 4, 1, 2, 100), (50, 16, 1, 2048, 2)])
def test_top_k(spark, monkeypatch, k, bins, enough, block, queries):
    monkeypatch.setattr(topk, "PASS_QUERIES", queries)
    monkeypatch.setattr(topk, "BINS", bins)
    monkeypatch.setattr(topk, "ENOUGH", enough)
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    vectors = table(spark)
    rows = [(r.vec_id, np.floor(1024 * np.array(r.embedding)).astype(int)) for r in vectors.collect() if r.vec_id is not None and good(r.embedding)]
    want = set()
    for i, q in rows:
        if i % 100 == 0:
            scored = sorted((-int(q @ v), j) for j, v in rows if j != i and len(v) == len(q))
            want |= {(i, p + 1, j, -s) for p, (s, j) in enumerate(scored[:k])}
    out = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k)
    assert {tuple(r) for r in out.collect()} == want
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}


def test_large_components(spark):
    vectors = spark.createDataFrame([(0, [1e6, 3.0]), (1, [1e3, 2.0]), (2, [-5e2, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.digest(vectors).orderBy("rank").collect()]
    assert got == [(1, 1024000000 * 1024000 + 3072 * 2048), (2, 1024000000 * -512000 + 3072 * 1024)]


def test_scores_beyond_a_long(spark):
    rows = [(0, [1e20, 1.0]), (1, [1e20, 2.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0]), (4, [1e15, 1e15]), (5, [1.7e308, -3.0]), (6, [1e9, -1e9])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.digest(vectors).orderBy("rank").collect()]
    whole = [[int(np.floor(np.float64(min(1024 * x, 1.7976931348623157e308)))) if np.isfinite(1024 * x) else int(np.finfo(float).max) for x in v] for _, v in rows]
    scores = {i: max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(whole[0], whole[i])))) for i in range(1, 7)}
    assert got == sorted(scores.items(), key=lambda p: (-p[1], p[0])) and got[0][1] == topk.MOST
    rng = np.random.default_rng(1)
    a, b = (np.floor(rng.normal(size=(5, 3)) * 10.0 ** rng.integers(0, 12, (5, 1))) for _ in range(2))
    assert topk._scores(a, b).tolist() == [[max(-topk.MOST, min(topk.MOST, sum(int(x) * int(y) for x, y in zip(r, q)))) for q in b] for r in a]
