"""Approximate nearest neighbours: recall and exact scores against brute force, copies and awkward rows."""

import numpy as np
import pytest

from voxelweave.llm import nndescent

SCHEMA = "vec_id long, embedding array<float>, label int, nid string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in rows], SCHEMA)


def plain(rows, queries, k):
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q in queries:
        own = next(v for i, v in fine if i == q)
        found = sorted((-float(own @ v), i) for i, v in fine if i != q and len(v) == len(own))
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("long", [False, True])
def test_recall_and_scores(spark, monkeypatch, long):
    monkeypatch.setattr(nndescent, "BUCKET", 128)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24)) * (np.exp(rng.standard_normal((1500, 1))) if long else 1)
    x = x if long else x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = list(enumerate(x.tolist()))
    v = frame(spark, rows)
    got, want = answers(nndescent.digest(v)), plain(rows, range(0, 1500, 20), 20)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9
    exact = {(q, i): s for q, w in plain(rows, list(want)[:5], 1500).items() for i, s in w}
    for q in list(want)[:5]:
        assert len(got[q]) == 20
        assert [s for _, s in got[q]] == pytest.approx([exact[q, i] for i, _ in got[q]], rel=1e-12)
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))


def test_few_rows_and_awkward_ones(spark):
    rows = [(20, [1, 0]), (0, [1, 1]), (3, [-1, 0]), (4, [0, 0]), (5, None), (6, []), (7, [1, None]), (8, [float("nan"), 1]), (None, [1, 1]), (9, [1, 2, 3]), (40, [3, 2, 1]), (60, None), (80, [5]), (11, [1, 1]), (12, [1, 1])]
    got = answers(nndescent.digest(frame(spark, rows)))
    assert {q: [i for i, _ in w] for q, w in got.items()} == {20: [0, 11, 12, 3], 0: [11, 12, 20, 3], 40: [9]}


def test_many_copies(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "MEMBERS", 16)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = list(enumerate(x.tolist())) + [(1000 + k, x[20].tolist()) for k in range(300)]
    got, want = answers(nndescent.digest(frame(spark, rows))), plain(rows, [*range(0, 400, 20), *range(1000, 1300, 20)], 20)
    assert [i for i, _ in got[20]] == list(range(1000, 1020))
    assert [i for i, _ in got[1020]] == [20, *range(1000, 1019)]
    assert recall(got, want) >= 0.9


def test_queries_that_are_no_rows(spark):
    rng = np.random.default_rng(9)
    rows = list(enumerate(rng.standard_normal((600, 12)).tolist()))
    asked = [(5000 + k, q.tolist()) for k, q in enumerate(rng.standard_normal((30, 12)))]
    graph = nndescent.build(frame(spark, rows))
    got = answers(nndescent.search(graph, frame(spark, asked), k=10))
    graph.drop()
    want = {q: [x for x in w if x[0] < 5000][:10] for q, w in plain(rows + asked, [i for i, _ in asked], 700).items()}
    assert recall(got, want) >= 0.9


def test_no_rows(spark):
    assert nndescent.digest(frame(spark, [])).count() == 0
    assert nndescent.digest(frame(spark, [(0, None)])).count() == 0


def test_pairs_within_groups():
    g = np.array([1, 1, 1, 2, 3, 3])
    v = np.array([[1, 0], [0, 1], [1, 1], [9, 9], [1, 0], [2, 0]], np.float32)
    fresh = np.array([True, False, False, True, False, False])
    found = sorted((a, b, s) for p in nndescent.pairs_within(g, v, fresh, np.full(6, -1.0), 2) for a, b, s in zip(*(x.tolist() for x in p)))
    assert found == [(0, 1, 0.0), (0, 2, 1.0), (1, 0, 0.0), (2, 0, 1.0)]
