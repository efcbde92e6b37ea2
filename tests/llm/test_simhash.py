import re

import numpy as np
import xxhash

from voxelweave.llm import graytree, simhash
from voxelweave.llm.components import components

from .cases import documents, empty


def plain_fingerprint(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    top = dict(zip(ids, ids))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 3:
                x, y = find(ids[i]), find(ids[j])
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_against_brute_force(spark):
    docs = documents(spark)
    rows = docs.collect()
    big = 1 << 63
    fps = [plain_fingerprint(r.text) for r in rows]
    want = plain_components([big if r.doc_id is None else r.doc_id for r in rows], fps)
    got = simhash.digest(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(r.doc_id), f"{f:016x}") for r, f in zip(rows, fps))
    for r in got:
        assert r.component_id == want[big if r.doc_id is None else r.doc_id]
    assert simhash.digest(empty(spark)).count() == 0
    kept = simhash.keep_first(docs, words=3, limit=3)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c}


def test_index_finds_every_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    codes = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a, b in rng.integers(0, 64, (12, 2))] + [base[0] ^ (np.arange(64, dtype=np.uint64) << np.uint64(5))]))
    node = (codes % np.uint64(3)).astype(np.int64)
    label = simhash.local_labels(len(codes), *(np.concatenate(x) for x in zip(*graytree.linked(node, codes, chunk=50))))
    far = np.bitwise_count(codes[:, None] ^ codes) <= 3
    a, b = np.nonzero(far & (node[:, None] == node))
    assert (label == simhash.local_labels(len(codes), a, b)).all()


def test_wide_codes():
    rng = np.random.default_rng(4)
    codes, wide = (rng.integers(0, 2**20, 400).astype(np.uint64) for _ in range(2))
    node = rng.integers(0, 3, 400)
    found = [np.concatenate(x) for x in zip(*graytree.linked(node, codes, 6, wide, 9, chunk=300))]
    apart = np.bitwise_count(codes[:, None] ^ codes)
    far = (apart <= 6) & (apart + np.bitwise_count(wide[:, None] ^ wide) <= 9) & (node[:, None] == node)
    assert (simhash.local_labels(400, *found) == simhash.local_labels(400, *np.nonzero(far))).all()
    assert sum(len(a) for a, _ in graytree.linked(node[:0], codes[:0])) == 0


def test_masks():
    for rows, bits in ((0, 16), (1 << 30, 25), (1 << 38, 31)):
        found = simhash.masks(rows)
        assert min(m.bit_count() for m in found) >= bits
        rng = np.random.default_rng(1)
        for apart in [rng.choice(64, 3, replace=False) for _ in range(200)]:
            assert any(not sum(1 << int(b) for b in apart) & m for m in found)


def test_many_masks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 60)
    fps = np.unique(np.concatenate([base, *[base ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))) for _ in range(4)]]))
    monkeypatch.setattr(simhash, "CROWD", 0)
    monkeypatch.setattr(simhash, "masks", lambda rows, limit=3, real=simhash.masks: real(1 << 38, limit))
    got = {r.id: r.component for r in components(simhash.links(spark.createDataFrame([(int(f),) for f in fps], "fp long"))).collect()}
    want = simhash.local_labels(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= 3))
    assert got == {int(fps[i]): int(fps[c]) for i, c in enumerate(want.tolist()) if (want == c).sum() > 1}


def test_hot_node_in_blocks(spark):
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 2**20, 900)).astype(np.int64)
    classes = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fps)], "did long, fp long")
    got = {r.id: r.component for r in components(simhash.links(classes, node_codes=100)).collect()}
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= 3)
    want = simhash.local_labels(len(fps), a, b)
    assert got == {int(fps[i]): int(fps[c]) for i, c in enumerate(want.tolist()) if (want == c).sum() > 1}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (205, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 205: 200}
