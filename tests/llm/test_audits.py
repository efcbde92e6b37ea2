"""Source divergence and filter interaction against DuckDB and plain Python, and awkward rows."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from voxelweave.llm import divergence, filters

from .cases import documents, empty

LABELS = "doc_id long, quality int, toxic int"
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# ---- divergence


def plain_divergence(rows, min_docs, top=50):
    """Rows (text, lang, source): every term of every pair, one by one."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(_LOW)) for t, *_ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(r[2], t) for r, t in zip(rows, terms) if r[1] == lang]
        docs = Counter(t for _, ts in own for t in set(ts))
        kept = sorted(t for t, n in docs.items() if n >= min_docs)
        counts = {s: Counter() for s, _ in own}
        for s, ts in own:
            counts[s].update(t for t in ts if docs[t] >= min_docs)
        whole = sum(counts.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))

        for s, c in counts.items():
            pairs = [(-sum(abs(share(c, t) - share(o, t)) for t in kept), other) for other, o in counts.items() if other != s]
            above = [(share(whole, t) - share(c, t), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", above)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(found[: top if part == "term" else None], 1)]
    return sorted(out)


@pytest.mark.parametrize("sources", [divergence.SOURCES, 2])
def test_divergence_like_plain(spark, monkeypatch, sources):
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "VECTORS", 3)
    docs = documents(spark, 80)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    rows += [("only here", "xx", "alone"), (None, "xx", "none"), ("Ärger 😀x A_b", "yy", "s")]
    docs = spark.createDataFrame([(k, t, a, b) for k, (t, a, b) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    for least in (1, 4):
        assert rows_of(divergence.audit(docs, min_docs=least)) == plain_divergence(rows, least)


def test_divergence_of_many_sources_and_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES", 4)
    rng = random.Random(5)
    words = [f"w{k}" for k in "abcdefghijklmnopqrstuvwxyz"] + ["naïve", "Ünder"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(9))), "l", "hot" if k % 3 else f"s{k % 17}") for k in range(300)]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    assert rows_of(divergence.audit(docs, min_docs=10, top=5)) == plain_divergence(rows, 10, 5)


def test_shares_beyond_a_long(spark):
    from pyspark.sql import functions as F

    n, total, v = 4 * 10**15, 9 * 10**15, 7 * 10**8
    got = spark.range(1).select(divergence._share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_divergence_without_rows(spark):
    assert divergence.digest(empty(spark)).count() == 0


def test_terms_of_a_slice():
    texts = pa.array(["skip", "Aé-b\x00C  d9e", None, "", "É_é"]).slice(1)
    coded, at = divergence.split_terms(texts)
    assert list(zip(at.tolist(), coded.to_pylist())) == [(0, "aé"), (0, "b"), (0, "c"), (0, "d"), (0, "e"), (3, "É"), (3, "é")]


# ---- filters


def plain_fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)))


def plain_audit(rows, labels):
    rows = [(NO if i is None else i, t or "", s or "") for i, t, s in rows]
    first = {}
    for i, t, _ in rows:
        first[t] = min(i, first.get(t, i))
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    fails = [dict(zip("ABCDE", (*plain_fails(t), i > first[t]))) for i, t, _ in rows]
    out = []
    for part in {r[2] for r in rows}:
        own = [(r[0], f) for r, f in zip(rows, fails) if r[2] == part]
        table, shapley = [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                failing = [d for d in own if d[1][f]]
                table.append((f, part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(sum(d[1].values()) == 1 for d in failing), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
        out += [(*r, shapley[f]) for f, *r in table]
    return sorted(out)


NO = 1 << 63


def test_filters_like_plain(spark):
    docs = documents(spark, 50)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    rng = random.Random(2)
    rows += [(200 + k, " ".join(f"{rng.choice('abcXYZé')}{rng.randrange(n)}" for _ in range(60)) + rng.choice(["", " #", "\x0b|"]), "long") for k, n in enumerate([2, 5, 9, 20, 40, 400] * 4)]
    rows += [(None, rows[-1][1], "long"), (None, rows[-1][1], None), (None, "no other", ""), (None, "no other", "")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 230, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as quality", "'x' as mask", "2 as h1", "'y' as part")
    marks = spark.createDataFrame(labels, LABELS)
    assert rows_of(filters.audit(docs, marks)) == plain_audit(rows, labels)


def test_filters_without_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert filters.digest(empty(spark), none).count() == 0
    got = filters.digest(documents(spark), none)
    assert got.where("good_lost + toxic_lost > 0").count() == 0 and got.count() % 600 == 0


@pytest.mark.parametrize("most", [1 << 20, 64, 7])
def test_scan_like_plain(most):
    rng = random.Random(most)
    letters = "aB é😀#\t\x0b\x85\xa0Z|"
    texts = ["", None, " ", "x", "long" * 5000] + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(300)]
    got = filters.scan(pa.array(texts).slice(1), most=most)
    for k, t in enumerate(texts[1:]):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want = (len(words), len(set(words)), len(re.findall("[A-Z]", t or "")), len(t or ""), len(re.findall("[#$%&*|]", t or "")))
        assert tuple(int(got[c][k]) for c in ("words", "distinct", "capitals", "points", "symbols")) == want


def test_equal_hashes_are_verified():
    texts = pa.array(["ab cd ab ef cd", "a b a", "x"])
    got = filters.scan(texts, hashes=lambda data, start, size: np.zeros(len(start), np.uint64))
    assert got["distinct"].tolist() == [3, 2, 1]


def test_a_text_of_many_bytes(spark):
    text = "Word other " * 400_000
    docs = spark.createDataFrame([(1, text, "s"), (2, text, "s"), (3, text + "!", "s")], "doc_id long, text string, source string")
    got = {tuple(r)[:3]: r for r in filters.digest(docs, spark.createDataFrame([], LABELS)).collect()}
    first = got["s", "EBACD", 1], got["s", "EBACD", 2]
    assert (first[0].removed, first[1].removed, first[1].redundant, first[1].kept) == (1, 2, 1, 0)
