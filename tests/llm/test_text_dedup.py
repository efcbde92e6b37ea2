import hashlib
import re

import pytest

from voxelweave.llm import common, lines, simhash, substring

from .cases import documents, empty

BIG = 1 << 63


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def ids(rows):
    return [BIG if r.doc_id is None else r.doc_id for r in rows]


def plain_lines(rows):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, r in zip(ids(rows), rows):
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, r in zip(ids(rows), rows):
        all_lines = (r.text or "").split("\n")
        kept = [s for s in all_lines if not (len(holders.get(key(s), ())) >= 2 and min(holders[key(s)]) != i)]
        out.append((i, len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept))))
    return sorted(out)


def plain_passages(rows, window):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first = {}
    for i, r in zip(ids(rows), rows):
        w = split(r.text)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, r in zip(ids(rows), rows):
        w = split(r.text)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out)


def test_lines(spark):
    docs = documents(spark)
    got = sorted((BIG if r[0] is None else r[0], *r[1:]) for r in lines.digest(docs).collect())
    assert got == plain_lines(docs.collect())
    assert sum(r[2] for r in got) > 20
    assert lines.digest(empty(spark)).count() == 0
    out = lines.drop_repeated_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert "Python" not in out._jdf.queryExecution().toString()


def test_lines_threshold(spark):
    docs = spark.createDataFrame([(i, f"shared by {'three' if i < 3 else 'all of'}\nshared by everyone!") for i in range(5)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.drop_repeated_lines(docs, min_docs=4).collect()}
    assert got[0].endswith("everyone!") and got[4] == "shared by all of" and got[2] == "shared by three"


@pytest.mark.parametrize("window,first", [(50, 25), (50, 13), (9, 5), (50, 7)])
def test_passages(spark, window, first):
    docs = documents(spark)
    out = substring.remove_repeated_passages(docs, window=window, first_length=first)
    got = sorted((r.did if r.did < BIG - 1 else BIG, r.n_words, r.n_removed, sha(r.kept_text)) for r in out.collect())
    assert got == plain_passages(docs.collect(), window)
    assert any(0 < r[2] < r[1] for r in got)


def test_no_passages(spark):
    assert substring.digest(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert substring.digest(one).first()[1:] == (3, 0, sha("a b c"))


def test_shuffled_branches(spark, monkeypatch):
    """The same rows where no side may be broadcast."""
    docs = documents(spark)
    rows = docs.collect()
    groups = sorted(simhash.near_duplicates(docs).select("did", "component").collect())
    kept = sorted(str(r.doc_id) for r in simhash.keep_first(docs).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    got = sorted((BIG if r[0] is None else r[0], *r[1:]) for r in lines.digest(docs).collect())
    assert got == plain_lines(rows)
    out = substring.remove_repeated_passages(docs)
    assert sorted((r.did if r.did < BIG - 1 else BIG, r.n_words, r.n_removed, sha(r.kept_text)) for r in out.collect()) == plain_passages(rows, 50)
    assert sorted(simhash.near_duplicates(docs).select("did", "component").collect()) == groups
    assert sorted(str(r.doc_id) for r in simhash.keep_first(docs).collect()) == kept


def test_clashing_columns(spark):
    docs = documents(spark).selectExpr("*", "'x' AS n_lines", "2.5 AS n_dropped", "'y' AS did", "'z' AS rk")
    out = lines.drop_repeated_lines(docs)
    assert out.columns == docs.columns and dict(out.dtypes)["n_lines"] == "bigint" and out.where("did = 'y'").count() == docs.count()
    assert simhash.keep_first(docs).columns == docs.columns


def test_very_long_text(spark):
    """Two million words in one text, which hold a passage of another text twice."""
    passage = " ".join(f"p{k}" for k in range(60))
    long_ = " ".join(f"w{k % 99991}x{k}" for k in range(2_000_000))
    docs = spark.createDataFrame([(1, passage), (2, long_ + " " + passage + " " + long_[:500] + " " + passage), (3, long_)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.digest(docs).collect()}
    assert got[1] == (60, 0) and got[3] == (2_000_000, 2_000_000) and 120 <= got[2][1] <= 220
    assert simhash.keep_first(docs).count() == 2
