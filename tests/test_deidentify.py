"""Denylists against regular expressions, files' texts, and nested policies."""

import random
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from voxelweave.functions import denylist as D
from voxelweave.functions import policy as P


def plain(text, terms):
    return sorted(((m.start(), t) for t in terms for m in re.finditer(f"(?<![A-Za-z0-9])(?={re.escape(t)}(?![0-9]))", text, re.IGNORECASE | re.ASCII)), key=lambda f: (f[0], -len(f[1])))


def test_occurrences_like_patterns():
    rng = random.Random(3)
    terms = sorted({"".join(rng.choice("aB1_é-") for _ in range(rng.randrange(1, 5))) for _ in range(60)}, key=str.lower)
    terms = list({t.translate(D._LOWER): t for t in terms}.values())
    known = D.automaton(terms)
    for _ in range(300):
        text = "".join(rng.choice("abAB12_é- \n") for _ in range(rng.randrange(60)))
        assert D.occurrences(known, text) == plain(text, terms)


def test_ten_thousand_terms_in_one_pass(spark, monkeypatch):
    terms = [f"P{k:05d}" for k in range(10_000)] + ["", "p00001"]
    rows = [(1, "see p00017, P00017x and P000171; xP00018", "kept"), (2, None, "a"), (3, "", "b"), (4, "P09999 P00000\nP00000", "c")]
    df = spark.createDataFrame(rows, "id long, text string, term string")
    want = [(1, 4, "P00017"), (1, 12, "P00017"), (4, 0, "P09999"), (4, 7, "P00000"), (4, 14, "P00000")]
    assert sorted(map(tuple, D.find_terms(df, "text", terms).select("id", "at", "term").collect())) == sorted(want)
    monkeypatch.setattr(D, "TERMS_TOGETHER", 3000)
    assert sorted(map(tuple, D.find_terms(df, "text", terms).select("id", "at", "term").collect())) == sorted(want)
    assert D.find_terms(df, "text", []).count() == 0
    assert ("xP00018" in rows[0][1]) and D.find_terms(df, "text", ["P00018"], whole=False).count() == 1


def chunk(kind, body, crc=True):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body) ^ (not crc))


def png(*chunks, tail=b""):
    return D._PNG + b"".join(chunk(*c) for c in ((b"IHDR", bytes(13)), *chunks, (b"IEND", b""))) + tail


def test_texts_of_files(spark, tmp_path):
    made = png((b"tEXt", b"Author\0Jos\xe9"), (b"zTXt", b"Note\0\0" + zlib.compress(b"S0017")), (b"iTXt", b"Title\0\1\0de\0Titel\0" + zlib.compress("Ärger".encode())), tail=b"left 0042")
    assert D.png_texts(made) == [("Author", "José"), ("Note", "S0017"), ("Title", "Titel Ärger"), ("behind the end", "left 0042")]
    assert D.png_texts(made[:60])[-1][0] == "error" and D.png_texts(b"GIF")[0][0] == "error"
    assert D.png_texts(png((b"tEXt", b"a\0b", False)))[0] == ("error", "checksum of chunk tEXt")
    assert D.png_texts(png((b"zTXt", b"a\0\0no")))[0][0] == "error"
    import base64

    svg = f'<svg><text>S0042</text><image href="data:image/png;base64,{base64.b64encode(made).decode()}"/></svg>'
    found = D.texts_of("a.svg", svg.encode())
    assert found[0] == ("text", svg) and ("image 0 Note", "S0017") in found
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(made)
    (tmp_path / "b.svg").write_text(svg)
    hits = D.find_terms(D.file_texts(spark, str(tmp_path)), "text", ["s0017", "S0042"])
    assert sorted((r.path.rsplit("/", 1)[1], r.field, r.term) for r in hits.collect()) == [("a.png", "Note", "s0017"), ("b.svg", "image 0 Note", "s0017"), ("b.svg", "text", "S0042")]


SCHEMA = "id string, meta struct<site: string, name: string>, files array<struct<path: string, sha: string, tags: array<string>>>, inputs map<string, struct<path: string, n: int>>, evidence map<string, int>, spare struct<x: int>"


def records(spark):
    return spark.createDataFrame([("a", ("s", "N"), [("p", "h", ["t"]), None], {"k": ("p", 1), "none": None}, {"log": 1, "line": 2}, (1,)), ("b", None, [], {}, None, None), ("c", (None, "N"), None, None, {"log": 3}, None)], SCHEMA)


POLICY = {"id": "keep", "meta.site": "keep", "meta.name": "drop", "files[].path": "drop", "files[].sha": "keep", "files[].tags": "keep", "inputs{}.path": "drop", "inputs{}.n": "keep", "evidence": "keep", "evidence{log}": "drop", "spare": "drop"}


def test_nested_policy(spark):
    out = P.apply_policy(records(spark), POLICY)
    assert out.schema.simpleString() == "struct<id:string,meta:struct<site:string>,files:array<struct<sha:string,tags:array<string>>>,inputs:map<string,struct<n:int>>,evidence:map<string,int>>"
    got = {r.id: r.asDict(True) for r in out.collect()}
    assert got["a"] == {"id": "a", "meta": {"site": "s"}, "files": [{"sha": "h", "tags": ["t"]}, None], "inputs": {"k": {"n": 1}, "none": None}, "evidence": {"line": 2}}
    assert got["b"] == {"id": "b", "meta": None, "files": [], "inputs": {}, "evidence": None}
    assert got["c"] == {"id": "c", "meta": {"site": None}, "files": None, "inputs": None, "evidence": {}}


def test_unknown_keys_are_refused_by_path(spark):
    df = records(spark)
    for path in ("meta.name", "files[].sha", "inputs{}.n", "id"):
        with pytest.raises(P.PolicyError, match=re.escape(f"no rule for {path}")):
            P.apply_policy(df, {k: v for k, v in POLICY.items() if k != path})
    with pytest.raises(P.PolicyError, match="no such part: meta.nam$"):
        P.apply_policy(df, POLICY | {"meta.nam": "drop"})
    with pytest.raises(P.PolicyError, match="is no rule"):
        P.apply_policy(df, POLICY | {"id": "maybe"})
    assert P.apply_policy(df, POLICY | {"meta.nam": "drop"}, strict=False).columns == ["id", "meta", "files", "inputs", "evidence"]


def test_functions_and_whole_parts(spark):
    out = P.apply_policy(records(spark), {"id": F.upper, "meta": "whole", "files": "drop", "inputs{}": "whole", "evidence{}": lambda v: v * 10, "spare.x": "drop", "files[].path": "drop"})
    r = out.where("id = 'A'").first().asDict(True)
    assert r == {"id": "A", "meta": {"site": "s", "name": "N"}, "inputs": {"k": {"path": "p", "n": 1}, "none": None}, "evidence": {"log": 10, "line": 20}}


def test_terms_of_a_table(spark):
    """Terms that are a table give what the automaton gives."""
    rng = random.Random(4)
    terms = list({t.translate(D._LOWER): t for t in ("".join(rng.choice("aB1_é-𝄞") for _ in range(rng.randrange(1, 5))) for _ in range(60))}.values())
    texts = [(k, "".join(rng.choice("abAB12_é-𝄞 \n") for _ in range(rng.randrange(60)))) for k in range(300)] + [(300, None), (301, "")]
    df = spark.createDataFrame(texts, "id long, text string")
    table = spark.createDataFrame([(t,) for t in [*terms, "", None]], "name string")
    rows = lambda out: sorted(map(tuple, out.select("id", "at", "term").collect()))
    for whole in (True, False):
        want = rows(D.find_terms(df, "text", terms, whole))
        assert len(want) > 500 and rows(D.join_terms(df, "text", table, "name", whole)) == want
    assert D.join_terms(df, "text", table.where("name = 'x'"), "name").count() == 0


def test_query_keeps_terms_off_the_driver(spark, monkeypatch):
    from voxelweave.plans import catalog_files

    monkeypatch.setattr(D, "find_terms", None)
    sf = "/root/testdata/sf0.001"
    out = catalog_files.denylist_terms(spark, sf)
    assert out.count() == 2 * spark.read.parquet(f"{sf}/orders.parquet").count()
