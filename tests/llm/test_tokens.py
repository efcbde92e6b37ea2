import hashlib
import io
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxelweave.llm import bpe, tokenfile

from .cases import documents, empty

PATH = bpe.vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "  a", "a  b   c", "\n\n x\n y", "don't we'll", "<|endoftext|>", "a<|endoftext|> b <|endoftext|>", "日本語 テキスト", "x\x85y\xa0z w", "a\x1cb\x1dc \x1e", "12345 678", "🙂🙂 é́", "\t\t tab", "a" * 3000, "ab" * 500 + " " * 50, "​ ﻿ x", "<|endoftext"]


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_like_the_library(text):
    for own in (True, False):
        codec = bpe.codec(PATH, own)
        ids = np.frombuffer(codec.encode(text), "<u4")
        assert ids.tolist() == library_ids(text)
        assert codec.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)
        assert codec.encode_all([text]) == [ids.tobytes()]


def test_many_at_once():
    rng = random.Random(8)
    pieces = sorted({"".join(rng.choice("thereandingoßé .,|#") for _ in range(rng.randrange(1, 65))).encode()[:64] for _ in range(3000)})
    codec = bpe.Codec(PATH)
    assert codec.merges(pieces) == [np.asarray(codec.of_piece(p), "<u4").tobytes() for p in pieces]
    assert codec.merges([]) == []
    texts = ["".join(rng.choice(ODD + ["the ", "under ", "wordé, "]) for _ in range(40)) for _ in range(60)]
    for own in (codec, bpe.Codec(PATH, False)):
        own.units.most = own.pieces.most = 50
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)] == [library_ids(t) for t in texts]


def test_units_share_calls():
    """The library's model gets many new units in a call, not one."""
    own, calls = bpe.Codec(PATH, False), []
    model, library = own.library.model, own.library
    own.library = SimpleNamespace(model=SimpleNamespace(tokenize=lambda s: calls.append(s) or model.tokenize(s)))
    words = [f" w{chr(97 + k % 26)}rd{'é' * (k % 3)}{'x' * (k // 26)}{',' * (k % 2)}"[k % 5 == 0 :] for k in range(1000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.many([w.encode() for w in words])] == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert len(calls) < 200
    assert own.many([]) == []


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abnrstoeT20.,'\"-|#@/çàæé×÷ªµÿʼɏɐ—…日\x00\x7f\u0301"), min_size=1, max_size=12), min_size=1, max_size=12), st.lists(st.sampled_from([" ", "", "  ", "\n"]), min_size=12, max_size=12))
def test_units_that_meet(words, before):
    """Ids are those of the units alone, whatever stands beside them in a call."""
    units = [u for w, s in zip(words, before) for u in bpe._UNITS.findall(s + w)]
    own = bpe.codec(PATH, False)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.many([u.encode() for u in units])] == [library_ids(u) for u in units]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n\t\x1cé", max_size=12), max_size=5))
def test_tiles(texts):
    joined, places, heads = bpe.tiles([t.encode() for t in texts])
    units = [joined[a:b].decode() for a, b in zip(places, [*places[1:], len(joined)])]
    assert [units[a:b] for a, b in zip(heads, heads[1:])] == [bpe._UNITS.findall(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'abcEt<|>")), max_size=60))
def test_any_text(text):
    ids = np.frombuffer(bpe.codec(PATH).encode(text), "<u4")
    assert ids.tolist() == library_ids(text)
    assert bpe.codec(PATH).decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_merge_is_leftmost_lowest():
    rng = random.Random(2)
    pairs = [(a, b) for a in range(14) for b in range(14)]
    ranks, made = {a << 20 | b: r for r, (a, b) in enumerate(pairs)}, [10 + r for r in range(len(pairs))]
    for n in [*range(1, 40), *range(1, 40), 500]:
        symbols = [rng.randrange(4) for _ in range(n)]
        plain = list(symbols)
        while True:
            found = [(ranks[a << 20 | b], i) for i, (a, b) in enumerate(zip(plain, plain[1:])) if a << 20 | b in ranks]
            if not found:
                break
            rank, i = min(found)
            plain[i : i + 2] = [made[rank]]
        assert bpe.merge(list(symbols), ranks, made) == plain


def test_cache_keeps_results():
    units = bpe.Units(lambda u: [len(u)], most=3)
    for _ in range(2):
        for k in range(10):
            assert np.frombuffer(units[b"x" * k], "<u4").tolist() == [k]
    assert len(units) <= 3 and len(units.old) <= 3


def test_query(spark):
    docs = documents(spark)
    want = sorted((str(r.doc_id), len(i := library_ids(r.text or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    assert sorted((str(r[0]), *r[1:]) for r in bpe.digest(docs).collect()) == want
    out = bpe.decode(bpe.encode(docs))
    assert out.columns == [*docs.columns, "ids", "decoded"]
    clash = bpe.decode(bpe.encode(docs.selectExpr("*", "'x' AS ids", "1 AS decoded")))
    assert clash.columns == out.columns and clash.select("ids", "decoded").collect() == out.select("ids", "decoded").collect()
    assert bpe.digest(empty(spark)).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")).where("decoded = ''").count() == 2


@pytest.mark.parametrize("files", [1, 4])
def test_files(spark, tmp_path, files):
    docs = documents(spark)
    rows = [r for r in docs.collect() if r.doc_id != 7]
    docs = docs.where("doc_id is null or doc_id <> 7")
    folder = tokenfile.write_tokens(docs, str(tmp_path / "t"), files=files)
    got = {r.did: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.index_tokens(spark, folder).collect()}
    start = 0
    for r in sorted(rows, key=lambda r: 1 << 63 if r.doc_id is None else r.doc_id):
        ids = np.array([*library_ids(r.text or ""), 2], "<u4")
        assert got[(1 << 63) - 1 if r.doc_id is None else r.doc_id] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    some = {r.did: r.ids for r in tokenfile.read_tokens(spark, folder, [3, 60, 999]).collect()}
    assert set(some) == {3, 60} and some[60] == [*library_ids(next(r.text for r in rows if r.doc_id == 60)), 2]
    ranges = tokenfile.index_files(spark, folder).collect()
    assert sum(r.documents for r in ranges) == len(rows) and sum(r.n_tokens for r in ranges) == start
    again = tokenfile.read_tokens(spark, folder, [3, 60, 999])
    assert {r.did: r.ids for r in again.collect()} == some and {r.file for r in again.collect()} <= {r.file for r in ranges if any(r.first <= i <= r.last for i in (3, 60, 999))}
    assert tokenfile.read_tokens(spark, folder, [-5]).count() == 0
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "t").glob("part-*")))
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True) as plain:
        assert len(plain.read()) == 4 * start


def test_many_files_and_one_id(spark, tmp_path, monkeypatch):
    """More files than a group of sums; and a hot id whose texts are dealt over several files."""
    monkeypatch.setattr(tokenfile, "FILE_GROUP", 3)
    docs = spark.createDataFrame([(None if k % 3 else 5, f"text {k} " * (k % 7)) for k in range(90)], "doc_id long, text string")
    folder = tokenfile.write_tokens(docs, str(tmp_path / "t"), files=8)
    got = sorted((r.start, r.n_tokens, r.did) for r in tokenfile.index_tokens(spark, folder).collect())
    assert len(got) == 90 and got[0][0] == 0 and all(a + n == b for (a, n, _), (b, *_) in zip(got, got[1:]))
    assert [d for *_, d in got] == sorted(d for *_, d in got)
    files = {r.file for r in tokenfile.read_tokens(spark, folder).where("did > 5").select("file").distinct().collect()}
    assert len(files) >= 4


def test_damage(spark, tmp_path):
    parts = list(tokenfile.pack([(1, b"\1\0\0\0" * 50), (2, b"\2\0\0\0")]))
    file = bytearray(b"".join(p + tokenfile.EMPTY_FRAME for p in parts))
    assert tokenfile.Reader(io.BytesIO(bytes(file))).ids(1).tolist() == [2]
    for at in (8, len(file) - 40):
        bad = bytearray(file)
        bad[at] ^= 255
        with pytest.raises((ValueError, zstandard.ZstdError)):
            tokenfile.Reader(io.BytesIO(bytes(bad))).ids(0)
    with pytest.raises(ValueError):
        tokenfile.Reader(io.BytesIO(b"no"))


def test_no_documents(spark):
    assert tokenfile.digest(empty(spark)).count() == 0
