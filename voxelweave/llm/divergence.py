"""Source divergence audit (operator 12): how the sources of a language differ in their words.

A term's counts in the sources of its language are one sparse vector.  Most terms of a corpus
are rare and share their vector with many others, so terms are grouped by identical vector,
every pair of sources is evaluated once for each distinct vector, and the result counts as
often as terms have that vector.  Only the ranking goes back to the terms themselves.

Texts are cut and counted in Arrow batches, so what is shuffled is a row for each term of a
source and batch at most.  Pairs are evaluated in blocks of sources on slices of the distinct
vectors; a vector goes only to the blocks in which it has a count, and all others, which
count nothing in either source, follow from the number of terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, prepare, small, tidied

#: Documents of a language that a term must be in, what is added to every count, and the whole of a share.
MIN_DOCS, ADDED, WHOLE = 30, 5, 1_000_000_000
#: Terms of a group that are ranked.
TOP = 50
#: Sources of a block, and distinct vectors of a slice at least.
SOURCES, VECTORS = 64, 1000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_terms(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Terms of a batch, dictionary-encoded, and the place of the text each is from.

    A term is a maximal run of letters A-Z and a-z and of code points from U+0080 on, with A-Z
    lower-cased; every byte of such a code point is from 128 on, so bytes can be told one by one.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    clean = bytes(raw).translate(_TABLE)
    own = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(clean))
    lists = pc.ascii_split_whitespace(own)
    bounds = np.asarray(lists.offsets, np.int64)
    coded = lists.flatten().dictionary_encode()
    at = np.repeat(np.arange(len(texts)), np.diff(bounds))
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:
        keep = np.asarray(coded.indices) != empty
        coded, at = coded.filter(pa.array(keep)), at[keep]
    return coded, at


def _batch_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    coded, at = split_terms(batch.column("text"))
    code = np.asarray(coded.indices, np.int64)
    kinds = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
    group = pa.array([f"{len(r['lang'])} {r['lang']}{r['source']}" for r in kinds.to_pylist()]).dictionary_encode()
    own = np.asarray(group.indices, np.int64)
    head = np.zeros(len(group.dictionary), np.int64)
    head[own[::-1]] = np.arange(len(own))[::-1]
    terms = max(1, len(coded.dictionary))
    seen, times = np.unique(at * terms + code, return_counts=True)  # one entry for a term of a document
    key, place = np.unique(own[seen // terms] * terms + seen % terms, return_inverse=True)
    n = np.bincount(place, weights=times, minlength=len(key)).astype(np.int64)
    docs = np.bincount(place, minlength=len(key))
    first = pa.array(head[key // terms])
    term = coded.dictionary.cast(pa.string()).take(pa.array(key % terms))
    return pa.RecordBatch.from_arrays([batch.column("lang").take(first), batch.column("source").take(first), term, pa.array(n), pa.array(docs.astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: how often, and in how many documents of the source.

    Null texts, languages and sources are read as ``''``; every row is a document.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield _batch_counts(batch)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counted = rows.mapInArrow(tidied(run), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (count + ADDED) / (total + ADDED * terms)), exactly; 0 if there is no term."""
    wide = lambda c: c.cast("decimal(27,0)")
    top, bottom = wide(wide(count) + ADDED) * F.lit(WHOLE), wide(total) + wide(terms) * F.lit(ADDED)
    return F.when(terms > 0, 1 + F.call_function("div", top, bottom)).otherwise(F.lit(0)).cast("long")


def _pair_sums(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, a, b, m, value)`` for each pair of sources ``a < b`` (numbers): the sum over the vectors that
    have a count in the blocks of either, times their terms, and how many terms these are."""
    blocks = groups.groupBy("lang").agg(F.floor((F.max("no") + SOURCES) / SOURCES).cast("int").alias("blocks"))  # numbers start at 0
    # Both numbers of blocks of a pair, the smaller first, for all blocks that a row is in.
    other = lambda mine: F.explode(F.flatten(F.transform(mine, lambda x: F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.struct(F.least(x, y).alias("i"), F.greatest(x, y).alias("j"))))))
    entries = vectors.join(blocks, "lang").withColumn("mine", F.array_distinct(F.transform("shares", lambda s: F.floor(s["no"] / SOURCES).cast("int"))))
    placed = entries.select("lang", "h1", "m", "shares", F.explode(F.array_distinct(F.flatten(F.transform("mine", lambda x: F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.struct(F.least(x, y).alias("i"), F.greatest(x, y).alias("j"))))))).alias("at"))
    placed = placed.select("lang", "at.i", "at.j", "h1", "m", F.filter("shares", lambda s: F.floor(s["no"] / SOURCES).isin(F.col("at.i"), F.col("at.j"))).alias("shares"))
    slices = cut(placed.groupBy("lang", "i", "j").agg(F.ceil(F.count("*") / F.least(F.lit(4 * SOURCES**2), F.greatest(F.lit(VECTORS), F.pow(F.size(F.max("shares")), F.lit(2))))).cast("int").alias("slices")))
    dealt = placed.join(small(slices), ["lang", "i", "j"]).withColumn("slice", F.pmod(F.xxhash64(F.lit(2), "h1"), F.col("slices")).cast("int"))
    sides = groups.join(blocks, "lang").withColumn("at", other(F.array(F.floor(F.col("no") / SOURCES).cast("int")))).select("lang", "at.i", "at.j", "no", "none").distinct()
    sides = sides.join(small(slices), ["lang", "i", "j"], "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)))

    def run(key, left, right):
        lang, i, j, _ = (k.as_py() for k in key)
        no, none = (np.asarray(left.column(c)) for c in ("no", "none"))
        order = np.argsort(no)
        no, none = no[order], none[order]
        m = np.asarray(right.column("m"))
        shares = right.column("shares").combine_chunks() if right.num_rows else None
        p = np.broadcast_to(none, (len(m), len(no))).copy()
        if shares is not None:
            flat = shares.flatten()
            row = np.repeat(np.arange(len(m)), np.diff(np.asarray(shares.offsets)))
            p[row, np.searchsorted(no, np.asarray(flat.field("no")))] = np.asarray(flat.field("p"))
        a, b = np.flatnonzero(no // SOURCES == i), np.flatnonzero(no // SOURCES == j)
        out_a, out_b, value = [], [], []
        for x in a.tolist():
            some = b[b > x]
            out_a.append(np.full(len(some), no[x]))
            out_b.append(no[some])
            value.append(m @ np.abs(p[:, some] - p[:, [x]]))
        a, b, value = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (out_a, out_b, value))
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": a, "b": b, "m": np.full(len(a), m.sum(), np.int64), "value": value})

    keys = ["lang", "i", "j", "slice"]
    both = sides.select(*keys, "no", "none").groupBy(*keys).cogroup(dealt.select(*keys, "m", "shares").groupBy(*keys))
    found = both.applyInArrow(run, "lang string, a long, b long, m long, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("m").alias("m"), F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of every group of a language and a source.

    A group's share of a term is ``p = 1 + floor(1e9 * (count + 5) / (N + 5 * V))`` over the ``V`` terms
    that ``min_docs`` documents of the language hold, ``N`` their occurrences in the group; ``q`` is
    the same over the whole language.  Part ``pair``: the sum of ``abs(p - q)`` with the shares
    ``q`` of each other source of the language, all ranked.  Part ``term``: terms of the group with ``p > q``, by the
    difference, the first ``top``.  Larger values rank first, ties by the item's bytes.

    Null texts, languages and sources count as ``''``, and ``''`` is a source like any other.  A
    language without such a term has pairs of value 0 and no terms; one of a single source has
    no pairs.  Every row is a document, rows of one id too; an empty table gives an empty one.
    Vectors are told apart by 128 bits of hash.  Other columns are not read.
    """
    counts = cut(term_counts(docs, text_col, lang_col, source_col))
    occurring = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    numbered = cut(occurring.withColumn("no", number.cast("long")))
    held = counts.join(small(numbered), ["lang", "source"])
    vector = F.array_sort(F.collect_list(F.struct("no", "n")))  # as long as the language has sources
    terms = held.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), vector.alias("vector")).where(F.col("docs") >= min_docs)
    terms = cut(terms.select("lang", "term", "total", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2")))
    drop_cut(counts)
    whole = cut(terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("whole")))
    own = terms.select("lang", F.explode("vector").alias("e")).groupBy("lang", "e.no").agg(F.sum("e.n").alias("total"))
    groups = numbered.join(own, ["lang", "no"], "left").join(whole, "lang", "left").fillna(0, ["total", "terms", "whole"])
    groups = cut(groups.withColumn("none", _share(F.lit(0), F.col("total"), F.col("terms"))))
    distinct = cut(terms.groupBy("lang", "h1", "h2").agg(F.count("*").alias("m"), F.first("total").alias("all"), F.first("vector").alias("vector")))
    entry = distinct.select("lang", "h1", "h2", "m", "all", F.explode("vector").alias("e")).select("lang", "h1", "h2", "m", "all", "e.no", "e.n").join(small(groups), ["lang", "no"])
    entry = cut(entry.select("lang", "h1", "h2", "m", "no", "source", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), _share(F.col("all"), F.col("whole"), F.col("terms")).alias("q")))
    # Pairs.
    vectors = entry.groupBy("lang", "h1", "h2").agg(F.first("m").alias("m"), F.collect_list(F.struct("no", "p")).alias("shares"))
    sums = _pair_sums(vectors, groups.select("lang", "no", "none"))
    name = groups.select("lang", "no", "source", "none", "terms")
    first, second = (name.select("lang", F.col("no").alias(c), F.col("source").alias(f"{c}_source"), F.col("none").alias(f"{c}_none"), *(["terms"] if c == "a" else [])) for c in "ab")
    pairs = sums.join(small(cut(first)), ["lang", "a"]).join(small(cut(second)), ["lang", "b"])
    pairs = pairs.withColumn("value", F.col("value") + (F.col("terms") - F.col("m")) * F.abs(F.col("a_none") - F.col("b_none")))
    way = lambda x, y: F.struct(F.col(f"{x}_source").alias("source"), F.col(f"{y}_source").alias("item"))
    pairs = pairs.select("lang", F.explode(F.array(way("a", "b"), way("b", "a"))).alias("w"), "value").select("lang", "w.source", "w.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    # Terms: the vectors that can hold ranked terms, then their terms.
    above = entry.where("p > q").select("lang", "source", "h1", "h2", (F.col("p") - F.col("q")).alias("value"))
    above = above.withColumn("r", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("r") <= top).drop("r")
    named = above.join(terms.select("lang", "h1", "h2", F.col("term").alias("item")), ["lang", "h1", "h2"])
    named = named.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(named, "term"))


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns, of every group of a language and a source (nulls: ``''``), ties by the item's bytes."""
    return audit(docs)


SQL = """
WITH d AS (SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
o AS (SELECT row_no, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT row_no) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY o.lang, o.source, o.term),
v AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
      (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * v.terms))::BIGINT AS p,
      (1 + (1000000000::HUGEINT * (k.n + 5)) // (v.total + 5 * v.terms))::BIGINT AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
w AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM w WHERE part = 'pair' OR rank <= 50
"""
