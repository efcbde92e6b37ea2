"""Filter interaction audit (operator 13): what each filter removes in each order of five filters.

Texts are scanned where they lie in Arrow buffers: classes of bytes and prefix sums over them
count words, capitals and symbols of all documents of a batch at the same time, and a document's
distinct words are the distinct hashes among its sorted word hashes, each run of equal ones
verified byte by byte.  A document becomes a mask of the filters it fails.  Documents of equal
source, mask and labels are counted together, and 32 counts a source give every order's rows.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, row_id, tidied

#: Failure conditions: fewer words, fewer distinct words of 100, more capitals of 100 code points, a symbol.
WORDS, DISTINCT, CAPITALS, SYMBOLS = 50, 65, 5, b"#$%&*|"
FILTERS = "ABCDE"
#: Bytes that are scanned at a time; longer texts are cut at white space.
SCAN_BYTES = 1 << 20

_SPACE, _CAPITAL, _SYMBOL, _INNER = 1, 2, 4, 8  # _INNER: not the first byte of a code point
_CLASS = np.array([(_SPACE if c == 32 or 9 <= c <= 13 else 0) | (_CAPITAL if 65 <= c <= 90 else 0) | (_SYMBOL if c in SYMBOLS else 0) | (_INNER if 128 <= c < 192 else 0) for c in range(256)], np.uint8)
_VALUE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(41))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(1, n), _STEP)
    out[0] = 1
    return np.multiply.accumulate(out)


def _word_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes; words do not overlap and are in order."""
    if not len(start):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    inside = np.arange(size.sum()) - np.repeat(first, size)
    value = _VALUE[data[np.repeat(start, size) + inside]] * _powers(int(size.max()))[inside]
    return np.add.reduceat(value, first) ^ size.astype(np.uint64)


def _pieces(data: np.ndarray, offsets: np.ndarray, most: int) -> np.ndarray:
    """Ends of pieces: those of the texts, and cuts at white space inside of longer ones."""
    extra = []
    for i in np.flatnonzero(np.diff(offsets) > most).tolist():
        at, end = int(offsets[i]) + most, int(offsets[i + 1])
        while at < end:
            space = np.flatnonzero(_CLASS[data[at : min(at + most, end)]] & _SPACE)
            if len(space):
                extra.append(at + int(space[0]))
                at = extra[-1]
            at += most
    return np.unique(np.r_[offsets, np.array(extra, offsets.dtype)])


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the words at ``a`` and ``b`` have the same bytes."""
    out = np.ones(len(a), bool)
    for k in range(0, len(a), 50_000):
        n = size[k : k + 50_000]
        first = np.cumsum(n) - n
        inside = np.arange(n.sum()) - np.repeat(first, n)
        equal = data[np.repeat(a[k : k + 50_000], n) + inside] == data[np.repeat(b[k : k + 50_000], n) + inside]
        out[k : k + 50_000] = np.logical_and.reduceat(equal, first) if len(first) else True
    return out


def scan(texts: pa.Array, hashes=_word_hashes, most: int = SCAN_BYTES) -> dict[str, np.ndarray]:
    """``words, distinct, capitals, points, symbols`` of each text (null: all zero)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = _pieces(data, offsets, most)
    out = {c: np.zeros(len(texts), np.int64) for c in ("words", "distinct", "capitals", "points", "symbols")}
    starts, sizes, hashed = [], [], []
    i = 0
    while i < len(ends) - 1:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, side="right")) - 1)
        lo, hi = int(ends[i]), int(ends[j])
        kind = _CLASS[data[lo:hi]]
        inner = ends[i:j][ends[i:j] < hi] - lo  # where pieces start; empty ones at the end start nothing
        owner = np.searchsorted(offsets, ends[i:j][: len(inner)], side="right") - 1
        for name, bits, want in (("capitals", _CAPITAL, 1), ("symbols", _SYMBOL, 1), ("points", _INNER, 0)):
            total = np.r_[0, np.cumsum(((kind & bits) > 0) == want)]
            np.add.at(out[name], owner, total[np.r_[inner[1:], hi - lo]] - total[inner])
        word = (kind & _SPACE) == 0
        begin = word & np.r_[True, ~word[:-1]] if len(word) else word
        begin[inner] = word[inner]
        stop = word & np.r_[~word[1:], True] if len(word) else word
        stop[inner[1:] - 1] = word[inner[1:] - 1]
        a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        starts.append(a + lo)
        sizes.append(b - a)
        hashed.append(hashes(data, a + lo, b - a))
        i = j
    start, size, own = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, sizes, hashed))
    doc = np.searchsorted(offsets, start, side="right") - 1
    out["words"] += np.bincount(doc, minlength=len(texts))
    order = np.lexsort((size, own, doc))
    start, size, own, doc = (x[order] for x in (start, size, own, doc))
    again = np.zeros(len(doc), bool)
    again[1:] = (doc[1:] == doc[:-1]) & (own[1:] == own[:-1]) & (size[1:] == size[:-1])
    out["distinct"] += np.bincount(doc[~again], minlength=len(texts))
    place = np.flatnonzero(again)
    # Words of a run of equal hashes are verified one against the next; if any differs, the run is counted by its bytes.
    differ = place[~_same(data, start[place - 1], start[place], size[place])]
    for head in np.unique(np.maximum.accumulate(np.where(again, 0, np.arange(len(doc))))[differ]).tolist():
        end = head + 1
        while end < len(doc) and again[end]:
            end += 1
        out["distinct"][doc[head]] += len({data[start[w] : start[w] + size[w]].tobytes() for w in range(head, end)}) - 1
    return out


def failures(texts: pa.Array) -> np.ndarray:
    """The mask of the filters A to D that each text fails, A the least bit."""
    n = scan(texts)
    fails = (n["words"] < WORDS, 100 * n["distinct"] < DISTINCT * n["words"], 100 * n["capitals"] > CAPITALS * n["points"], n["symbols"] > 0)
    return sum((f.astype(np.int64) << k) for k, f in enumerate(fails))


def _masks(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``(did, h1, h2, part, mask)`` of every row; the text's 128 bits of hash tell copies."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("did", "h1", "h2", "part")), pa.array(failures(batch.column("text")))], ["did", "h1", "h2", "part", "mask"])

    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(row_id(docs, id_col).alias("did"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    return rows.mapInArrow(tidied(run), "did long, h1 long, h2 long, part string, mask long")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(part, mask, good, toxic, n)``: documents of a source by the filters they fail (E the fifth bit) and their labels.

    Copies are not joined with their first document.  Rows of equal text, source, mask and
    labels are counted together with their least id and how many rows have it; the least of
    these over a text then says how many of them are not its first.
    """
    marks = labels.where(labels[id_col].isNotNull()).groupBy(F.col(id_col).cast("long").alias("did")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    keys = ["h1", "h2", "part", "mask", "good", "toxic"]
    never = {"good": F.lit(False), "toxic": F.lit(False)}
    known = _masks(docs.where(docs[id_col].isNotNull()), id_col, text_col, source_col).join(marks, "did", "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in never})
    lost = _masks(docs.where(docs[id_col].isNull()), id_col, text_col, source_col).withColumns(never)
    by_id = known.groupBy("did", *keys).count().unionByName(lost.groupBy("did", *keys).count())
    copies = by_id.groupBy(*keys).agg(F.sum("count").alias("n"), F.min(F.struct("did", "count")).alias("least"))
    # A text has as many rows now as its copies have sources and labels; the least id goes back to each by an array of them.
    texts = copies.groupBy("h1", "h2").agg(F.min("least.did").alias("first"), F.collect_list(F.struct("part", "mask", "good", "toxic", "n", "least")).alias("some"))
    some = texts.select("first", F.explode("some").alias("s")).select("s.*", F.when(F.col("s.least.did") == F.col("first"), F.col("s.least.count")).otherwise(F.lit(0)).alias("heads"))
    fold = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("heads").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("heads")).alias("n"))))
    return some.select("part", "good", "toxic", fold.alias("f")).select("part", "good", "toxic", "f.*").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _tables() -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Orders, and for each order and step which of the 32 masks are kept, removed and redundant, fail one filter, and their shares."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    masks = np.arange(32)
    kept, removed, redundant, single, share = (np.zeros((len(orders), 5, 32), np.int64) for _ in range(5))
    each = np.array([120 // max(1, bin(m).count("1")) for m in masks])  # of 120 orders, as many have the filter first of those it fails
    for o, order in enumerate(orders):
        before = np.zeros(32, bool)
        for s, f in enumerate(order):
            fails = (masks >> FILTERS.index(f) & 1) > 0
            removed[o, s], redundant[o, s], single[o, s] = fails & ~before, fails & before, masks == 1 << FILTERS.index(f)
            share[o, s] = fails * each
            before |= fails
            kept[o, s] = ~before
    return orders, kept, removed, redundant, single, share


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each source, order of the five filters and step: see ``digest`` for the columns.

    A document that fails a filter: A has fewer than 50 words; B fewer than 65 distinct words of
    100, told apart by case; C more than 5 capitals A-Z of 100 code points; D any of ``#$%&*|``; E the text of
    a smaller id.  A null text is empty (it fails A alone, and E if another has none), a null
    source ``''``, a null id larger than any other, and rows of one id are documents like any.
    An id with several labels is good or toxic if one of them says so.  An empty table gives an
    empty one; other columns are not read.
    """
    prepare(docs.sparkSession)
    counts = mask_counts(docs, labels, id_col, text_col, source_col)
    cell = lambda what: F.array(*[F.coalesce(F.sum(F.when((F.col("mask") == m) & what, F.col("n"))), F.lit(0)) for m in range(32)])
    rows = counts.groupBy("part").agg(cell(F.lit(True)).alias("all"), cell(F.col("good")).alias("good"), cell(F.col("toxic")).alias("toxic"))

    def run(batches):
        orders, kept, removed, redundant, single, share = (x if isinstance(x, list) else x.reshape(-1, 32) for x in _tables())
        names = pa.array(orders).take(pa.array(np.repeat(np.arange(len(orders)), 5)))
        for batch in batches:
            for r in range(batch.num_rows):
                n, good, toxic = (np.asarray(batch.column(c)[r].values, np.int64) for c in ("all", "good", "toxic"))
                values = [m @ n for m in (kept, removed, redundant, single)] + [removed @ good, removed @ toxic, share @ n]
                part = batch.column("part").take(pa.array(np.full(len(names), r)))
                yield pa.RecordBatch.from_arrays([part, names, pa.array(np.tile(np.arange(1, 6, dtype=np.int32), len(orders))), *map(pa.array, values)], ["part", "filter_order", "step", *_VALUES])

    return rows.mapInArrow(tidied(run), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _VALUES))


_VALUES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns: ``part`` (source; null: ''), ``filter_order``, ``step`` and counts of documents.

    ``kept`` after the step, ``removed`` in it, ``redundant`` (fail its filter, gone before), ``unique_fails``,
    ``good_lost`` and ``toxic_lost`` of the removed, and ``shapley``, its filter's removals over all orders.
    """
    return audit(docs, labels)


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
h AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
      + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT
      + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(coalesce(d.doc_id, 9223372036854775807) > h.first, false)::INT AS mask,
      coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM d JOIN h USING (text) LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step - 1])::INT AS before FROM o, unnest([1, 2, 3, 4, 5]) t(step)),
x AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (coalesce(before, 0) | bit) = 0) AS kept,
      sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) = 0) AS removed, sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) > 0) AS redundant,
      sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) = 0) AS good_lost,
      sum(toxic) FILTER (mask & bit > 0 AND mask & coalesce(before, 0) = 0) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM x
"""
