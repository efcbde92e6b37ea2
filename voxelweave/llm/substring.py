"""Substring dedup (operator 2) by level-wise doubling.

A passage of ``window`` words goes where an earlier document holds it too.  Windows are
hashed at a first length; those that two documents share go on to twice that length, and so
on up to the whole window, until none is left.  Below the whole window not every position
counts: of the shorter windows inside each whole window only the one with the least hash
does.  It depends on the words alone, so equal windows choose equal anchors, and no repeat
is lost while a first length of 7 deals out one position in 22.  A text is cut into words
for the first level only; from then on a level reads what the one before it left, the word
hashes of the spans that its repeated windows cover.  Documents that copy a smaller one word
by word are known by their whole hash and lose everything at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, fits, keyed, prepare, public_id, small, tidied, with_side
from .wordhash import mix, sliding, split_words, window_hashes, word_hashes

_OUT_ROWS = 100_000


def _long(x) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).astype(np.uint64).view(np.int64), pa.int64())


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind) -> pa.Array:
    """A list for each of ``n`` rows of the values that ``owner`` (ascending) gives it."""
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def least_inside(hashes: np.ndarray, offsets: np.ndarray, length: int, window: int):
    """For every start: the least hash of the ``length``-word windows inside the whole one.

    Returns those hashes, whether the whole window lies in one text, and the text of each word.
    """
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = len(hashes) - window + 1
    if n <= 0:
        return hashes[:0], np.zeros(0, bool), owner, hashes[:0]
    lower = window_hashes(hashes, length)
    return sliding(lower, window - length + 1, np.minimum), owner[:n] == owner[window - 1 :], owner, lower


def anchor_positions(hashes: np.ndarray, offsets: np.ndarray, length: int, window: int, live=None):
    """Positions, hashes and texts of the anchors of all (live) whole windows."""
    least, valid, owner, lower = least_inside(hashes, offsets, length, window)
    if live is not None:
        valid = valid & live
    pad = np.zeros(window - length, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate((pad, np.where(valid, least, 0), pad)), window - length + 1, np.maximum) == lower) if len(least) else np.zeros(0, int)
    return at, lower[at], owner[at]


def signatures(base: DataFrame, length: int, window: int) -> DataFrame:
    """Word count, 128-bit hash of all words and the anchors of each text."""

    def run(batches):
        for batch in batches:
            coded, offsets = split_words(batch.column("text"))
            hashes = word_hashes(coded)
            _, values, owner = anchor_positions(hashes, offsets, length, window)
            raw, ends = hashes.tobytes(), (offsets * 8).tolist()
            whole = np.array([divmod(xxhash.xxh3_128_intdigest(raw[a:b]), 1 << 64) for a, b in zip(ends, ends[1:])], np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("did"), batch.column("rk"), pa.array(np.diff(offsets), pa.int64()), _long(whole[:, 0]), _long(whole[:, 1]), _lists(values.view(np.int64), owner, batch.num_rows, pa.int64())],
                ["did", "rk", "n_words", "c1", "c2", "anchors"],
            )

    return base.mapInArrow(tidied(run), "did long, rk long, n_words long, c1 long, c2 long, anchors array<long>")


def live_windows(hashes: np.ndarray, offsets: np.ndarray, length: int, window: int, known: pa.Array) -> np.ndarray:
    """Which whole windows have an anchor that is known to be repeated."""
    least, valid, *_ = least_inside(hashes, offsets, length, window)
    return valid & np.isin(least, np.unique(np.asarray(known.flatten()).view(np.uint64)))


def covered(live: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of words that overlapping live windows cover.

    Windows of two texts never overlap.  A whole window that repeats is live itself, so it
    lies in one run.
    """
    at = np.flatnonzero(live)
    if not len(at):
        return at, at
    apart = np.flatnonzero(np.diff(at) >= window)
    return at[np.r_[0, apart + 1]], at[np.r_[apart, len(at) - 1]] + window


def _spans(batch, hashes, offsets, base, window, live, longer):
    """A row for each run of words that live windows cover, with the anchors of the next length."""
    low, high = covered(live, window)
    sizes = high - low
    text = np.searchsorted(offsets, low, side="right") - 1
    at = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    own = hashes[at]
    ends = np.r_[0, np.cumsum(sizes)]
    _, values, owner = anchor_positions(own, ends, longer, window)
    raw = pa.Array.from_buffers(pa.large_binary(), len(low), [None, pa.py_buffer((8 * ends).astype(np.int64)), pa.py_buffer(own)]).cast(pa.binary())
    place = pa.array(text, pa.int64())
    start = (base[text] + low - offsets[text]).astype(np.int32)
    return pa.RecordBatch.from_arrays([batch.column("did").take(place), batch.column("rk").take(place), pa.array(start), raw, _lists(values.view(np.int64), owner, len(low), pa.int64())], ["did", "rk", "start", "words", "anchors"])


def _whole(batch, hashes, offsets, base, window, live):
    """Rows with a 128-bit hash for each live window."""
    at = np.flatnonzero(live)
    first, second = window_hashes(hashes, window), window_hashes(mix(hashes, np.ones(1, np.uint64)), window)
    text = np.searchsorted(offsets, at, side="right") - 1
    did, rk = np.asarray(batch.column("did")), np.asarray(batch.column("rk"))
    for k in range(0, len(at), _OUT_ROWS):
        s, d = at[k : k + _OUT_ROWS], text[k : k + _OUT_ROWS]
        yield pa.RecordBatch.from_arrays([_long(first[s]), _long(second[s]), pa.array(did[d]), pa.array(rk[d]), pa.array((base[d] + s - offsets[d]).astype(np.int32))], ["h1", "h2", "did", "rk", "pos"])


def next_level(rows: DataFrame, length: int, longer: int, window: int) -> DataFrame:
    """What the repeated anchors of ``length`` words leave of texts or spans.

    Spans with the anchors of ``longer`` words, or if that is the whole window its hashes.
    """
    source = "text" if "text" in rows.columns else "words"

    def run(batches):
        for batch in batches:
            if source == "text":
                coded, offsets = split_words(batch.column("text"))
                hashes, base = word_hashes(coded), np.zeros(batch.num_rows, np.int64)
            else:
                raw = batch.column("words").to_pylist()
                hashes, offsets = np.frombuffer(b"".join(raw), np.uint64), np.r_[0, np.cumsum([len(x) // 8 for x in raw])]
                base = np.asarray(batch.column("start")).astype(np.int64)
            live = live_windows(hashes, offsets, length, window, batch.column("anchors"))
            if longer == window:
                yield from _whole(batch, hashes, offsets, base, window, live)
            else:
                yield _spans(batch, hashes, offsets, base, window, live, longer)

    return rows.mapInArrow(tidied(run), "h1 long, h2 long, did long, rk long, pos int" if longer == window else "did long, rk long, start int, words binary, anchors array<long>")


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that two documents hold, and the first of them; a table of its own, so that Spark can split a join with it."""
    return cut(rows.groupBy(*keys).agg(F.min("did").alias("first"), F.max("did").alias("last")).where("first < last").drop("last"))


def _held(anchors: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The repeated anchors of each text or span that has any; and the anchors."""
    rows = anchors.select(*keys, F.explode("anchors").alias("h"))
    again = _repeated(rows, ["h"])
    return cut(rows.join(small(again.select("h")), "h").groupBy(*keys).agg(F.collect_set("h").alias("anchors"))), again


def _with_anchors(rows: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """The texts or spans that have a repeated anchor, with their anchors; others meet no shuffle if there are not too many of these."""
    ids = held.select(*keys)
    return (rows.join(F.broadcast(ids), keys, "left_semi") if fits(ids) else rows).join(held.hint("shuffle_hash"), keys)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, first_length: int = 7) -> DataFrame:
    """``(did, rk, whole, starts)`` for each text that loses words.

    ``starts`` are the positions of the windows that a smaller id holds; ``whole`` says
    that the text has the very words of a smaller id.
    """
    base = keyed(docs, id_col, text_col)
    own = cut(signatures(base, min(first_length, window), window))
    long_ones = own.where(F.col("n_words") >= window)
    same = _repeated(long_ones.select("c1", "c2", "did"), ["c1", "c2"])
    copies = cut(long_ones.select("did", "rk", "c1", "c2").join(small(same), ["c1", "c2"]).where("did > first").select("did", "rk").distinct())
    length, keys = min(first_length, window), ["did", "rk"]
    held, again = _held(long_ones.join(small(copies), keys, "left_anti").select("did", "rk", "anchors"), keys)
    done = [own, same, again]
    source = _with_anchors(base, held, keys)
    while True:
        longer = min(2 * length, window)
        left = cut(next_level(source, length, longer, window))
        done.append(held)
        if longer == window:
            break
        length, keys = longer, ["did", "rk", "start"]
        held, again = _held(left.select(*keys, "anchors"), keys)
        done += [left, again]
        source = _with_anchors(left.drop("anchors"), held, keys)
    again = _repeated(left, ["h1", "h2"])
    starts = left.join(again, ["h1", "h2"]).where("did > first").groupBy("did", "rk").agg(F.collect_list("pos").alias("starts"))
    out = cut(starts.select("did", "rk", F.lit(False).alias("whole"), "starts").unionByName(copies.select("did", "rk", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("starts"))))
    for t in (*done, left, again, copies):
        drop_cut(t)
    return out


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, first_length: int = 7) -> DataFrame:
    """``(did, rk, n_words, n_removed, kept_text)`` for each row of ``docs``.

    Every word goes that is covered by a window of ``window`` words which also starts in
    a smaller id, judged on the texts as they came; the other words are joined by one
    space.  Words are runs of ``[^\\x20\\x09-\\x0D]``, unchanged; a null text has none.  A null
    id is larger than any other; rows with one id are one document, so they lose nothing
    to each other.  An empty table gives an empty one; no column of ``docs`` but these two is
    read, so names cannot clash.
    """
    prepare(docs.sparkSession)
    side = repeated_passages(docs, id_col, text_col, window, first_length)

    def run(batches):
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, whole, starts in zip(batch.column("text").to_pylist(), batch.column("whole").to_pylist(), batch.column("starts")):
                words = text.encode().split()
                counts.append(len(words))
                if whole:
                    removed.append(len(words))
                    words = []
                elif starts.is_valid:
                    at = np.asarray(starts.values)
                    cover = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + window, minlength=len(words) + 1)[: len(words) + 1]
                    free = (np.cumsum(cover)[: len(words)] == 0).tolist()
                    removed.append(len(words) - sum(free))
                    words = [w for w, f in zip(words, free) if f]
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("rk"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["did", "rk", "n_words", "n_removed", "kept_text"])

    return with_side(keyed(docs, id_col, text_col), side, ["did", "rk"]).mapInArrow(tidied(run), "did long, rk long, n_words long, n_removed long, kept_text string")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: ``doc_id``, ``n_words``, ``n_removed`` and the hash of the kept words."""
    out = remove_repeated_passages(docs)
    return out.select(public_id().alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
dup AS (SELECT win.doc_id, win.i FROM win JOIN (SELECT key, min(doc_id) AS first FROM win GROUP BY key) f USING (key) WHERE win.doc_id > f.first),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
m AS (SELECT p.doc_id, p.word, p.i, coalesce(max(dup.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) > p.i - 50, false) AS gone
      FROM p LEFT JOIN dup ON p.doc_id = dup.doc_id AND p.i = dup.i),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.n, 0)::BIGINT AS n_words, coalesce(a.r, 0)::BIGINT AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
