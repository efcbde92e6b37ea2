"""Terms of a denylist in texts and in what files carry as text.

Terms that the driver holds make one automaton (a tree of their letters whose nodes know where to go on
after a mismatch and which terms end there), so a text is read once, however many terms there are.  Terms that are
a table meet the texts in a join (``join_terms``), so neither the driver nor a task holds all of them.
Letters A-Z count as a-z.  A term counts where no letter or digit stands before it and no digit behind
it, so numbers inside of longer ones are left alone.
"""

from __future__ import annotations

import base64
import binascii
import re
import struct
import zlib
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Terms of one automaton; more of them are as many passes over the texts.
TERMS_TOGETHER = 200_000
#: The first bytes of a PNG file, and the kinds of its chunks that hold text.
_PNG, _TEXT_CHUNKS = b"\x89PNG\r\n\x1a\n", (b"tEXt", b"zTXt", b"iTXt")
#: Bytes that a compressed text may unfold to; more of it is reported as an error and not read.
MOST_TEXT = 64 << 20
_EMBEDDED = re.compile(r"data:image/[a-z+]+;base64,([A-Za-z0-9+/=\s]+)")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def automaton(terms: Iterable[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for t in terms:
        out.add_word(t.translate(_LOWER), t)
    out.make_automaton()
    return out


def occurrences(known: ahocorasick.Automaton, text: str, whole: bool = True) -> list[tuple[int, str]]:
    """``(position, term)`` of every term in a text, overlapping ones too; by position, then longer terms first."""
    found, n = [], len(text)
    if not len(known) or not text:
        return found
    for end, term in known.iter(text.translate(_LOWER)):
        at = end - len(term) + 1
        before = text[at - 1] if at else " "
        behind = text[end + 1] if end + 1 < n else " "
        if not whole or not ((before.isascii() and before.isalnum()) or (behind.isascii() and behind.isdigit())):
            found.append((at, term))
    return sorted(found, key=lambda f: (f[0], -len(f[1])))


def find_terms(df: DataFrame, text: str, terms: Iterable[str], whole: bool = True) -> DataFrame:
    """The rows of ``df`` once for each term in their ``text``, with the term and ``at``, its position from 0.

    Empty terms are left out, terms that differ in case alone are one (the first), and a null or empty text
    holds none.  Columns ``at`` and ``term`` are replaced.  No shuffle: rows are read where they are.
    """
    first: dict[str, str] = {}
    for t in terms:
        if t:
            first.setdefault(t.translate(_LOWER), t)
    wanted = list(first.values())
    rest = [c for c in df.columns if c not in ("at", "term")]
    kind = df.select(*rest).withColumns({"at": F.lit(0), "term": F.lit("")}).schema
    out = None
    for k in range(0, max(1, len(wanted)), TERMS_TOGETHER):
        some = wanted[k : k + TERMS_TOGETHER]

        def run(batches, some=some):
            known = automaton(some)  # once for a task
            for batch in batches:
                found = [occurrences(known, t or "", whole) for t in batch.column(rest.index(text)).to_pylist()]
                rows = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns), pa.array([at for f in found for at, _ in f], pa.int32()), pa.array([t for f in found for _, t in f], pa.string())], [*rest, "at", "term"])

        part = df.select(*rest).mapInArrow(run, kind)
        out = part if out is None else out.unionByName(part)
    return out


# ---- terms that are a table

#: Bits of the filter that pieces of texts pass before they are joined with the terms: 16 MB, whatever the terms' number.
FILTER_BITS = 1 << 27
_WORD_BITS = 1 << 20
#: The base of the rolling hash and an odd factor that mixes its bits.
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _lowered(points: np.ndarray) -> np.ndarray:
    return np.where((points >= 65) & (points <= 90), points + 32, points)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)], dtype=np.uint64)


def _rolled(low: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Sums from which any piece's hash follows: that of ``a .. b - 1`` is the difference, turned to a common power."""
    return np.r_[np.uint64(0), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers[len(low) : 0 : -1], dtype=np.uint64)]


def _bit(hashes: np.ndarray, n) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(32))) * _MIX + np.uint64(1) * np.asarray(n, np.uint64)
    return ((mixed ^ (mixed >> np.uint64(29))) * _MIX >> np.uint64(37)).astype(np.int64) % FILTER_BITS


def _inverse(value: int) -> np.uint64:
    return np.uint64(pow(value, -1, 1 << 64))


def _filter(terms: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The bits of all terms, put together from pieces of fixed size, and the lengths that occur."""

    def bits(batches):
        for batch in batches:
            pieces = [_lowered(_points(t)) for t in batch.column(0).to_pylist()]
            powers = _powers(max(map(len, pieces), default=0))
            back = _inverse(int(_BASE))
            # A term's own sum has one more power than needed; all are turned to that of their last letter.
            own = np.array([_rolled(p, powers)[-1] * back for p in pieces], np.uint64)
            at = _bit(own, [len(p) for p in pieces]) if pieces else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at // _WORD_BITS).astype(np.int32)), pa.array(at % _WORD_BITS)], ["part", "bit"])

    def joined(key, table):
        on = np.zeros(_WORD_BITS, bool)
        on[np.asarray(table.column("bit"))] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([np.packbits(on).tobytes()], pa.binary())})

    out = np.zeros(FILTER_BITS // 8, np.uint8)
    found = terms.select("__term").mapInArrow(bits, "part int, bit long").distinct().groupBy("part").applyInArrow(joined, "part int, data binary")
    for r in found.toLocalIterator():
        out[r.part * _WORD_BITS // 8 :][: _WORD_BITS // 8] = np.frombuffer(r.data, np.uint8)
    lengths = [r.n for r in terms.select(F.char_length("__term").alias("n")).distinct().toLocalIterator()]
    return out, sorted(lengths)


def _candidates(texts: list[str], lengths: list[int], known: np.ndarray, whole: bool) -> list[tuple[int, int, str]]:
    """``(text, position, lowered piece)`` of the pieces of texts that the filter lets through and whose neighbours allow a hit."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    firsts = ends - sizes
    together = "".join(texts)
    low = _lowered(_points(together))
    n = len(low)
    sums = _rolled(low, _powers(n))
    back = np.cumprod(np.r_[np.uint64(1), np.full(n, _inverse(int(_BASE)))], dtype=np.uint64)
    digit = np.r_[(low >= 48) & (low <= 57), False]
    starts = np.arange(n)
    if whole:
        open_ = np.r_[True, ~(digit[:-1] | ((low >= 97) & (low <= 122)))][:n]
        open_[firsts[sizes > 0]] = True
        starts = np.flatnonzero(open_)
    owner = np.searchsorted(ends, starts, "right")
    end = ends[owner]
    out, lowered = [], None
    for size in lengths:
        to = starts + size
        fits = to <= end
        if whole:
            fits &= (to == end) | ~digit[np.minimum(to, n)]
        at, of = starts[fits], owner[fits]
        bit = _bit((sums[at + size] - sums[at]) * back[n - at - size + 1], size)
        hit = (known[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
        if hit.any():
            lowered = together.translate(_LOWER) if lowered is None else lowered
            out += [(o, i - f, lowered[i : i + size]) for o, i, f in zip(of[hit].tolist(), at[hit].tolist(), firsts[of[hit]].tolist(), strict=True)]
    return out


def _in_turn(texts: list[str | None]):
    """``(first, texts)``: so many texts in a row as have about a million letters."""
    some, first, held = [], 0, 0
    for k, t in enumerate(texts):
        some.append(t or "")
        held += len(some[-1])
        if held >= 1 << 20 or k == len(texts) - 1:
            yield first, some
            some, first, held = [], k + 1, 0


def join_terms(df: DataFrame, text: str, terms: DataFrame, term: str, whole: bool = True) -> DataFrame:
    """What ``find_terms`` gives, for terms in a column of a table; of terms that differ in case alone the least counts.

    Each text is read once: of its pieces as long as any term, those that pass a filter of fixed size (some
    of which are no terms) are joined with the terms.  The work grows with the texts and the number of
    different lengths of terms, not with the number of terms.
    """
    known_terms = terms.where(F.length(term) > 0).groupBy(F.translate(F.col(term), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("__term")).agg(F.min(term).alias("term"))
    bits, lengths = _filter(known_terms)
    shared = df.sparkSession.sparkContext.broadcast(bits)
    rest = [c for c in df.columns if c not in ("at", "term")]
    kind = df.select(*rest).withColumns({"at": F.lit(0), "__term": F.lit("")}).schema

    def run(batches):
        for batch in batches:
            found = [(first + o, at, piece) for first, some in _in_turn(batch.column(rest.index(text)).to_pylist()) for o, at, piece in _candidates(some, lengths, shared.value, whole)]
            rows, at, pieces = (list(c) for c in zip(*found, strict=True)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in batch.columns), pa.array(at, pa.int32()), pa.array(pieces, pa.string())], [*rest, "at", "__term"])

    return df.select(*rest).mapInArrow(run, kind).join(known_terms, "__term").select(*rest, "at", "term")


# ---- what files carry as text


def _unfolded(raw: bytes) -> bytes:
    work = zlib.decompressobj()
    out = work.decompress(raw, MOST_TEXT)
    if work.unconsumed_tail:
        raise ValueError(f"more than {MOST_TEXT} bytes of compressed text")
    return out


def png_texts(raw: bytes) -> list[tuple[str, str]]:
    """``(field, text)`` of the text chunks of a PNG file, and of bytes behind its end; what cannot be read is an ``error``."""
    if not raw.startswith(_PNG):
        return [("error", "not a PNG file")]
    out, at = [], len(_PNG)
    while at < len(raw):
        if at + 12 > len(raw):
            return [*out, ("error", "the last chunk is cut off")]
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if at + 12 + size > len(raw):
            return [*out, ("error", f"chunk {kind.decode('latin-1')} is cut off")]
        if struct.unpack_from(">I", raw, at + 8 + size)[0] != binascii.crc32(kind + body):
            out.append(("error", f"checksum of chunk {kind.decode('latin-1')}"))
        if kind in _TEXT_CHUNKS:
            try:
                key, _, rest = body.partition(b"\0")
                if kind == b"tEXt":
                    text = rest.decode("latin-1")
                elif kind == b"zTXt":
                    text = _unfolded(rest[1:]).decode("latin-1")
                else:
                    language, _, more = rest[2:].partition(b"\0")
                    translated, _, value = more.partition(b"\0")
                    text = " ".join(p for p in (translated.decode(), (_unfolded(value) if rest[:1] == b"\1" else value).decode()) if p)
                out.append((key.decode("latin-1"), text))
            except (zlib.error, UnicodeDecodeError, ValueError) as e:
                out.append(("error", f"text chunk: {e}"))
        at += 12 + size
        if kind == b"IEND":
            if raw[at:].strip(b"\0"):
                out.append(("behind the end", raw[at:].decode("latin-1")))
            break
    return out


def texts_of(name: str, raw: bytes) -> list[tuple[str, str]]:
    """``(field, text)`` of a file: text chunks of a PNG; the whole of a text or SVG file, and the text chunks of images inside of it."""
    if raw.startswith(_PNG) or name.lower().endswith(".png"):
        return png_texts(raw)
    text = raw.decode("utf-8", "replace")
    out = [("text", text)]
    for k, m in enumerate(_EMBEDDED.finditer(text)):
        try:
            inner = base64.b64decode(re.sub(r"\s", "", m[1]), validate=True)
        except (binascii.Error, ValueError) as e:
            out.append((f"image {k} error", str(e)))
            continue
        if inner.startswith(_PNG):
            out += [(f"image {k} {field}", t) for field, t in png_texts(inner)]
    return out


def file_texts(spark: SparkSession, folder: str, glob: str = "*", deep: bool = True) -> DataFrame:
    """``path, field, text`` of all files under a folder."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = texts_of(path, content)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([f for f, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())], ["path", "field", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(deep).lower()).load(folder)
    return files.select("path", "content").mapInArrow(run, "path string, field string, text string")
