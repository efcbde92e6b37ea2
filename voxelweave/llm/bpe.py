"""BPE encoding and decoding (operator 5) with a segment tree over adjacent pair ranks.

A piece's symbols form a list; leaf i of the tree holds the rank of the pair that starts
at symbol i, joined with i, so the root is the leftmost pair of the lowest rank.  A merge
changes three leaves, each in logarithmic time, until no pair can merge.

Texts are cut into units: an optional space with the non-space run behind it, or white
space.  The pre-tokenizer never joins across units, so the ids of a unit do not depend
on what stands around it, and a worker encodes each distinct unit once while it is in
the cache.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, tidied

_INF = 1 << 62
_NONE = 1 << 30
_END = (1 << 20) - 1
#: Units that a worker keeps in each of the two generations of its cache.
CACHE_UNITS = 200_000
#: Rows and bytes that are encoded at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: The same where ids and decoded texts of a batch are held as well: less memory, and no more time.
ENCODED_ROWS, ENCODED_BYTES = 250, 1 << 20
#: Bytes of the longest piece that is merged together with others.
LONGEST = 64
#: Unicode white space.
_WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNITS = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_ODD_WHITE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_IS_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Spaces (1), letters of the alphabets that never change, below U+0250 (2), digits (3) and marks (4); the
#: pre-tokenizer cuts wherever two of them meet, and nowhere else.  All other bytes, and the apostrophe, are 0.
_CLASS = np.array([1 if b == 32 else 2 if 128 <= b < 202 or chr(b).isalpha() and b < 128 else 3 if 48 <= b < 58 else 4 * (33 <= b < 127 and b != 39) for b in range(256)])
_LETTERS = np.array([[194 <= a < 202 and 128 <= b < 192 and (c := (a & 31) << 6 | b & 63) < 0x250 and chr(c).isalpha() for b in range(256)] for a in range(256)])
#: Fixed value: no text's UTF-8 has this byte.
_MARK = b"\xff"
#: Units that the library's model gets in one call.
JOINED = 50
#: Fixed value: the pre-tokenizer's pattern inside a unit.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def merge(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Apply the merges to a list of symbol ids.

    ``ranks`` maps ``left << 20 | right`` to the pair's rank, ``made`` a rank to the id of
    the merged symbol.
    """
    n = len(symbols)
    get = ranks.get
    if n < 3:
        if n == 2 and (rank := get(symbols[0] << 20 | symbols[1], -1)) >= 0:
            return [made[rank]]
        return symbols
    bits = (n - 2).bit_length()
    size = 1 << bits
    mask = size - 1
    # Leaf i: rank and place of the pair that starts at i; above it the lesser of two.
    leaves = [rank << bits | i if (rank := get(a << 20 | b, -1)) >= 0 else _INF for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
    tree = [_INF] * size + leaves + [_INF] * (size - n + 1)
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    root = tree[1]
    while root < _INF:
        i = root & mask
        own = symbols[i] = made[root >> bits]
        j = after[i]
        k = after[i] = after[j]
        symbols[j] = -1
        if k < n:
            before[k] = i
            rank = get(own << 20 | symbols[k], -1)
            changes = [j, _INF, i, rank << bits | i if rank >= 0 else _INF]
        else:
            changes = [i, _INF]
        h = before[i]
        if h >= 0:
            rank = get(symbols[h] << 20 | own, -1)
            changes += (h, rank << bits | h if rank >= 0 else _INF)
        for c in range(0, len(changes), 2):
            at, value = size + changes[c], changes[c + 1]
            if at < 2 * size:
                tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                at >>= 1
                if other < value:
                    value = other
                if tree[at] == value:
                    break
                tree[at] = value
        root = tree[1]
    return [s for s in symbols if s >= 0]


class Merges:
    """The segment-tree merge of many short pieces at once, one array row for each piece.

    Rows of one padded width share a tree layout.  A round takes every row's root, merges
    there, sets three leaves and repairs the paths above them; rows without a mergeable
    pair are done.
    """

    def __init__(self, first: list[int], ranks: dict[int, int], made: list[int]):
        self.first = np.array(first, np.int64)
        keys = np.fromiter(ranks, np.int64, len(ranks))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(1) << 60)
        self.ranks = np.append(np.fromiter(ranks.values(), np.int64, len(ranks))[order], -1)
        self.made = np.array(made, np.int64)
        pair = (np.arange(256)[:, None], np.arange(256))
        self.of_bytes = self.leaf_rank(self.first[pair[0]], self.first[pair[1]])

    def leaf_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the pairs, or a number above all ranks."""
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece of at most LONGEST bytes, as little-endian 32-bit bytes."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = 2
        low = 0
        while low < LONGEST:
            at = np.flatnonzero((sizes > low) & (sizes <= width))
            for k in range(0, len(at), 8192):
                some = at[k : k + 8192]
                for place, ids in zip(some.tolist(), self.rows([pieces[p] for p in some.tolist()], sizes[some], width), strict=True):
                    out[place] = ids
            low, width = width, 2 * width
        return out

    def rows(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        m, bits = len(pieces), width.bit_length() - 1
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        # Symbols at 1 .. size; a column on either side stands for the ends.
        symbols = np.full((m, width + 2), _END, np.int64)
        inside = np.arange(width) < sizes[:, None]
        symbols[:, 1:-1] = np.where(inside, self.first[raw], _END)
        after = np.tile(np.arange(1, width + 3, dtype=np.int64), (m, 1))
        before = after - 2
        tree = np.full((m, 2 * width), _NONE << bits, np.int64)
        ranks = np.where(inside[:, 1:], self.of_bytes[raw[:, :-1], raw[:, 1:]], _NONE)
        tree[:, width : 2 * width - 1] = ranks << bits | np.arange(width - 1)
        half = width // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        alive = np.zeros((m, width + 2), bool)
        alive[:, 1:-1] = inside
        mask, none = width - 1, _NONE << bits
        row = np.flatnonzero(tree[:, 1] < none)
        while len(row):
            root = tree[row, 1]
            i = (root & mask) + 1
            own = self.made[root >> bits]
            j = after[row, i]
            k = after[row, j]
            h = before[row, i]
            symbols[row, i] = own
            alive[row, j] = False
            after[row, i] = k
            before[row, k] = i
            right, left = symbols[row, k], symbols[row, h]
            r = self.leaf_rank(np.concatenate((own, left)), np.concatenate((right, own)))
            # A leaf of the end columns never merges; it is written to the unused last leaf.
            leaves = np.stack((j - 1, i - 1, np.where(h > 0, h - 1, mask)))
            leaves[0] = np.minimum(leaves[0], mask)
            n = len(row)
            values = np.stack((np.full(n, none), r[:n] << bits | leaves[1], np.where(h > 0, r[n:] << bits | leaves[2], none)))
            rows3 = np.broadcast_to(row, (3, n))
            at = leaves + width
            tree[rows3, at] = values
            for _ in range(bits):
                at = at >> 1
                tree[rows3, at] = np.minimum(tree[rows3, 2 * at], tree[rows3, 2 * at + 1])
            row = row[tree[row, 1] < none]
        flat = symbols[alive].astype("<u4").tobytes()
        ends = (np.cumsum(alive.sum(axis=1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Units(dict):
    """Ids of units (or pieces) as little-endian 32-bit bytes, in two generations of bounded size."""

    def __init__(self, encode: Callable[[bytes], Iterable[int] | bytes], most: int = CACHE_UNITS):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, unit: bytes) -> bytes:
        return self.all([unit], lambda new: [_packed(self.encode(u)) for u in new])[0]

    def all(self, units: list[bytes], encode_many: Callable[[list[bytes]], Iterable[bytes]]) -> list[bytes]:
        """Ids of distinct units; those that are new are encoded in one call."""
        found = list(map(self.get, units))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        if gaps:
            new = []
            for i in gaps:
                found[i] = self.old.get(units[i])
                if found[i] is None:
                    new.append(i)
            for i, ids in zip(new, encode_many([units[i] for i in new]), strict=True):
                found[i] = ids
            if len(self) + len(gaps) > self.most:
                self.old = dict(self)
                self.clear()
            self.update((units[i], found[i]) for i in gaps[: self.most] if len(units[i]) < 200)
        return found


def _packed(ids: Iterable[int] | bytes) -> bytes:
    return ids if isinstance(ids, bytes) else array("I", ids).tobytes()


def tiles(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts in one buffer, where its units start, and the first unit of each text.

    The same cuts as ``_UNITS`` makes in texts whose white space is ASCII alone: a run of
    white space, its last character apart if a word follows, and a word with the space
    before it.  Units cover the texts without gaps.
    """
    joined = b"".join(texts)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    starts = np.concatenate(([0], ends[:-1])) if len(texts) else np.zeros(0, np.int64)
    some = ends > starts
    raw = np.frombuffer(joined, np.uint8)
    first, last = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    first[starts[some]] = True
    last[ends[some] - 1] = True
    white = _IS_WHITE[raw]
    before, after, space = np.zeros(len(raw), bool), np.ones(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1], space[1:] = white[:-1], white[1:], raw[:-1] == 32
    before &= ~first
    space &= ~first
    cut = first | (white & ~before) | (white & ~after & ~last) | (~white & before & ~space)
    places = np.flatnonzero(cut)
    return joined, places, np.searchsorted(places, np.append(starts, len(raw)))


class Codec:
    """A byte-level BPE vocabulary file: whole texts to ids and back."""

    def __init__(self, path: str, own_merges: bool = True):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = [vocab[a + b] for a, b in pairs]
        # The byte alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in vocab.items():
            self.bytes_of[i] = bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode()
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.byte = byte
        self.first = [vocab[c] for c in sorted(byte, key=byte.get)]
        self.alphabet = "".join(sorted(byte, key=byte.get))
        # Two bytes that stand together in no token never merge: what meets there is encoded alike, joined or apart.
        self.sizes = np.array(list(map(len, self.bytes_of)))
        raw, inner = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.setdiff1d(np.arange(self.sizes.sum()), np.cumsum(self.sizes) - 1)
        self.apart = np.ones((256, 256), bool)
        self.apart[raw[inner], raw[inner + 1]] = False
        model = self.library.model
        self.joins = self.apart[255].all() and self.apart[:, 255].all() and not (model.ignore_merges or model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix)
        self.merges = Merges(self.first, self.ranks, self.made)
        self.pieces = Units(self.of_piece, CACHE_UNITS // 3)
        self.units = Units(self.by_tree if own_merges else self.by_library)
        self.many = self.many_by_tree if own_merges else self.many_by_library

    def of_piece(self, piece: bytes) -> list[int]:
        return merge([self.first[b] for b in piece], self.ranks, self.made)

    def split(self, unit: str) -> list[bytes]:
        if max(unit) < "\u0250":
            body = unit[1:] if unit[0] == " " else unit
            if body.isalpha():
                return [unit.encode()]
            if body[:-1].isalpha() and not body[-1].isalnum():  # a word and one mark behind it
                return [unit[:-1].encode(), unit[-1].encode()]
            return [p.encode() for p in _PIECES.findall(unit)]
        # Beyond the alphabets that never change, the library's own character classes count.
        return [bytes(map(self.byte.__getitem__, p)) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(unit)]

    def by_tree(self, unit: bytes) -> bytes:
        return b"".join([self.pieces[p] for p in self.split(unit.decode())])

    def many_by_tree(self, units: list[bytes]) -> list[bytes]:
        cut = [self.split(u.decode()) for u in units]
        pieces = list({p for parts in cut for p in parts})
        ids = dict(zip(pieces, self.pieces.all(pieces, self.many_pieces), strict=True))
        return [ids[parts[0]] if len(parts) == 1 else b"".join([ids[p] for p in parts]) for parts in cut]

    def many_pieces(self, pieces: list[bytes]) -> list[bytes]:
        short = [p for p in pieces if len(p) <= LONGEST]
        ids = dict(zip(short, self.merges(short), strict=True))
        return [ids[p] if p in ids else _packed(self.of_piece(p)) for p in pieces]

    def by_library(self, unit: bytes) -> list[int]:
        return self.library.encode(unit.decode(), add_special_tokens=False).ids

    def letters(self, piece: bytes) -> str:
        """The piece in the vocabulary's byte alphabet."""
        return codecs.charmap_decode(piece, "strict", self.alphabet)[0]

    def many_by_library(self, units: list[bytes]) -> list[bytes]:
        """By the library's model; what is not plain Latin also by its pre-tokenizer."""
        model, out = self.library.model, self.joined(units) if self.joins else [b""] * len(units)
        for i, ids in enumerate(out):
            if not ids:
                u = units[i].decode()
                if max(u) < "\u0250":
                    out[i] = array("I", [t.id for p in self.split(u) for t in model.tokenize(self.letters(p))]).tobytes()
                else:
                    out[i] = _packed(self.by_library(units[i]))
        return out

    def plain(self, units: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Which units are a space at most and then letters, digits and marks, where nothing can
        merge across the pre-tokenizer's cuts nor with a space that follows."""
        ends = np.cumsum(sizes)
        starts = ends - sizes
        raw = np.frombuffer(b"".join(units), np.uint8)
        kind, first = _CLASS[raw], np.zeros(len(raw), bool)
        first[starts] = True
        odd = (kind == 0) | (kind == 1) & ~first
        lead = np.flatnonzero((raw >= 194) & (raw < 202))
        odd[lead] |= ~_LETTERS[raw[lead], raw[lead + 1]]
        odd[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != 1) & ~first[1:] & ~self.apart[raw[:-1], raw[1:]]
        out = (sizes <= LONGEST) & (kind[ends - 1] != 1) & self.apart[raw[ends - 1], 32]
        out[np.searchsorted(ends, np.flatnonzero(odd), "right")] = False
        return out

    def joined(self, units: list[bytes]) -> list[bytes]:
        """Ids of plain units, many in a call of the model; the tokens' lengths in bytes tell where
        each unit's ids are.  Units without a space stand behind a mark; others have no ids here."""
        model, ids, out = self.library.model, array("I"), [b""] * len(units)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        some = np.flatnonzero(self.plain(units, sizes))
        parts = [u if u[0] == 32 else _MARK + u for u in map(units.__getitem__, some.tolist())]
        for k in range(0, len(parts), JOINED):
            ids.extend([t.id for t in model.tokenize(self.letters(b"".join(parts[k : k + JOINED])))])
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        done = np.cumsum(self.sizes[np.frombuffer(ids, np.uint32)])
        at = [(np.searchsorted(done, x, "right") * 4).tolist() for x in (ends - sizes[some], ends)]
        flat = ids.tobytes()
        for i, a, b in zip(some.tolist(), *at, strict=True):
            out[i] = flat[a:b]
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of whole texts: units are cut and told apart by array operations,
        each distinct one is looked up once, and the ids are gathered."""
        plain = [i for i, t in enumerate(texts) if not any(s in t for s in self.special) and (t.isascii() or not _ODD_WHITE.search(t))]
        out = [b""] * len(texts)
        for i in set(range(len(texts))).difference(plain):
            out[i] = self.encode(texts[i])
        joined, places, heads = tiles([texts[i].encode() for i in plain])
        if not len(places):
            return out
        offsets = np.append(places, len(joined)).astype(np.int32 if len(joined) < 1 << 31 else np.int64)
        kind = pa.binary() if offsets.dtype == np.int32 else pa.large_binary()
        coded = pa.Array.from_buffers(kind, len(places), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
        ids = self.units.all(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.many)
        taken = pa.array(ids, pa.large_binary()).take(coded.indices)
        tokens, bounds = memoryview(taken.buffers()[2]), np.frombuffer(taken.buffers()[1], np.int64)[heads].tolist()
        for i, a, b in zip(plain, bounds[:-1], bounds[1:], strict=True):
            out[i] = tokens[a:b].tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        of = self.units.__getitem__
        units = lambda t: b"".join([of(u.encode()) for u in _UNITS.findall(t)])
        if self.cut is None or not any(s in text for s in self.special):
            return units(text)
        out = []
        for k, part in enumerate(self.cut.split(text)):
            out.append(_packed([self.special[part]]) if k % 2 else units(part))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@cache
def codec(path: str, own_merges: bool = True) -> Codec:
    """One codec, with its cache, for all tasks of a Python worker."""
    return Codec(path, own_merges)


def larger(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches joined up to so many rows or bytes: the more text, the fewer distinct units."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _spans(lengths: list[int], total: int) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(np.asarray(lengths, np.int64)))), pa.int64()).cast(pa.int32())


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``out_col``: the ids of each whole text (null: empty) as an array of ints.

    No special token is added; strings of special tokens in a text become those tokens,
    as in the vocabulary's own library.  ``decoded_col`` also decodes the ids again in the
    same pass; without ``keep_text`` the text is not handed on.  Columns with the names of
    new ones are replaced; all others are passed on as they are.
    """
    prepare(docs.sparkSession)
    path = path or vocabulary_path()
    new = [c for c in (out_col, decoded_col) if c]
    taken = [c for c in docs.columns if c not in new or c == text_col]
    rest = [c for c in taken if c not in new and (keep_text or c != text_col)]
    kinds = {out_col: "array<int>", decoded_col: "string"}
    schema = docs.select(*rest).withColumns({c: F.lit(None).cast(kinds[c]) for c in new}).schema

    def run(batches):
        own = codec(path)
        for batch in larger(batches, ENCODED_ROWS, ENCODED_BYTES):
            ids = own.encode_all([t or "" for t in batch.column(taken.index(text_col)).to_pylist()])
            flat = np.frombuffer(b"".join(ids), "<i4")
            out = [pa.ListArray.from_arrays(_spans([len(x) // 4 for x in ids], len(flat)), pa.array(flat, pa.int32()))]
            if decoded_col:
                out.append(pa.array([own.decode(np.frombuffer(x, "<u4")) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(taken.index(c)) for c in rest], *out], [*rest, *new])

    return docs.select(*taken).mapInArrow(tidied(run), schema)


def decode(coded: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``coded`` with ``out_col``: the text of each id list (null: empty); special tokens stay."""
    prepare(coded.sparkSession)
    path = path or vocabulary_path()
    rest = [c for c in coded.columns if c != out_col]
    field = coded.select(*rest).withColumn(out_col, F.lit(None).cast("string"))

    def run(batches):
        own = codec(path)
        for batch in batches:
            column = batch.column(rest.index(ids_col))
            flat, ends = np.asarray(column.values), np.asarray(column.offsets)
            texts = [own.decode(flat[a:b]) if ok else "" for a, b, ok in zip(ends[:-1], ends[1:], column.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*rest, out_col])

    return coded.select(*rest).mapInArrow(tidied(run), field.schema)


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: ``doc_id``, ``n_tokens`` and the hashes of the ids and of the decoded text."""
    out = encode(docs.select("doc_id", "text"), decoded_col="decoded", keep_text=False)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
