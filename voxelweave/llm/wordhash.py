"""Vectorised words and window hashes of Arrow text columns.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``.  All words of a batch are cut and
dictionary-encoded by Arrow, only the distinct ones are hashed, and window hashes come
from doubling: a window of 2L words mixes the hashes of its two halves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_M3 = np.uint64(0xFF51AFD7ED558CCD)
_S29, _S32 = np.uint64(29), np.uint64(32)


def split_words(texts) -> tuple[pa.Array, np.ndarray]:
    """Words of a batch: the dictionary-encoded flat words and each text's offsets (null: none)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    coded = lists.flatten().dictionary_encode()
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # leading and trailing white space leaves empty strings
        codes = np.asarray(coded.indices)
        keep = codes != empty
        before = np.concatenate(([0], np.cumsum(keep)))
        offsets = before[offsets]
        coded = pa.DictionaryArray.from_arrays(pa.array(codes[keep], pa.int32()), coded.dictionary)
    return coded, offsets


def word_hashes(coded: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash for every word."""
    own = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return own[np.asarray(coded.indices)]


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for two adjacent windows; the order matters."""
    x = a * _M1
    x ^= x >> _S32
    x += b
    x *= _M2
    x ^= x >> _S29
    x *= _M3
    x ^= x >> _S32
    return x


def window_hashes(hashes: np.ndarray, length: int, known: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Hashes of all windows of ``length`` consecutive entries, by doubling.

    ``known`` maps lengths to hashes that are already there; new levels are added.
    """
    known = {} if known is None else known
    if length <= 1:
        return hashes
    if length not in known:
        half = (length + 1) // 2
        lower = window_hashes(hashes, half, known)
        n = len(hashes) - length + 1
        known[length] = mix(lower[:n], lower[length - half : length - half + n]) if n > 0 else hashes[:0]
    return known[length]


def sliding(values: np.ndarray, width: int, reduce) -> np.ndarray:
    """``reduce`` (np.minimum or np.maximum) over each ``width`` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = reduce(out[:-step], out[step:])
        have += step
    return out

