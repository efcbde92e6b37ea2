"""Vector columns as NumPy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrices(ids: pa.Array, lists: pa.Array):
    """``(places, ids, matrix)`` for each length that occurs in a batch.

    Left out: null ids, null or empty vectors, and those with null or non-finite components.
    """
    if len(lists) == 0:
        return
    offsets = np.asarray(lists.offsets, np.int64)
    values = np.asarray(lists.values.cast(pa.float64()).fill_null(np.nan), np.float64)
    sizes = np.where(np.asarray(lists.is_valid()) & np.asarray(ids.is_valid()), np.diff(offsets), 0)
    own = np.asarray(ids.fill_null(0), np.int64)
    for size in np.unique(sizes[sizes > 0]).tolist():
        places = np.flatnonzero(sizes == size)
        matrix = values[offsets[places][:, None] + np.arange(size)]
        fine = np.isfinite(matrix).all(axis=1)
        if fine.any():
            yield places[fine], own[places[fine]], matrix[fine]
