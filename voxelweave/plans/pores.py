"""Cortical pores: closed and open ones, grown along z between the contour's slices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..operators import raster as R
from ..operators.grid import Grid, each_volume_with
from ..operators.raster import SET, Raster


@dataclass(frozen=True)
class Pores:
    """Values of the standard evaluation."""

    low: int = 1
    high: int = 3
    mode: int = 0
    axes: tuple[int, int, int] = (1, 0, 0)
    share_low: float = 0.0
    share_high: float = 5.0
    least: int = 20
    most: int = 0
    marrow_rank: tuple[int, int] = (1, 1)
    marrow_join_border: bool = False
    contour_peel: int = 0
    margin: int = 2
    clip_low: int | None = 0


def render_box(contour: Raster, margin: int = 2, clip_low: int | None = 0):
    """``(origin, shape)`` of the box that the contour is drawn on, or None if it is empty."""
    used = np.flatnonzero(contour.on.any(axis=(1, 2)))
    if not len(used):
        return None
    low, high = [], []
    for axis, start in ((2, contour.origin[1]), (1, contour.origin[2])):
        lines = contour.on.any(axis=axis)[used]
        first = lines.argmax(axis=1)
        last = lines.shape[1] - 1 - lines[:, ::-1].argmax(axis=1)
        least = int(first.min()) + start
        low.append(least - margin if clip_low is None else max(least - margin, min(least, clip_low)))
        high.append(int((last + ((last - first + 1) % 2 == 0)).max()) + start + margin)
    z = int(used[0]) + contour.origin[0], int(used[-1]) + contour.origin[0]
    return (z[0], *low), (z[1] - z[0] + 1, high[0] - low[0] + 1, high[1] - low[1] + 1)


def cascade(contour: Raster, bone: Raster, p: Pores | None = None, stages: dict | None = None) -> Raster:
    """Pore voxels.  In the combined volume a contour voxel is 0 to 3 for what it may be of
    a pore, bone 125 or more; runs of weak voxels along the growing axes with a seed are pores."""
    p = p or Pores()
    stages = {} if stages is None else stages
    shares = lambda r, value=SET: R.keep_shares(r, p.share_low, p.share_high, value)
    edge = contour.with_on(R.peeled(contour.on, p.contour_peel)) if p.contour_peel > 0 else contour
    closed = stages["closed"] = shares(R.valued(bone, 0, 127), 1)
    solid = R.valued(bone, 125, 0)
    gaps = R.saturated(R.saturated(R.valued(contour, 125, 0), solid, -1), R.valued(contour, 0, 125), 1)
    marrow = stages["marrow"] = R.masked(R.keep_ranks(gaps, *p.marrow_rank, p.marrow_join_border, 2), edge)
    ring = R.saturated(R.valued(contour, 2, 0), marrow, -1)
    mixed = stages["mixed"] = R.saturated(ring, R.saturated(closed, solid, 1), 1)
    grown = R.masked(R.hysteresis(mixed, p.low, p.high, p.mode, p.axes), edge)
    pores = stages["grown"] = R.saturated(grown, R.valued(marrow, 127, 0), -1)
    added = shares(R.valued(R.saturated(pores, bone, 1), 0, 127))
    both = stages["all"] = R.saturated(pores, added, 1)
    return R.keep_sizes(both, p.least, p.most)


def cascade_on_own_grid(contour: Raster, bone: Raster, p: Pores | None = None, stages: dict | None = None) -> Raster:
    """The cascade on the grids that the contour and the bone are stored on, whatever the input's."""
    p = p or Pores()
    box = render_box(contour, p.margin, p.clip_low)
    if box is None:
        raise ValueError("the cortical contour is empty")
    own = Raster(contour.over(*box), box[0])
    if own.count() != contour.count():
        raise AssertionError(f"{contour.count() - own.count()} contour voxels lie outside the box {box}")
    tight = R.tight_box(bone.on)
    seg = Raster(bone.over(*box), box[0]) if tight is None else Raster(bone.data[tight], tuple(o + s.start for o, s in zip(bone.origin, tight, strict=True)))
    return cascade(own, seg, p, stages)


def pores(contour: DataFrame, bone: DataFrame, grid: Grid, params: Pores | None = None, own_grid: bool = True) -> DataFrame:
    """Pore voxels of each volume: one task a volume."""
    run = cascade_on_own_grid if own_grid else cascade
    return each_volume_with(contour, bone, lambda a, b: run(a, b, params), grid)
