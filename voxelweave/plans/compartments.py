"""Separation of a scan into cortical and trabecular compartments.

The chain of thirty steps runs on one volume inside one task (it is sequential, and every
step needs the whole volume), so scans run side by side: one shuffle by ``vol_id``, of packed voxels.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators import raster as R
from ..operators.contour import render
from ..operators.grid import Grid, packed, rows_of, unpacked
from ..operators.raster import SET, Raster


@dataclass(frozen=True)
class Compartments:
    """Values of the standard evaluation (tibia)."""

    sigma: float = 2.0
    support: int = 3
    lower_mgha: float = 500.0
    upper_mgha: float = 3000.0
    peel: int = 6
    erode: int = 3
    dilate: int = 3
    close_first: int = 15
    open_: int = 15
    corner_erode: int = 3
    corner_least: int = 200_000
    corner_dilate: int = 3
    corner_most: int = 500_000
    close_last: int = 50
    share_low: float = 50.0
    share_high: float = 100.0
    rank_first: int = 1
    rank_last: int = 1
    rank_join_border: bool = False
    mirror: tuple[int, int, int] = (0, 0, 0)
    contour_peel: int = 0
    border: tuple[int, int, int] = (0, 0, 0)

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, (int, float)) and not np.isfinite(v):
                raise ValueError(f"{f.name} is not finite")
            if f.type == "int" and v != int(v):
                raise ValueError(f"{f.name} must be whole, not {v}")

    def record(self) -> dict:
        return asdict(self)


TIBIA = Compartments()
RADIUS = Compartments(corner_least=800, close_last=30)


@dataclass(frozen=True)
class Calibration:
    slope: float
    intercept: float
    mu_scaling: float = 8192.0

    def native(self, mg: float) -> int:
        return int(np.rint((mg - self.intercept) / self.slope * self.mu_scaling))


def separate(grey: Raster, periosteal: Raster, p: Compartments, c: Calibration):
    """``(steps, cortical, trabecular)``; ``steps`` has the raster of each step by name."""
    whole = R.valued(periosteal, SET, 0)
    peels = {n: whole if n <= 0 else whole.with_on(R.peeled(whole.on, n)) for n in {p.contour_peel, p.peel}}
    steps: dict[str, Raster] = {}

    def step(name: str, r: Raster) -> Raster:
        steps[f"{len(steps):02d}_{name}"] = r
        return r

    rank = lambda r: R.keep_ranks(r, p.rank_first, p.rank_last, p.rank_join_border)
    shares = lambda r: R.keep_shares(r, p.share_low, p.share_high)
    step("all", whole)
    inside = R.masked(grey, peels[p.contour_peel])
    if not inside.on.any():
        raise ValueError("the periosteal contour selects no voxel of the scan: it is empty, or the grids do not meet")
    bone = step("seggauss", R.gauss_band(R.cut_box(inside, p.border), p.sigma, p.support, c.native(p.lower_mgha), c.native(p.upper_mgha)))
    marrow = step("trab0", R.saturated(whole, bone, -1))
    core = step("peel6", R.masked(marrow, peels[p.peel]))
    rest = step("rank1", rank(step("inv", R.valued(core, 0, SET))))
    first = step("trab1", R.saturated(whole, step("bgrm", R.masked(rest, peels[p.contour_peel])), -1))
    main = step("trabrank", rank(first))
    main = step("erorank", rank(step("ero3", R.erode(main, p.erode))))
    main = step("close15", R.close(step("dil3", R.dilate(main, p.dilate, p.mirror)), p.close_first, p.mirror))
    body = step("bbc", R.cut_box(step("close15peel", R.masked(main, peels[p.peel])), p.border))
    smooth = step("open15", R.open_(body, p.open_))
    corners = step("cornero", R.erode(step("corners", R.saturated(body, smooth, -1)), p.corner_erode))
    corners = step("cornmajor", R.dilate(step("corncl", R.keep_sizes(corners, p.corner_least)), p.corner_dilate, p.mirror))
    corners = step("corners2", R.keep_sizes(step("corncl2", R.keep_sizes(corners, p.corner_least)), 1, p.corner_most))
    body = step("close50", R.close(step("trabadd", R.saturated(corners, smooth, 1)), p.close_last, p.mirror))
    body = step("slicewise", shares(step("close50peel", R.masked(body, peels[p.peel]))))
    cort = step("cortslice", shares(step("cort", R.saturated(whole, body, -1))))
    cort = step("cortfinal", R.cut_box(cort, p.border))
    return steps, cort, step("trabfinal", R.saturated(whole, cort, -1))


def from_raw(grey: Raster, raw: Raster, p: Compartments, c: Calibration, rendered: bool = True):
    """The same with the contour rendered on its own box first."""
    box = R.cut_box(R.valued(raw, SET, 0))
    return separate(grey, box.with_on(render(box.on)) if rendered else box, p, c)


def compartments(grey: DataFrame, periosteal: DataFrame, grid: Grid, params: Compartments = TIBIA, calibration: Calibration | None = None, raw: bool = False) -> DataFrame:
    """``vol_id, z, y, x, v``: 1 cortical, 2 trabecular."""
    run = _runner(grid, params, calibration or Calibration(1619.07703, -394.095001), raw)

    def labels(key, table):
        _, cort, trab = run(table)
        low, shape = R.union_box(cort, trab)
        both = np.where(cort.over(low, shape) != 0, 1, np.where(trab.over(low, shape) != 0, 2, 0))
        return rows_of(key[0].as_py(), Raster(both, low))

    return packed(grey, periosteal).applyInArrow(labels, "vol_id string, z int, y int, x int, v int")


def compartment_steps(grey: DataFrame, periosteal: DataFrame, grid: Grid, params: Compartments = TIBIA, calibration: Calibration | None = None, raw: bool = False) -> DataFrame:
    """``vol_id, step, voxels, negative`` and the box of each step."""
    run = _runner(grid, params, calibration or Calibration(1619.07703, -394.095001), raw)

    def counts(key, table):
        steps, *_ = run(table)
        rows = [(key[0].as_py(), name, r.count(), int((r.data < 0).sum()), *r.origin, *r.shape) for name, r in steps.items()]
        names = ("vol_id", "step", "voxels", "negative", "oz", "oy", "ox", "nz", "ny", "nx")
        return pa.table({n: pa.array(list(c), pa.string() if k < 2 else pa.int64()) for k, (n, c) in enumerate(zip(names, zip(*rows, strict=True), strict=True))})

    return packed(grey, periosteal).applyInArrow(counts, "vol_id string, step string, voxels long, negative long, oz long, oy long, ox long, nz long, ny long, nx long")


def _runner(grid: Grid, params: Compartments, calibration: Calibration, raw: bool):
    def run(table):
        return (from_raw if raw else separate)(*unpacked(table, grid, 2), params, calibration)

    return run
