"""Whole-volume and slice operators on voxel tables: kernels behind a DataFrame face.

Where an operator has a form on slabs, a volume of more than one slab (``slabs.SLAB_VOXELS``, or of more
planes than ``height``) takes it; a smaller one is a single task.  The results are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import contour, frequency, raster, slabs, sphere
from .grid import AXES, KEYS, Grid, crop, each_slice, each_volume, each_volume_with, raster_of
from .raster import Raster


def _many(grid: Grid, height: int | None) -> bool:
    return grid.shape[0] > slabs.slab_height(grid, height)


def labels(voxels: DataFrame, grid: Grid, height: int | None = None) -> DataFrame:
    """``v`` is the label of the voxel's 6-connected component, in raster order from 1 on."""
    if _many(grid, height):
        return slabs.labels(voxels, grid, height)
    return each_volume(voxels, lambda r: Raster(raster.label(r.on, raster.SIX)[0], r.origin), grid)


def slice_labels(voxels: DataFrame, grid: Grid, eight: bool = False) -> DataFrame:
    steps = raster.EIGHT if eight else raster.FOUR
    return each_slice(voxels, lambda a: raster.label((a != 0)[None], steps)[0][0], grid)


def keep_ranks(voxels, grid, first=1, last=1, join_border=False, value=raster.SET, height=None):
    if _many(grid, height):
        return slabs.keep_ranks(voxels, grid, first, last, join_border, value, height)
    return each_volume(voxels, lambda r: raster.keep_ranks(r, first, last, join_border, value), grid)


def keep_sizes(voxels, grid, least=1, most=0, value=raster.SET, height=None):
    if _many(grid, height):
        return slabs.keep_sizes(voxels, grid, least, most, value, height)
    return each_volume(voxels, lambda r: raster.keep_sizes(r, least, most, value), grid)


def keep_shares(voxels, grid, low=50.0, high=100.0, value=raster.SET):
    return each_slice(voxels, lambda a: raster.keep_shares(Raster(a[None]), low, high, value).data[0], grid)


def hysteresis(voxels, grid, low, high, mode=0, axes=(1, 0, 0), value=raster.SET):
    return each_volume(voxels, lambda r: raster.hysteresis(r, low, high, mode, axes, value), grid)


def erode(voxels, grid, n, height=None):
    if _many(grid, height):
        return slabs.erode(voxels, grid, n, height)
    return each_volume(voxels, lambda r: raster.erode(r, n), grid)


def dilate(voxels, grid, n, mirror=(0, 0, 0), height=None):
    if _many(grid, height):
        return slabs.dilate(voxels, grid, n, mirror, height)
    return each_volume(voxels, lambda r: raster.dilate(r, n, mirror), grid)


def close(voxels, grid, n, mirror=(0, 0, 0), height=None):
    if _many(grid, height):
        return slabs.close(voxels, grid, n, mirror, height)
    return each_volume(voxels, lambda r: raster.close(r, n, mirror), grid)


def open_(voxels, grid, n, height=None):
    if _many(grid, height):
        return slabs.open_(voxels, grid, n, height)
    return each_volume(voxels, lambda r: raster.open_(r, n), grid)


def gauss_band(voxels, grid, low, high, sigma=2.0, support=3, height=None):
    if _many(grid, height) and not low <= 0 <= high:
        return slabs.gauss_band(voxels, grid, raster.whole_number(low, "low"), raster.whole_number(high, "high"), sigma, support, height)
    return each_volume(voxels, lambda r: raster.gauss_band(r, sigma, support, low, high), grid)


def render(voxels: DataFrame, grid: Grid, min_vertices: int = contour.MIN_VERTICES) -> DataFrame:
    """The rendered contours of each slice."""
    return each_slice(voxels, lambda a: np.where(contour.render_slice(a != 0, min_vertices), raster.SET, 0), grid)


def chains(voxels: DataFrame, grid: Grid, min_vertices: int = contour.MIN_VERTICES) -> DataFrame:
    """``vol_id, z, contour, kind, i, y, x``: the contours' vertices in their stored order."""

    def run(key, table):
        z = key[1].as_py()
        r = raster_of(*(table.column(a) for a in AXES), table.column("v"), Grid((1, *grid.shape[1:]), (z, *grid.origin[1:])))
        found = contour.outlines(r.on[0], min_vertices)[0] if r.on.any() else []
        rows = [(k, kind, i, y + grid.origin[1], x + grid.origin[2]) for k, (kind, chain, _) in enumerate(found) for i, (x, y) in enumerate(chain)]
        columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(5)]
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        names = ("contour", "kind", "i", "y", "x")
        return pa.table({"vol_id": pa.array([key[0].as_py()] * len(rows), pa.string()), "z": pa.array([z] * len(rows), pa.int32()), **{n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)}})

    rows = crop(voxels, grid).select(*KEYS, F.col("v").cast("int").alias("v"))
    return rows.groupBy("vol_id", "z").applyInArrow(run, "vol_id string, z int, contour int, kind string, i int, y int, x int")


def nearest_contact(voxels: DataFrame, grid: Grid) -> DataFrame:
    """``vol_id, z, y, x, vz, vy, vx``: the contact offset of each set voxel; an object that fills the grid has none."""

    def run(key, table):
        r = raster_of(*(table.column(a) for a in AXES), table.column("v"), grid)
        on = r.on if not r.on.all() else np.zeros_like(r.on)
        field, at = sphere.nearest_contact(on), np.nonzero(on)
        return pa.table({"vol_id": pa.array([key[0].as_py()] * len(at[0]), pa.string()), **{a: pa.array((p + o).astype(np.int32)) for a, p, o in zip(AXES, at, r.origin, strict=True)}, **{f"v{a}": pa.array(f[at].astype(np.int32)) for a, f in zip(AXES, field, strict=True)}})

    rows = crop(voxels, grid).select(*KEYS, F.col("v").cast("int").alias("v"))
    return rows.groupBy("vol_id").applyInArrow(run, "vol_id string, z int, y int, x int, vz int, vy int, vx int")


def sphere_map(voxels: DataFrame, region: DataFrame, grid: Grid, kind: str = "thickness", **how) -> DataFrame:
    """Diameters in voxels: ``thickness``, ``spacing`` or ``number`` inside the region.

    Where nothing bounds the spheres (the object, or what it leaves, fills the grid) a volume's map is empty.
    """
    draw = {"thickness": sphere.thickness, "spacing": sphere.spacing, "number": sphere.number}[kind]

    def run(a: Raster, b: Raster) -> Raster:
        try:
            return Raster(draw(a.on, b.on, **how)[0], a.origin)
        except sphere.NoBackground:
            return Raster(np.zeros(a.shape, np.int16), a.origin)

    return each_volume_with(voxels, region, run, grid)


def frequency_threshold(voxels: DataFrame, grid: Grid, **how) -> DataFrame:
    return each_volume(voxels, lambda r: r.with_on(frequency.frequency_threshold(r.data, grid.el, **how)), grid)
