"""Operators on slabs: a volume is dealt out along z, so that it is many tasks and none holds all of it.

Planes are shuffled as binary rows.  ``by_slabs`` gives each slab as many planes of its
neighbours as an operator reaches and cuts its result to the slab's own planes (erosion, dilation,
closing, opening, smoothing).  Components are labelled slab by slab; the pairs of labels that
meet at the seams are contracted to their least, which is the first voxel of the whole
component in raster order, so labels do not depend on how the volume was cut.  Sizes and ranks are
decided on the table of components, and only then do the planes take the new values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import raster as R
from .grid import KEYS, VOXELS, Grid, crop, rows_of
from .raster import Raster

#: Voxels of a slab, unless a height is given.
SLAB_VOXELS = 1 << 22
#: Seam pairs up to which each volume's are joined in one task; beyond, in rounds of joins over all of them.
PAIRS_TOGETHER = 1_000_000

_PLANES = "vol_id string, z int, data binary"


def slab_height(grid: Grid, height: int | None = None) -> int:
    return height or max(1, SLAB_VOXELS // (grid.shape[1] * grid.shape[2]))


def planes(voxels: DataFrame, grid: Grid) -> DataFrame:
    """``vol_id, z, data``: the planes of the grid that hold something, as 32-bit integers."""
    (_, ny, nx), (_, oy, ox) = grid.shape, grid.origin

    def run(key, table):
        data = np.zeros((ny, nx), np.int32)
        data[np.asarray(table.column("y")) - oy, np.asarray(table.column("x")) - ox] = np.asarray(table.column("v"))
        return pa.table({"vol_id": [key[0].as_py()], "z": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([data.tobytes()], pa.binary())})

    return crop(voxels, grid).where("v <> 0").select(*KEYS, F.col("v").cast("int").alias("v")).groupBy("vol_id", "z").applyInArrow(run, _PLANES)


def _stacked(table: pa.Table, grid: Grid, low: int, high: int) -> np.ndarray:
    """The planes ``low .. high - 1`` (from the grid's first) of a task's rows; those without a row are zero."""
    out = np.zeros((high - low, *grid.shape[1:]), np.int32)
    for z, data in zip(table.column("z").to_pylist(), table.column("data").to_pylist(), strict=True):
        out[z - grid.origin[0] - low] = np.frombuffer(data, np.int32).reshape(grid.shape[1:])
    return out


def by_slabs(voxels: DataFrame, grid: Grid, kernel: Callable[[Raster], Raster], halo: int, height: int | None = None) -> DataFrame:
    """A kernel that gives nothing for an empty neighbourhood and reaches at most ``halo`` planes, slab by slab.

    Two shuffles: of voxels to planes, and of planes to slabs, each plane to the slabs it is within
    ``halo`` of.  A task holds ``height + 2 * halo`` planes, whatever the volume's height.  Where a slab ends
    inside of the volume the kernel sees the end of its array, but no farther than ``halo`` from it; the
    grid's own ends are the array's.  What the kernel adds beyond the grid comes from the slabs at the ends.
    """
    h, (nz, *_), oz = slab_height(grid, height), grid.shape, grid.origin[0]
    last = -(-nz // h) - 1
    at = F.col("z") - oz
    to_slab = lambda e: F.greatest(F.lit(0), F.least(F.lit(last), F.floor(e / h).cast("int")))

    def run(key, table):
        vol_id, k = key[0].as_py(), key[1].as_py()
        low, high = max(0, k * h - halo), min(nz, (k + 1) * h + halo)
        out = kernel(Raster(_stacked(table, grid, low, high), (oz + low, *grid.origin[1:])))
        first = 0 if k == 0 else max(0, oz + k * h - out.origin[0])
        end = out.data.shape[0] if k == last else max(0, oz + (k + 1) * h - out.origin[0])
        return rows_of(vol_id, Raster(out.data[first:end], (out.origin[0] + first, *out.origin[1:])))

    dealt = planes(voxels, grid).withColumn("slab", F.explode(F.sequence(to_slab(at - halo), to_slab(at + halo))))
    return dealt.groupBy("vol_id", "slab").applyInArrow(run, VOXELS)


def erode(voxels: DataFrame, grid: Grid, n: int, height: int | None = None) -> DataFrame:
    return by_slabs(voxels, grid, lambda r: R.erode(r, n), n + 2, height)


def dilate(voxels: DataFrame, grid: Grid, n: int, mirror=(0, 0, 0), height: int | None = None) -> DataFrame:
    return by_slabs(voxels, grid, lambda r: R.dilate(r, n, mirror), n + 2, height)


def close(voxels: DataFrame, grid: Grid, n: int, mirror=(0, 0, 0), height: int | None = None) -> DataFrame:
    return by_slabs(voxels, grid, lambda r: R.close(r, n, mirror), 2 * n + 4, height)


def open_(voxels: DataFrame, grid: Grid, n: int, height: int | None = None) -> DataFrame:
    return by_slabs(voxels, grid, lambda r: R.open_(r, n), 2 * n + 4, height)


def gauss(voxels: DataFrame, grid: Grid, sigma: float = 2.0, support: int = 3, height: int | None = None) -> DataFrame:
    return by_slabs(voxels, grid, lambda r: Raster(R.gauss(r.data, sigma, support).astype(np.int32), r.origin), support, height)


def gauss_band(voxels: DataFrame, grid: Grid, low: int, high: int, sigma: float = 2.0, support: int = 3, height: int | None = None) -> DataFrame:
    if low <= 0 <= high:
        raise ValueError("a band that holds zero is set where nothing is, so planes without a voxel are needed")
    if support < 1 or min(grid.shape) <= 2 * support:
        raise ValueError(f"support {support} does not fit into a volume of {grid.shape}")
    return by_slabs(voxels, grid, lambda r: R.gauss_band(r, sigma, support, low, high), 2 * support + 1, height)


# ---- components


@dataclass(frozen=True)
class Components:
    """``planes(vol_id, slab, z, data)`` of numbers within a slab, and what each number is:
    ``table(vol_id, slab, no, label, n, border)`` with the component's label, size, and whether it touches a face."""

    planes: DataFrame
    table: DataFrame
    grid: Grid

    def sizes(self) -> DataFrame:
        """``vol_id, label, n, border`` of every component."""
        return self.table.groupBy("vol_id", "label").agg(F.first("n").alias("n"), F.first("border").alias("border"))

    def valued(self, values: DataFrame) -> DataFrame:
        """The voxels of the labels in ``values(vol_id, label, v)``, with their ``v``."""
        grid = self.grid
        numbers = self.table.join(values, ["vol_id", "label"]).select("vol_id", "slab", "no", F.col("v").cast("int").alias("v"))

        def run(key, own, new):
            vol_id = key[0].as_py()
            no, v = (np.asarray(new.column(c)) for c in ("no", "v"))
            found = [rows_of(vol_id, Raster(np.zeros((1, 1, 1), np.int32), (0, 0, 0)))]
            if own.num_rows and len(no):
                table = np.zeros(int(max(no)) + 1, np.int32)
                table[no] = v
                for z, data in zip(own.column("z").to_pylist(), own.column("data").to_pylist(), strict=True):
                    plane = np.frombuffer(data, np.int32).reshape(1, *grid.shape[1:])
                    found.append(rows_of(vol_id, Raster(np.where(plane < len(table), table[np.minimum(plane, len(table) - 1)], 0), (z, *grid.origin[1:]))))
            return pa.concat_tables(found)

        return self.planes.groupBy("vol_id", "slab").cogroup(numbers.groupBy("vol_id", "slab")).applyInArrow(run, VOXELS)


def contracted(pairs: DataFrame, together: int | None = None) -> DataFrame:
    """``vol_id, id, root`` of every id in ``pairs(vol_id, a, b)``: the least id of its volume that it leads to.

    Few pairs are joined by one task a volume.  Otherwise rounds of large and small stars over all of them (every
    id gives its larger, then its smaller neighbours to the least of all), each a table on disk, until nothing changes.
    """
    from ..sources.shared import dropped, written

    together = PAIRS_TOGETHER if together is None else together
    links = written(pairs.where("a <> b").select("vol_id", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "seams")
    if links.limit(together + 1).count() <= together:

        def run(key, table):
            a, b = (np.asarray(table.column(c)) for c in ("a", "b"))
            ids, at = np.unique(np.r_[a, b], return_inverse=True)
            root = ids[R.join_up(len(ids), at[: len(a)], at[len(a) :])]
            return pa.table({"vol_id": pa.array([key[0].as_py()] * len(ids), pa.string()), "id": ids, "root": root})

        return links.groupBy("vol_id").applyInArrow(run, "vol_id string, id long, root long")
    before = None
    while True:
        both = links.unionByName(links.select("vol_id", F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("vol_id", "a").agg(F.least("a", F.min("b")).alias("m"))
        large = written(both.where("b > a").join(least, ["vol_id", "a"]).select("vol_id", F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "seams")
        least = large.groupBy("vol_id", "a").agg(F.min("b").alias("m"))
        small = large.join(least, ["vol_id", "a"]).where("b <> m").select("vol_id", F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(small.unionByName(least.select("vol_id", "a", F.col("m").alias("b"))).where("a <> b").distinct(), "seams")
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("vol_id", "a", "b").cast("decimal(38,0)"))).first())
        dropped(large)
        dropped(links)
        links = after
        if mark == before:
            break
        before = mark
    roots = links.select("vol_id", F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionByName(links.select("vol_id", F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def components(voxels: DataFrame, grid: Grid, height: int | None = None) -> Components:
    """The 6-connected components of each volume, labelled from 1 on in raster order, whatever the slabs' height."""
    from ..sources.shared import written

    h, (nz, ny, nx), oz = slab_height(grid, height), grid.shape, grid.origin[0]
    last = -(-nz // h) - 1

    def run(key, table):
        vol_id, k = key[0].as_py(), key[1].as_py()
        low, high = k * h, min(nz, (k + 1) * h)
        labels, sizes = R.label(_stacked(table, grid, low, high) != 0, R.SIX)
        least = np.unique(labels, return_index=True)[1]  # labels are in raster order, 0 may be missing
        first = np.full(len(sizes), -1, np.int64)
        first[np.unique(labels)] = least + np.int64(low) * ny * nx
        border = R.on_faces(labels, len(sizes), (1, 2))
        for edge, here in ((0, k == 0), (-1, k == last)):
            if here:
                border[labels[edge].ravel()] = True
        held = np.flatnonzero((labels > 0).any(axis=(1, 2))).tolist()
        seam = [first[np.where(labels[i] > 0, labels[i], 0)] * (labels[i] > 0) + (labels[i] > 0) if (i == 0 and k > 0) or (i == high - low - 1 and k < last) else None for i in held]
        some = lambda values, kind: pa.array([values if i == held[0] else None for i in held], pa.list_(kind))
        return pa.table({
            "vol_id": pa.array([vol_id] * len(held), pa.string()), "slab": pa.array([k] * len(held), pa.int32()), "z": pa.array([oz + low + i for i in held], pa.int32()),
            "data": pa.array([labels[i].astype(np.int32).tobytes() for i in held], pa.binary()), "seam": pa.array([None if s is None else s.astype(np.int64).tobytes() for s in seam], pa.binary()),
            "first": some(first[1:].tolist(), pa.int64()), "n": some(sizes[1:].tolist(), pa.int64()), "border": some(border[1:].tolist(), pa.bool_()),
        })

    slab = F.floor((F.col("z") - oz) / h).cast("int")
    found = written(planes(voxels, grid).groupBy("vol_id", slab.alias("slab")).applyInArrow(run, "vol_id string, slab int, z int, data binary, seam binary, first array<long>, n array<long>, border array<boolean>"), "slabs")
    parts = found.where("first IS NOT NULL").select("vol_id", "slab", F.posexplode(F.arrays_zip("first", "n", "border")).alias("no", "c"))
    parts = parts.select("vol_id", "slab", (F.col("no") + 1).alias("no"), F.col("c.first").alias("first"), F.col("c.n").alias("n"), F.col("c.border").alias("border"))
    # Both planes of each seam meet; labels that are on either side of it are one component.
    upper = found.where(f"seam IS NOT NULL AND pmod(z - {oz}, {h}) = 0").select("vol_id", "z", F.col("seam").alias("above"))
    lower = found.where(f"seam IS NOT NULL AND pmod(z + 1 - {oz}, {h}) = 0").select("vol_id", (F.col("z") + 1).alias("z"), F.col("seam").alias("below"))

    def meet(batches):
        for batch in batches:
            for vol_id, above, below in zip(*(batch.column(c).to_pylist() for c in ("vol_id", "above", "below")), strict=True):
                a, b = (np.frombuffer(x, np.int64) for x in (above, below))
                both = (a > 0) & (b > 0)
                pair = np.unique(np.stack((a[both], b[both])), axis=1) - 1
                yield pa.RecordBatch.from_arrays([pa.array([vol_id] * pair.shape[1], pa.string()), pa.array(pair[0]), pa.array(pair[1])], ["vol_id", "a", "b"])

    pairs = upper.join(lower, ["vol_id", "z"]).mapInArrow(meet, "vol_id string, a long, b long")
    roots = contracted(pairs)
    parts = parts.join(roots.withColumnRenamed("id", "first"), ["vol_id", "first"], "left").withColumn("root", F.coalesce("root", "first"))
    whole = parts.groupBy("vol_id", "root").agg(F.sum("n").alias("n"), F.max("border").alias("border"))
    whole = whole.withColumn("label", F.row_number().over(Window.partitionBy("vol_id").orderBy("root")))
    table = written(parts.select("vol_id", "slab", "no", "root").join(whole, ["vol_id", "root"]).select("vol_id", "slab", "no", "label", "n", "border"), "components")
    return Components(found.select("vol_id", "slab", "z", "data"), table, grid)


def labels(voxels: DataFrame, grid: Grid, height: int | None = None) -> DataFrame:
    """``v`` is the label of the voxel's 6-connected component, in raster order from 1 on."""
    found = components(voxels, grid, height)
    return found.valued(found.sizes().select("vol_id", "label", F.col("label").alias("v")))


def keep_sizes(voxels: DataFrame, grid: Grid, least: int = 1, most: int = 0, value: int = R.SET, height: int | None = None) -> DataFrame:
    """Components of ``least`` voxels to ``most`` (0: no limit)."""
    found = components(voxels, grid, height)
    kept = found.sizes().where((F.col("n") >= least) & ((F.col("n") <= most) if most > 0 else F.lit(True)))
    return found.valued(kept.select("vol_id", "label", F.lit(value).alias("v")))


def keep_ranks(voxels: DataFrame, grid: Grid, first: int = 1, last: int = 1, join_border: bool = False, value: int = R.SET, height: int | None = None) -> DataFrame:
    """The components of the given ranks by size, decided on each volume's table of sizes; all that touch a face can count as one."""
    R.chosen_ranks(np.zeros(2, np.int64), first, last)  # refuses ranks that make no sense before anything runs
    found = components(voxels, grid, height)

    def run(key, table):
        label, n, border = (np.asarray(table.column(c)) for c in ("label", "n", "border"))
        order = np.argsort(label)
        kept = R.chosen_ranks(np.r_[0, n[order]], first, last, np.r_[False, border[order]] if join_border else None)[1:]
        own = label[order][kept]
        return pa.table({"vol_id": pa.array([key[0].as_py()] * len(own), pa.string()), "label": pa.array(own.astype(np.int32)), "v": pa.array(np.full(len(own), value, np.int32))})

    return found.valued(found.sizes().groupBy("vol_id").applyInArrow(run, "vol_id string, label int, v int"))
