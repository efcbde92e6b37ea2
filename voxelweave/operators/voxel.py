"""Relational volume operators: pointwise, mask arithmetic, neighbourhoods by offset joins.

Everything here is DataFrame functions over voxel tables; the physical strategy is
Catalyst's.  Neighbourhoods are equi-joins with a small table of offsets, never range joins.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import AXES, KEYS, Grid, crop, dense, each_volume, lattice
from .raster import SET, gauss_taps, reach, whole_number
from .raster import dilate as raster_dilate
from .raster import erode as raster_erode

# ---- pointwise


def native_threshold(mg: Column, slope: float, intercept: float, scaling: float = 8192.0) -> Column:
    """Density in mg to native units, to the nearest whole number, halves to even."""
    return F.rint((mg.cast("double") - F.lit(float(intercept))) / F.lit(float(slope)) * F.lit(float(scaling))).cast("int")


def hounsfield(native: Column, scaling: float, water: float) -> Column:
    hu = F.lit(-1000.0) + native.cast("double") / F.lit(float(scaling)) * F.lit(1000.0 / float(water))
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), hu.cast("long"))).cast("int")


def map_units(voxels: DataFrame, voxel_mm: float | None = None) -> DataFrame:
    """A map's values in voxels as short integers, or with a voxel size in mm in single precision."""
    value = F.col("v").cast("short") if voxel_mm is None else (F.col("v").cast("float") * F.lit(voxel_mm).cast("float")).cast("float")
    return voxels.select(*KEYS, value.alias("v"))


def permille_to_short(permille: Column) -> Column:
    return (permille.cast("double") / F.lit(1000.0) * F.lit(32767.0)).cast("int")


def normalised_short(value: Column, norm: float = 200_000.0) -> Column:
    """Single precision, clipped, cut to a whole number."""
    scaled = value.cast("float") * (F.lit(32767.0).cast("float") / F.lit(float(norm)).cast("float")).cast("float")
    return F.greatest(F.lit(-32767.0).cast("float"), F.least(F.lit(32767.0).cast("float"), scaled)).cast("int")


def surface_component(u: Column) -> Column:
    return F.signum(u.cast("double")) * F.greatest(F.abs(u.cast("double")) - 0.5, F.lit(0.0))


def surface_distance(z: Column, y: Column, x: Column) -> Column:
    """Half the root of the exact whole number of four times the square."""
    odd = lambda u: F.when(u != 0, (2 * F.abs(u.cast("long")) - 1) * (2 * F.abs(u.cast("long")) - 1)).otherwise(F.lit(0).cast("long"))
    return F.sqrt((odd(z) + odd(y) + odd(x)).cast("double")) * F.lit(0.5)


def band(voxels: DataFrame, low: float | Column, high: float | Column, value: int = SET) -> DataFrame:
    """Voxels with a value within both bounds, which belong to it."""
    return voxels.where(F.col("v").between(low, high)).select(*KEYS, F.lit(value).alias("v"))


# ---- mask arithmetic


def set_value(voxels: DataFrame, on: int, off: int = 0, grid: Grid | None = None, volumes: DataFrame | None = None) -> DataFrame:
    """``on`` for what is set (a negative value is), ``off`` elsewhere; ``off`` needs the grid.  Volumes without a row are those of ``volumes``."""
    if off == 0:
        return voxels.where("v <> 0").select(*KEYS, F.lit(on).alias("v")).where("v <> 0")
    if grid is None:
        raise ValueError("a value for the background needs the grid")
    return dense(voxels, grid, volumes=volumes).select(*KEYS, F.when(F.col("v") != 0, on).otherwise(off).alias("v")).where("v <> 0")


def saturated(a: DataFrame, b: DataFrame, sign: int) -> DataFrame:
    """``a + sign * b`` by position, held within -127 .. 127; zero rows go."""
    both = a.select(*KEYS, F.col("v").alias("p")).join(b.select(*KEYS, F.col("v").alias("q")), list(KEYS), "full")
    total = F.coalesce("p", F.lit(0)) + sign * F.coalesce("q", F.lit(0))
    return both.select(*KEYS, F.greatest(F.lit(-SET), F.least(F.lit(SET), total)).cast("int").alias("v")).where("v <> 0")


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return saturated(a, b, 1)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return saturated(a, b, -1)


def mask_by(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    return voxels.join(mask.where("v <> 0").select(*KEYS), list(KEYS), "left_semi")


def without(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    return voxels.join(mask.where("v <> 0").select(*KEYS), list(KEYS), "left_anti")


def _offsets(voxels: DataFrame, offsets) -> DataFrame:
    """Every voxel at every offset: a constant number of rows for each."""
    table = F.array(*[F.struct(*[F.lit(int(d)).alias(f"d{a}") for a, d in zip(AXES, o, strict=True)]) for o in offsets])
    return voxels.withColumn("o", F.explode(table)).select("vol_id", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES], *[c for c in voxels.columns if c not in KEYS])


def peel(voxels: DataFrame, times: int) -> DataFrame:
    """Slice-wise erosion by the four neighbours, ``times`` times: all of a diamond must be set."""
    on = voxels.where("v <> 0")
    if times <= 0:
        return on
    offsets = [(0, dy, dx) for dy in range(-times, times + 1) for dx in range(abs(dy) - times, times - abs(dy) + 1)]
    whole = _offsets(on.select(*KEYS), offsets).groupBy(*KEYS).count().where(F.col("count") == len(offsets))
    return on.join(whole.select(*KEYS), list(KEYS), "left_semi")


def mask_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``vol_id, added, removed``."""
    both = before.where("v <> 0").select(*KEYS, F.lit(1).alias("p")).join(after.where("v <> 0").select(*KEYS, F.lit(1).alias("q")), list(KEYS), "full")
    return both.groupBy("vol_id").agg(F.count_if(F.col("p").isNull()).alias("added"), F.count_if(F.col("q").isNull()).alias("removed"))


def labels_from_masks(cort: DataFrame, trab: DataFrame) -> DataFrame:
    """1 for the first mask, 2 for the second; a voxel of both is refused."""
    both = cort.where("v <> 0").select(*KEYS, F.lit(1).alias("p")).join(trab.where("v <> 0").select(*KEYS, F.lit(2).alias("q")), list(KEYS), "full")
    clash = F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), F.raise_error(F.lit("the masks overlap")).cast("int"))
    return both.select(*KEYS, F.coalesce(clash, F.col("p"), F.col("q")).alias("v"))


def overlay(first: DataFrame, second: DataFrame) -> DataFrame:
    """Labels of both; where both are set the second stays."""
    both = first.select(*KEYS, F.col("v").alias("p")).join(second.select(*KEYS, F.col("v").alias("q")), list(KEYS), "full")
    return both.select(*KEYS, F.coalesce("q", "p").alias("v"))


def outside(voxels: DataFrame, region: DataFrame) -> DataFrame:
    """``vol_id, outside``: set voxels that the region does not hold."""
    return without(voxels.where("v <> 0"), region).groupBy("vol_id").agg(F.count("*").alias("outside"))


# ---- smoothing and morphology


def gauss(voxels: DataFrame, grid: Grid, sigma: float = 2.0, support: int = 3, axes=("x", "y", "z")) -> DataFrame:
    """Separable smoothing in single precision; zeros outside, cut to whole numbers each time."""
    taps = [F.lit(float(t)).cast("float") for t in gauss_taps(sigma, support)]
    zero = F.lit(0.0).cast("float")
    out = dense(voxels, grid).withColumn("v", F.col("v").cast("float"))
    for axis in axes:
        w = Window.partitionBy("vol_id", *[a for a in AXES if a != axis]).orderBy(axis)
        total = F.col("v") * taps[0]
        for k in range(1, support + 1):
            pair = F.coalesce(F.lag("v", k).over(w), zero) + F.coalesce(F.lead("v", k).over(w), zero)
            total = (total + (pair * taps[k]).cast("float")).cast("float")
        out = out.select(*KEYS, total.cast("int").cast("float").alias("v"))
    return out


def gauss_band(voxels: DataFrame, grid: Grid, low: int, high: int, sigma: float = 2.0, support: int = 3) -> DataFrame:
    """Smoothed values within the bounds, on the box that the support leaves."""
    low, high = whole_number(low, "low"), whole_number(high, "high")
    if support < 1 or min(grid.shape) <= 2 * support:
        raise ValueError(f"support {support} does not fit into {grid.shape}")
    inner = Grid(tuple(n - 2 * support for n in grid.shape), tuple(o + support for o in grid.origin), grid.el)
    return band(crop(gauss(voxels, grid, sigma, support), inner), low, high)


def chamfer_offsets(n: int) -> list[tuple[int, int, int]]:
    """Offsets with a 3-4-5 chamfer length below that of an erosion by ``n``."""
    out = []
    for o in product(range(-n, n + 1), repeat=3):
        a, b, c = sorted(map(abs, o), reverse=True)
        if 5 * c + 4 * (b - c) + 3 * (a - b) < reach(n):
            out.append(o)
    return out


def background(voxels: DataFrame, grid: Grid, volumes: DataFrame | None = None) -> DataFrame:
    """The grid's voxels that are not set.  A volume without a row in ``voxels`` is empty, so it counts only if it is in ``volumes``."""
    return lattice(voxels if volumes is None else volumes, grid).join(voxels.where("v <> 0").select(*KEYS), list(KEYS), "left_anti")


#: Up to this many steps morphology is a join with a table of offsets (155 rows a voxel at 3, 13,423
#: at 15); beyond, each volume's array is swept in a task of its own.
MOST_JOINED = 3


def erode(voxels: DataFrame, grid: Grid, n: int) -> DataFrame:
    """Set voxels that no background of the grid is near; what lies outside is no background."""
    if n > MOST_JOINED:
        return each_volume(voxels, lambda r: raster_erode(r, n), grid).select(*KEYS, "v")
    on = crop(voxels, grid).where("v <> 0")
    near = _offsets(background(on, grid), chamfer_offsets(n)).distinct()
    return on.join(near, list(KEYS), "left_anti").select(*KEYS, F.lit(SET).alias("v"))


def dilate(voxels: DataFrame, n: int) -> DataFrame:
    """All voxels near a set one; the grid grows by ``n + 1``."""
    if n > MOST_JOINED:
        return each_volume(voxels.where("v <> 0"), lambda r: raster_dilate(r, n)).select(*KEYS, "v")
    return _offsets(voxels.where("v <> 0").select(*KEYS), chamfer_offsets(n)).distinct().select(*KEYS, F.lit(SET).alias("v"))


def mirrored(voxels: DataFrame, grid: Grid, n: int, axes=AXES) -> DataFrame:
    """The set voxels and their images in the ``n`` voxels beyond the grid, the edge included."""
    out = crop(voxels, grid).where("v <> 0").select(*KEYS)
    for axis, low, high in zip(AXES, grid.origin, grid.end, strict=True):
        if axis in axes:
            a = F.col(axis)
            images = F.array(a, F.when(a < low + n, F.lit(2 * low - 1) - a), F.when(a >= high - n, F.lit(2 * high - 1) - a))
            out = out.withColumn(axis, F.explode(F.filter(images, lambda i: i.isNotNull())))
    return out.withColumn("v", F.lit(SET))


def close(voxels: DataFrame, grid: Grid, n: int, mirror=()) -> DataFrame:
    wide = grid.widened(n + 2)
    source = mirrored(voxels, grid, n + 2, mirror) if mirror else crop(voxels, grid)
    return crop(erode(crop(dilate(source, n), wide), wide, n), grid)


def open_(voxels: DataFrame, grid: Grid, n: int) -> DataFrame:
    """Erosion and dilation of the volume mirrored on all sides, then cut to the grid."""
    wide = grid.widened(n + 2)
    return crop(dilate(erode(mirrored(voxels, grid, n + 2), wide, n), n), grid)


def chamfer(voxels: DataFrame, grid: Grid, most: int) -> DataFrame:
    """Chamfer distance of set voxels to the background, held at that of an erosion by ``most``."""
    lengths = []
    for o in chamfer_offsets(most):
        a, b, c = sorted(map(abs, o), reverse=True)
        lengths.append((*o, 5 * c + 4 * (b - c) + 3 * (a - b)))
    table = F.array(*[F.struct(*[F.lit(int(d)).alias(k) for k, d in zip(("dz", "dy", "dx", "d"), o, strict=True)]) for o in lengths])
    near = background(voxels, grid).withColumn("o", F.explode(table)).select("vol_id", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES], F.col("o.d").alias("d"))
    least = near.groupBy(*KEYS).agg(F.min("d").alias("d"))
    return crop(voxels, grid).where("v <> 0").join(least, list(KEYS), "left").select(*KEYS, F.coalesce("d", F.lit(reach(most))).alias("v"))


# ---- components and runs, where a declarative form exists


def hysteresis_z(voxels: DataFrame, grid: Grid, low: int, high: int, mode: int = 0) -> DataFrame:
    """Runs of weak voxels along z that hold a seed: gaps and islands, no labelling."""
    if mode not in (0, 1) or high < low:
        raise ValueError(f"mode is 0 or 1 and low is not above high: {mode}, {low}, {high}")
    v = F.col("v")
    weak, seed = (v <= high, v <= low) if mode == 0 else (v >= low, v >= high)
    column = Window.partitionBy("vol_id", "y", "x").orderBy("z")
    runs = dense(voxels, grid).where(weak).withColumn("run", F.col("z") - F.row_number().over(column))
    whole = Window.partitionBy("vol_id", "y", "x", "run")
    return runs.withColumn("hit", F.max(seed.cast("int")).over(whole)).where("hit = 1").select(*KEYS, F.lit(SET).alias("v"))


def size_filter(labels: DataFrame, least: int = 1, most: int = 0) -> DataFrame:
    """``vol_id, z, y, x, label``: components of ``least`` to ``most`` voxels (0: no limit)."""
    sizes = labels.groupBy("vol_id", "label").agg(F.count("*").alias("n"))
    kept = sizes.where((F.col("n") >= least) & ((F.col("n") <= most) if most else F.lit(True)))
    return labels.join(kept.select("vol_id", "label"), ["vol_id", "label"], "left_semi")


def share_filter(labels: DataFrame, low: float = 50.0, high: float = 100.0) -> DataFrame:
    """Slice components by their share of the slice, in percent, both bounds included."""
    parts = labels.groupBy("vol_id", "z", "label").agg(F.count("*").alias("n"))
    share = F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("vol_id", "z"))
    return labels.join(parts.withColumn("s", share).where(F.col("s").between(low, high)).select("vol_id", "z", "label"), ["vol_id", "z", "label"], "left_semi")


# ---- spheres, given a field of offsets ``vz, vy, vx``

STEPS26 = [o for o in product((-1, 0, 1), repeat=3) if any(o)]


def ridge(field: DataFrame, epsilon: float = 0.9) -> DataFrame:
    """Voxels whose sphere no neighbour's sphere contains to within ``epsilon``."""
    own = field.withColumn("s", surface_distance(F.col("vz"), F.col("vy"), F.col("vx"))).where("s > 0")
    table = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, o, strict=True)], F.sqrt(F.lit(float(sum(d * d for d in o)))).alias("w")) for o in STEPS26])
    other = own.withColumn("o", F.explode(table)).select("vol_id", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES], F.col("s").alias("t"), F.col("o.w").alias("w"))
    held = own.join(other, list(KEYS)).where(F.col("w") + F.col("s") - F.col("t") <= F.lit(epsilon) + F.lit(1e-9)).select(*KEYS).distinct()
    return own.join(held, list(KEYS), "left_anti")


def diameters(field: DataFrame, version: int = 1) -> DataFrame:
    """Whole diameters of the field's voxels, for versions 1 to 3 of the rule."""
    p = {a: surface_component(F.col(f"v{a}")) for a in AXES}
    own = field.select(*KEYS, *[p[a].alias(f"p{a}") for a in AXES])
    length = lambda name: F.sqrt(sum((F.col(f"{name}{a}") * F.col(f"{name}{a}") for a in AXES), F.lit(0.0)))
    own = own.withColumn("s", length("p")).withColumn("plain", F.floor(2 * F.col("s") + F.lit(0.5) + F.lit(1e-9)).cast("int"))
    if version == 1:
        return own.select(*KEYS, F.col("plain").alias("v"))
    if version not in (2, 3):
        raise ValueError(f"version is 1, 2 or 3, not {version}")
    unit = F.when(F.col("s") == 0, F.lit(1.0)).otherwise(F.col("s"))
    own = own.withColumns({f"t{a}": -F.rint(F.col(f"p{a}") / unit) for a in AXES})
    across = field.select(F.col("vol_id").alias("w"), *[F.col(a).alias(f"y{a}") for a in AXES], *[p[a].alias(f"q{a}") for a in AXES], F.lit(1).alias("object"))
    there = [F.col("vol_id") == F.col("w"), *[F.col(a) + F.col(f"t{a}").cast("int") == F.col(f"y{a}") for a in AXES]]
    both = own.join(across, there, "left")
    both = both.withColumns({f"q{a}": F.coalesce(f"q{a}", F.lit(0.0)) for a in AXES}).withColumn("object", F.coalesce("object", F.lit(0)))
    far = lambda a: F.col(f"t{a}") + F.col(f"q{a}")
    full = F.floor(F.sqrt(sum(((F.col(f"p{a}") - far(a)) * (F.col(f"p{a}") - far(a)) for a in AXES), F.lit(0.0))) + F.lit(0.5) + F.lit(1e-9)).cast("int")
    if version == 2:
        size = length("q")
        turn = -sum((F.col(f"q{a}") * F.col(f"p{a}") for a in AXES), F.lit(0.0)) / (F.greatest(size, F.lit(1e-12)) * F.greatest(F.col("s"), F.lit(1e-12)))
        good = (F.col("object") == 1) & (size > 0) & (turn >= F.lit(0.5 - 1e-9))
    else:
        middle = F.sqrt(sum(((F.col(f"p{a}") + far(a)) / 2 * (F.col(f"p{a}") + far(a)) / 2 for a in AXES), F.lit(0.0)))
        good = middle < F.lit(1.0 - 1e-9)
    return both.select(*KEYS, F.when(good, full).otherwise(F.col("plain")).alias("v"))


def cover(centres: DataFrame, grid: Grid, most: int, epsilon: float = 0.5) -> DataFrame:
    """The largest sphere that covers each voxel; ``most`` is the largest diameter there is."""
    # A ball is runs along x: one row for each, so the rows of a centre grow with the square of its
    # diameter, and nothing is gathered or broadcast.
    reach = F.floor((F.col("v") + F.lit(2 * epsilon)) / 2 + F.lit(1e-3)).cast("int")
    span = lambda r: F.sequence(-r, r)
    rows = centres.where(F.col("v").between(1, most)).withColumn("__r", reach).withColumn("__z", F.explode(span(F.col("__r")))).withColumn("__y", F.explode(span(F.col("__r"))))
    wide = F.col("v") + F.lit(2 * epsilon)
    left = (wide * wide + F.lit(1e-6)) / 4 - F.col("__z") * F.col("__z") - F.col("__y") * F.col("__y")
    rows = rows.withColumn("__left", left).where("__left >= 0").withColumn("__x", F.floor(F.sqrt("__left")).cast("int"))
    rows = rows.select("vol_id", (F.col("z") + F.col("__z")).alias("z"), (F.col("y") + F.col("__y")).alias("y"), (F.col("x") - F.col("__x")).alias("a"), (F.col("x") + F.col("__x")).alias("b"), "v")
    for axis in ("z", "y"):
        k = AXES.index(axis)
        rows = rows.where(F.col(axis).between(grid.origin[k], grid.end[k] - 1))
    ends = F.greatest(F.col("a"), F.lit(grid.origin[2])), F.least(F.col("b"), F.lit(grid.end[2] - 1))
    # Equal runs of many centres meet before their voxels are made.
    rows = rows.groupBy("vol_id", "z", "y", "a", "b").agg(F.max("v").alias("v")).withColumns({"a": ends[0], "b": ends[1]}).where("a <= b")
    return rows.select("vol_id", "z", "y", F.explode(F.sequence("a", "b")).alias("x"), "v").groupBy(*KEYS).agg(F.max("v").alias("v"))


# ---- chains


def chain_edges(chains: DataFrame) -> DataFrame:
    """``vol_id, z, contour, i, x0, y0, x1, y1`` from ``vol_id, z, contour, i, x, y``."""
    w = Window.partitionBy("vol_id", "z", "contour").orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return chains.select("vol_id", "z", "contour", "i", F.col("x").alias("x0"), F.col("y").alias("y0"), after("x").alias("x1"), after("y").alias("y1"))


def polygon_fill(chains: DataFrame, width: int) -> DataFrame:
    """``vol_id, z, contour, y, x``: pixels with an odd number of crossings strictly to their left.

    Pixels of the chain are left out; columns from 0 to ``width - 1``.
    """
    edges = chain_edges(chains).where("y0 <> y1")
    low = F.when(F.col("y0") < F.col("y1"), F.col("x0")).otherwise(F.col("x1"))
    cross = edges.select("vol_id", "z", "contour", F.least("y0", "y1").alias("y"), low.alias("cx"))
    marks = cross.groupBy("vol_id", "z", "contour", "y", "cx").agg((F.count("*") % 2).alias("odd")).where("odd = 1")
    w = Window.partitionBy("vol_id", "z", "contour", "y").orderBy("cx")
    spans = marks.withColumn("k", F.row_number().over(w)).withColumn("until", F.coalesce(F.lead("cx").over(w), F.lit(width - 1))).where("k % 2 = 1 AND until > cx")
    inside = spans.select("vol_id", "z", "contour", "y", F.explode(F.sequence(F.col("cx") + 1, F.col("until"))).alias("x"))
    return inside.join(chains.select("vol_id", "z", "contour", "y", "x"), ["vol_id", "z", "contour", "y", "x"], "left_anti")


def without_spikes(voxels: DataFrame) -> DataFrame:
    """Drop pixels without a neighbour left or right, unless both above and below are set."""
    on = voxels.where("v <> 0").select(*KEYS)
    near = lambda name, dy, dx: on.select("vol_id", "z", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.lit(1).alias(name))
    side = near("side", 0, 1).unionByName(near("side", 0, -1)).groupBy(*KEYS).agg(F.lit(1).alias("side"))
    neck = near("n", 1, 0).unionByName(near("n", -1, 0)).groupBy(*KEYS).agg(F.sum("n").alias("n"))
    return on.join(side, list(KEYS), "left").join(neck, list(KEYS), "left").where("side = 1 OR n = 2").select(*KEYS, F.lit(SET).alias("v"))
