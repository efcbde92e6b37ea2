"""Maps of scans from masks that are given, and their comparison with reference maps.

``scan_files`` finds the layers of each scan in a folder by their names.  ``measure_given`` draws
every map of a scan in a task of its own, on the grid of the mask that it is drawn from.
``joint_planes`` compares two sets of slices plane by plane: planes of equal ``z`` meet in a join as
they are, so no voxel becomes a row, and each plane gives the counts of the pairs of values
in it.  ``comparison`` sums these up.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sphere
from ..operators.contour import render
from ..operators.grid import Grid, packed, tasks, unpacked
from ..operators.raster import Raster
from ..sources import volumes
from ..sources.shared import written
from .morphometry import Maps, boxed, map_report
from .workflow import RESULT, SLICE, Evaluation, _reason, evaluate, find_masks, measure, stack

#: Masks that are read, and the maps that each is needed for.
NEEDS = {
    "SEG": ("TRAB_TH", "TRAB_SP", "TRAB_1N", "TRAB_TH_old"),
    "TRAB_MASK": ("TRAB_TH", "TRAB_SP", "TRAB_1N", "TRAB_TH_old"),
    "CORT_MASK": ("CORT_TH",),
    "TRAB_SEG": ("TRAB_TH_old",),
}
MAPS = ("TRAB_TH", "TRAB_SP", "TRAB_1N", "CORT_TH", "TRAB_TH_old")
_PREFIX = {"TRAB_TH": "Tb_Th", "TRAB_SP": "Tb_Sp", "TRAB_1N": "Tb_1N", "CORT_TH": "Ct_Th", "TRAB_TH_old": "Tb_Th_old"}
#: Slices with a mismatch that a report names.
NAMED_SLICES = 50


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """Slices of all layers of all scans under a folder: ``vol_id`` (the file's name before the layer) and ``layer``.

    A file is named after its scan and layer, ``<scan>_<layer>`` or ``<scan>_<layer>_decompressed``;
    files of other names are not opened.  The same layer twice (in two formats) is refused by ``measure_given``.
    """
    names = "|".join(sorted((*NEEDS, *MAPS), key=len, reverse=True))
    pattern = rf"^(.*)_({names})(_decompressed)?$"
    read = volumes.register(spark).read.format("volume").option("recursiveFileLookup", "true")
    found = read.load(folder).where(F.col("vol_id").rlike(pattern))
    return found.withColumns({"layer": F.regexp_extract("vol_id", pattern, 2), "vol_id": F.regexp_extract("vol_id", pattern, 1)})


def _map(name: str, layers: dict[str, tuple[Raster, tuple]], p: Maps, voxel_mm: float | None):
    """The map of one name, its metrics, and the voxel size; None without its masks."""
    if name == "CORT_TH":
        mask, el = layers["CORT_MASK"]
        cort, contour = mask.on, render(mask.on)
        values, _ = sphere.thickness(cort, contour, **p.how())
        mm = voxel_mm or el[2]
        n = int(contour.sum())
        metrics = map_report(values, int((cort & contour).sum()), mm, "Ct_Th") | {"Ct_V_voxels": n, "Ct_V_mm3": n * mm**3}
        return mask.origin, values, metrics, el
    if missing := {"SEG", "TRAB_MASK"} - layers.keys():
        raise ValueError(f"there is no {' and no '.join(sorted(missing))} of this name")
    if name == "TRAB_TH_old" and "TRAB_SEG" not in layers:
        return None
    (seg, el), (trab, _) = layers["SEG"], layers["TRAB_MASK"]
    region = Raster(np.where(render(trab.on), 1, 0).astype(np.int16), trab.origin).like(seg) != 0  # rendered on its own grid
    own = layers["TRAB_SEG"][0].like(seg) != 0 if name == "TRAB_TH_old" else seg.on
    draw = {"TRAB_SP": sphere.spacing, "TRAB_1N": sphere.number}.get(name, sphere.thickness)
    values, _ = draw(own, region, **p.how())
    mm = voxel_mm or el[2]
    target = ~own & region if draw is sphere.spacing else region if draw is sphere.number else own & region
    metrics = map_report(values, int(target.sum()), mm, _PREFIX[name])
    if name == "TRAB_1N":
        mean = metrics["Tb_1N_mm"]
        metrics["Tb_N_per_mm"] = 1 / mean if mean > 0 else 0.0
    if name == "TRAB_TH":
        bone, total = int((own & region).sum()), int(region.sum())
        metrics |= {"BV_voxels": bone, "TV_voxels": total, "BV_TV": bone / total if total else 0.0, "BV_mm3": bone * mm**3, "TV_mm3": total * mm**3}
    return seg.origin, values, metrics, el


def measure_given(layers: DataFrame, maps: Maps | None = None, which: tuple[str, ...] = MAPS, voxel_mm: float | None = None) -> DataFrame:
    """RESULT rows of scans whose masks are given as slices with ``vol_id`` and ``layer`` (SEG, TRAB_MASK and perhaps CORT_MASK, TRAB_SEG).

    The trabecular maps are drawn on the segmentation's grid, the cortical one on its mask's; what is
    outside a grid counts as object.  Contours are rendered on each mask's own grid.  A map
    has all planes of its grid; those that hold nothing have no data.  A scan without segmentation or
    trabecular mask has an ``error`` for each map of theirs, like any map that fails, and none
    of another scan's.  A task is one map of one scan.
    """
    p = maps or Maps()
    wanted = F.create_map(*[x for layer, names in NEEDS.items() for x in (F.lit(layer), F.array(*[F.lit(n) for n in names if n in which]).cast("array<string>"))])
    rows = layers.where(F.col("layer").isin(*NEEDS)).select("vol_id", "layer", *SLICE, F.explode(wanted[F.col("layer")]).alias("name"))
    kinds = [pa.string(), pa.string(), pa.float64(), pa.string(), *[pa.int32()] * 5, *[pa.float64()] * 3, pa.binary()]
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(key, slices):
        vol_id, name = (k.as_py() for k in key)
        out: list[tuple] = []
        try:
            held: dict[str, list[dict]] = {}
            for r in slices.to_pylist():
                held.setdefault(r["layer"], []).append(r)
            for layer, some in held.items():
                if len({r["z"] for r in some}) < len(some):
                    raise ValueError(f"several files hold the {layer}")
            drawn = _map(name, {layer: stack(some) for layer, some in held.items()}, p, voxel_mm)
            if drawn is not None:
                origin, values, metrics, el = drawn
                for k, plane in enumerate(values.astype("<i2")):
                    out.append((vol_id, name, None, None, origin[0] + k, *origin[1:], *plane.shape, *el, np.ascontiguousarray(plane).tobytes() if plane.any() else b""))
                out += [(vol_id, n, float(v), None, *(None,) * 9) for n, v in sorted(metrics.items())]
        except Exception as e:  # one map's failure is a result
            out = [(vol_id, "error", None, f"{name}: {_reason(e)}", *(None,) * 9)]
        columns = zip(*out, strict=True) if out else [[] for _ in names]
        return pa.table({n: pa.array(list(c), k) for n, k, c in zip(names, kinds, columns, strict=True)})

    return rows.repartition(tasks(rows.sparkSession), "vol_id", "name").groupBy("vol_id", "name").applyInArrow(run, RESULT)


# ---- plane by plane


def plane_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of values of two planes, without (0, 0), and how often each occurs."""
    some = (a != 0) | (b != 0)
    a, b = a[some].astype(np.int64), b[some].astype(np.int64)
    if not len(a):
        return a, b, a
    low_a, low_b = a.min(), b.min()
    width = int(b.max() - low_b) + 1
    if (int(a.max() - low_a) + 1) * width <= 1 << 22:
        counts = np.bincount((a - low_a) * width + (b - low_b))
        cell = np.flatnonzero(counts)
        return cell // width + low_a, cell % width + low_b, counts[cell]
    pair, counts = np.unique(np.stack((a, b)), axis=1, return_counts=True)
    return pair[0], pair[1], counts


def _cut_out(r: dict, side: str, box: tuple[int, int, int, int]) -> np.ndarray:
    """One side's plane on the box ``(y0, y1, x0, x1)``; zero where it holds nothing."""
    y0, y1, x0, x1 = box
    out = np.zeros((y1 - y0, x1 - x0), np.int64)
    if r[f"{side}_data"]:
        oy, ox, ny, nx = (r[f"{side}_{c}"] for c in ("oy", "ox", "ny", "nx"))
        plane = np.frombuffer(r[f"{side}_data"], "<" + r[f"{side}_dtype"]).reshape(ny, nx)
        a, b, c, d = max(y0, oy), min(y1, oy + ny), max(x0, ox), min(x1, ox + nx)
        if a < b and c < d:
            out[a - y0 : b - y0, c - x0 : d - x0] = plane[a - oy : b - oy, c - ox : d - ox].astype(np.int64)  # fractions are cut off
    return out


def joint_planes(ours: DataFrame, reference: DataFrame, union: bool = False) -> DataFrame:
    """``vol_id, name, z, ours, ref, n``: how often values meet in each plane of slices with ``vol_id`` and ``name``.

    The grid is that of ``ours`` (what the reference holds outside is not compared) or, with ``union``,
    the box around both.  A plane that one side lacks is zero there, and so is a voxel outside of a plane.
    Pairs of two zeros are given by one row a volume, with no ``z``: the grid's other voxels.  Volumes that only
    one side has are compared with zeros under ``union``, else those of the reference are left out.
    """
    sizes = ("oy", "ox", "ny", "nx")
    side = lambda df, s: df.select("vol_id", "name", "z", *[F.col(c).alias(f"{s}_{c}") for c in (*sizes, "dtype", "data")])
    grids = ours.select("vol_id", "name", "z", *sizes)
    grids = grids.unionByName(reference.select("vol_id", "name", "z", *sizes)) if union else grids
    box = grids.groupBy("vol_id", "name").agg(F.min("z").alias("z0"), (F.max("z") + 1).alias("z1"), *[e.alias(n) for a in "yx" for e, n in ((F.min(f"o{a}"), f"{a}0"), (F.max(F.col(f"o{a}") + F.col(f"n{a}")), f"{a}1"))])
    planes = side(ours, "a").join(side(reference, "b"), ["vol_id", "name", "z"], "full").join(box, ["vol_id", "name"]).where("z >= z0 AND z < z1")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                span = (r["y0"], r["y1"], r["x0"], r["x1"])
                p, q, n = plane_pairs(_cut_out(r, "a", span), _cut_out(r, "b", span))
                same = lambda v, kind: pa.array([v] * len(n), kind)
                yield pa.RecordBatch.from_arrays([same(r["vol_id"], pa.string()), same(r["name"], pa.string()), same(r["z"], pa.int32()), pa.array(p), pa.array(q), pa.array(n.astype(np.int64))], ["vol_id", "name", "z", "ours", "ref", "n"])

    counts = planes.mapInArrow(run, "vol_id string, name string, z int, ours long, ref long, n long")
    some = counts.groupBy("vol_id", "name").agg(F.sum("n").alias("some"))
    voxels = F.expr("CAST(z1 - z0 AS BIGINT) * (y1 - y0) * (x1 - x0)")
    rest = box.join(some, ["vol_id", "name"], "left").select("vol_id", "name", F.lit(None).cast("int").alias("z"), F.lit(0).cast("long").alias("ours"), F.lit(0).cast("long").alias("ref"), (voxels - F.coalesce("some", F.lit(0))).alias("n"))
    return counts.unionByName(rest)


def comparison(planes: DataFrame, voxel_mm: float = 1.0) -> DataFrame:
    """A row for each volume and name of ``joint_planes``: voxels, mismatches and which side alone is set, supports,
    mean values where set (0 if nowhere), the differences of mismatches and how often each occurs, and the
    first NAMED_SLICES slices that hold a mismatch."""
    n, p, q = F.col("n"), F.col("ours"), F.col("ref")
    total = lambda when: F.coalesce(F.sum(F.when(when, n)), F.lit(0))
    mean = lambda v: F.coalesce(F.sum(F.when(v > 0, n * v)) / F.sum(F.when(v > 0, n)), F.lit(0.0))
    keys = ["vol_id", "name"]
    out = planes.groupBy(*keys).agg(
        F.sum(n).alias("voxels"), total(p != q).alias("mismatches"), total((p != q) & (q == 0)).alias("ours_only"), total((p != q) & (p == 0)).alias("ref_only"),
        total(p > 0).alias("ours_support"), total(q > 0).alias("ref_support"), mean(p).alias("ours_mean"), mean(q).alias("ref_mean"),
        F.slice(F.array_sort(F.collect_set(F.when(p != q, F.col("z")))), 1, NAMED_SLICES).alias("slices"),
    )
    apart = planes.where(p != q).groupBy(*keys, (p - q).alias("difference")).agg(F.sum(n).alias("n"))
    apart = apart.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("difference", "n")))).alias("differences"))
    out = out.join(apart, keys, "left").withColumn("differences", F.coalesce("differences", F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<bigint>"))))
    return out.withColumns({"ours_mean_mm": F.col("ours_mean") * float(voxel_mm), "ref_mean_mm": F.col("ref_mean") * float(voxel_mm)})


def compare_maps(results: DataFrame, layers: DataFrame, union: bool = False) -> DataFrame:
    """``comparison`` of the maps in RESULT rows with those among ``layers``; a map without a reference has no row."""
    ours = results.where("data IS NOT NULL").withColumn("dtype", F.lit("i2"))
    reference = layers.where(F.col("layer").isin(*MAPS)).withColumn("name", F.col("layer"))
    ids = reference.select("vol_id", "name").distinct()
    return comparison(joint_planes(ours.join(ids, ["vol_id", "name"], "left_semi"), reference, union))


def evaluate_apart(grey: DataFrame, periosteal: DataFrame, grid: Grid, params: Evaluation | None = None) -> DataFrame:
    """``vol_id, parameter, value, note``: what ``workflow.evaluate`` gives, each map of a scan in a task of its own.

    A first task a scan finds its masks and segmentation, its densities and porosity.  The masks go on as
    planes on their own boxes (a table on disk, so a lost task of a map does not repeat the first), and
    the maps, which take most of the time, are drawn from them side by side.  Objects other than
    the usual ones are left to ``workflow.evaluate``.
    """
    p = params or Evaluation()
    if (p.maps.thickness_object, p.maps.fraction_object, p.maps.cort_object) != ("seg", "seg", "cort_mask"):
        return evaluate(grey, periosteal, grid, params)
    without = replace(p, maps=replace(p.maps, which=()))
    kinds = [pa.string(), pa.string(), pa.float64(), pa.string(), *[pa.int32()] * 5, *[pa.float64()] * 3, pa.binary()]
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(key, table):
        vol_id = key[0].as_py()
        scan, contour = unpacked(table, grid, 2)
        out: list[tuple] = []
        try:
            masks = find_masks(scan, contour.on, p)
            result, made = measure(scan, grid.el, masks, without)
            metrics = result.metrics
            for name, on in (("SEG", made["seg"] != 0), ("TRAB_MASK", masks.trab), ("CORT_MASK", masks.cort), ("TRAB_SEG", made["trab_seg"] != 0)):
                if not on.any():
                    continue
                box, at = boxed(on, scan.origin)
                for k, plane in enumerate(on[box].astype("<i2")):
                    out.append((vol_id, name, None, None, at[0] + k, *at[1:], *plane.shape, *grid.el, np.ascontiguousarray(plane).tobytes() if plane.any() else b""))
        except Exception as e:  # one scan's failure is a result
            metrics, out = {"error": _reason(e)}, []
        out += [(vol_id, n, None if isinstance(v, str) else float(v), v if isinstance(v, str) else None, *(None,) * 9) for n, v in sorted(metrics.items())]
        return pa.table({n: pa.array(list(c), k) for n, k, c in zip(names, kinds, zip(*out, strict=True), strict=True)})

    first = written(packed(grey, periosteal).applyInArrow(run, RESULT), "scans")
    layers = first.where("data IS NOT NULL").withColumns({"layer": F.col("name"), "dtype": F.lit("i2")})
    maps = measure_given(layers, p.maps, p.maps.which).where("data IS NULL")
    own = first.where("data IS NULL")
    twice = F.col("name").isin("BV_voxels", "TV_voxels", "BV_TV", "BV_mm3", "TV_mm3")
    return own.unionByName(maps.where(~twice)).select("vol_id", F.col("name").alias("parameter"), "value", "note")
