"""The whole evaluation of scans, and its repetition with masks that were edited by hand.

``evaluate_scans`` takes the slices of any number of scans, each on its own grid and with the
calibration of its own log; ``evaluate`` takes voxel tables on one grid.  Each scan is one task,
and a scan that fails, for whatever reason, gives a row with it instead of failing the others.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import raster as R
from ..operators.contour import render
from ..operators.grid import Grid, packed, unpacked
from ..functions.text import calibration as log_calibration
from ..operators.raster import Raster
from .compartments import TIBIA, Calibration, Compartments, separate
from .morphometry import Maps, Result, Segmentation, density, morphometry, segment
from .pores import Pores, cascade_on_own_grid


@dataclass(frozen=True)
class Evaluation:
    """Parameters of all steps."""

    compartments: Compartments = TIBIA
    segmentation: Segmentation = Segmentation()
    maps: Maps = Maps()
    pores: Pores = Pores()
    calibration: Calibration = Calibration(1619.07703, -394.095001)
    porosity: str = "contour"

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


@dataclass
class Masks:
    """Masks on the scan's grid, and which of them were edited."""

    periosteal: np.ndarray
    cort: np.ndarray
    trab: np.ndarray
    edited: tuple[str, ...] = ()


def rendered(on: np.ndarray) -> np.ndarray:
    """Contours rendered on the mask's own box."""
    out = np.zeros(on.shape, bool)
    box = R.tight_box(on)
    if box is not None:
        out[box] = render(on[box])
    return out


def find_masks(grey: Raster, periosteal: np.ndarray, p: Evaluation) -> Masks:
    whole = rendered(periosteal)
    _, cort, trab = separate(grey, grey.with_on(whole), p.compartments, p.calibration)
    return Masks(whole, cort.like(grey) != 0, trab.like(grey) > 0)


def derive(edited: np.ndarray, whole: np.ndarray, name: str = "edited") -> tuple[np.ndarray, np.ndarray]:
    """The edited compartment's rendering inside the contour, and the rest of the contour."""
    outside = int((edited & ~whole).sum())
    if outside:
        raise ValueError(f"{outside} voxels of the {name} mask lie outside of the contour")
    if not edited.any():
        raise ValueError(f"the {name} mask is empty")
    own = rendered(edited) & whole
    rest = whole & ~own
    if not own.any() or not rest.any():
        raise ValueError(f"the {name} mask leaves nothing of a compartment")
    return own, rest


def apply_edits(grey: Raster, before: Masks, p: Evaluation, periosteal=None, trab=None, cort=None) -> Masks:
    """Which masks follow from which edits.

    An edited contour alone starts the separation anew; an edited compartment gives the
    other one as the rest of the (edited) contour.  Both compartments at once, or no edit,
    is refused.
    """
    if trab is not None and cort is not None:
        raise ValueError("edit one compartment: the other is the rest of the contour")
    if periosteal is None and trab is None and cort is None:
        raise ValueError("no edited mask")
    whole = before.periosteal if periosteal is None else rendered(periosteal)
    names = tuple(n for n, m in (("periosteal", periosteal), ("trab", trab), ("cort", cort)) if m is not None)
    if trab is not None:
        own, rest = derive(trab, whole, "trabecular")
        return Masks(whole, rest, own, names)
    if cort is not None:
        own, rest = derive(cort, whole, "cortical")
        return Masks(whole, own, rest, names)
    return replace(find_masks(grey, periosteal, p), edited=names)


def check_masks(m: Masks) -> None:
    """The compartments must be disjoint and fill the contour."""
    if (m.cort & m.trab).any():
        raise ValueError(f"{int((m.cort & m.trab).sum())} voxels are in both compartments")
    off = int(((m.cort | m.trab) ^ m.periosteal).sum())
    if off:
        raise ValueError(f"contour and compartments differ in {off} voxels")


def measure(grey: Raster, el_zyx, m: Masks, p: Evaluation) -> tuple[Result, dict[str, np.ndarray]]:
    """Segmentation, maps and metrics; density and porosity may fail without failing the rest."""
    cort_contour, trab_contour = rendered(m.cort), rendered(m.trab)
    labels, cort_seg, trab_seg = segment(grey, el_zyx, m.periosteal, cort_contour, trab_contour, p.segmentation)
    out = morphometry(labels > 0, trab_contour, m.cort, cort_contour, grey.origin, float(el_zyx[2]), p.maps, trab_seg, m.periosteal)
    layers = {"seg": labels, "cort_seg": cort_seg, "trab_seg": trab_seg}
    notes = []
    try:
        for name, mask in (("Tt", m.periosteal), ("Ct", m.cort), ("Tb", m.trab)):
            out.metrics[f"{name}_BMD"], out.metrics[f"{name}_BMD_sd"] = density(grey, mask, p.calibration.slope, p.calibration.intercept, p.calibration.mu_scaling)
    except Exception as e:  # a density that fails is reported, and the run goes on
        notes.append(f"density: {e}")
    try:
        contour, bone = (Raster(np.where(a, 127, 0).astype(np.int16), grey.origin) for a in (cort_contour, cort_seg))
        pore = cascade_on_own_grid(contour, bone, p.pores)
        inside = int((pore.on & (contour.like(pore) != 0)).sum())
        low = contour.count() if p.porosity == "contour" else pore.count() + bone.count()
        high = inside if p.porosity == "contour" else pore.count()
        out.metrics |= {"Ct_Po": high / low if low else float("nan"), "Ct_Po_voxels": pore.count()}
        layers["pores"] = pore.like(grey) != 0
    except Exception as e:
        notes.append(f"porosity: {e}")
    if notes:
        out.metrics["notes"] = "; ".join(notes)
    return out, layers


def _reason(e: Exception) -> str:
    return str(e) if isinstance(e, (ValueError, RuntimeError)) and str(e) else f"{type(e).__name__}: {e}"


def evaluate(grey: DataFrame, periosteal: DataFrame, grid: Grid, params: Evaluation | None = None) -> DataFrame:
    """``vol_id, parameter, value, note``: the metrics of each scan in long form."""
    p = params or Evaluation()

    def run(key, table):
        scan, contour = unpacked(table, grid, 2)
        try:
            metrics = measure(scan, grid.el, find_masks(scan, contour.on, p), p)[0].metrics
        except Exception as e:  # one scan's failure is a result
            metrics = {"error": _reason(e)}
        names = sorted(metrics)
        number = [None if isinstance(metrics[n], str) else float(metrics[n]) for n in names]
        note = [metrics[n] if isinstance(metrics[n], str) else None for n in names]
        return pa.table({"vol_id": pa.array([key[0].as_py()] * len(names), pa.string()), "parameter": pa.array(names, pa.string()), "value": pa.array(number, pa.float64()), "note": pa.array(note, pa.string())})

    return packed(grey, periosteal).applyInArrow(run, "vol_id string, parameter string, value double, note string")


# ---- scans on grids of their own


#: What an evaluation gives: metrics (``value`` or ``note``), and layers as slices of short integers.
RESULT = "vol_id string, name string, value double, note string, z int, oy int, ox int, ny int, nx int, ez double, ey double, ex double, data binary"
CALIBRATION = ("slope", "intercept", "mu_scaling")
SLICE = ("z", "oy", "ox", "ny", "nx", "ez", "ey", "ex", "dtype", "data")


def headers(slices: DataFrame, overrides: dict[str, float] | None = None) -> DataFrame:
    """``vol_id, slope, intercept, mu_scaling, source``: each scan's calibration.

    It is what the scan's own log states (kept in its first slice), with ``overrides`` in place of
    single values; a value that neither gives is null.
    """
    own = log_calibration(F.max("log"))
    values = {n: F.coalesce(F.lit((overrides or {}).get(n)).cast("double"), own[n]) for n in CALIBRATION}
    source = F.array_join(F.array_compact(F.array(F.when(own["slope"].isNotNull(), F.lit("log")), F.lit("override") if overrides else F.lit(None).cast("string"))), "+")
    out = slices.groupBy("vol_id").agg(*[v.alias(n) for n, v in values.items()], source.alias("source"))
    return out.select(F.col("vol_id").alias("vol_id"), *CALIBRATION, "source")  # a column of its own, so that it can meet the slices again


def thresholds(scans: DataFrame, **densities: float) -> DataFrame:
    """Native numbers of densities in mg for each scan's calibration, rounded half to even."""
    native = lambda mg: F.rint((F.lit(float(mg)) - F.col("intercept")) / F.col("slope") * F.col("mu_scaling")).cast("int")
    return scans.select("vol_id", *[native(mg).alias(n) for n, mg in densities.items()])


def stack(slices: list[dict]) -> tuple[Raster, tuple[float, float, float]]:
    """The volume of some slices on the box that holds them all, and its voxel size."""
    if not slices:
        raise ValueError("no slices")
    low = tuple(min(s[k] for s in slices) for k in ("z", "oy", "ox"))
    high = (max(s["z"] for s in slices) + 1, max(s["oy"] + s["ny"] for s in slices), max(s["ox"] + s["nx"] for s in slices))
    out = np.zeros(tuple(h - l for l, h in zip(low, high, strict=True)), np.dtype(slices[0]["dtype"]))
    for s in slices:
        y, x = s["oy"] - low[1], s["ox"] - low[2]
        out[s["z"] - low[0], y : y + s["ny"], x : x + s["nx"]] = np.frombuffer(s["data"], s["dtype"]).reshape(s["ny"], s["nx"])
    first = slices[0]
    return Raster(out, low), (first["ez"], first["ey"], first["ex"])


def _layer_rows(vol_id: str, name: str, r: Raster, el) -> list[tuple]:
    rows = []
    for k in np.flatnonzero(r.on.any(axis=(1, 2))).tolist():
        plane = np.ascontiguousarray(r.data[k].astype("<i2"))
        rows.append((vol_id, name, None, None, r.origin[0] + k, r.origin[1], r.origin[2], *plane.shape, *el, plane.tobytes()))
    return rows


def _aligned(r: Raster, el, grey: Raster, own, what: str) -> np.ndarray:
    if any(abs(a - b) > 1e-5 * b for a, b in zip(el, own, strict=True)):
        raise ValueError(f"voxels of the {what} of {el} mm do not match the scan's {own}")
    return r.like(grey) != 0


def scan_rows(vol_id: str, layers: dict[str, list[dict]], values: dict, p: Evaluation, redo: bool = False) -> list[tuple]:
    """RESULT rows of one scan from its slices by layer and its calibration; a failure is a result too."""
    try:
        layers = dict(layers)
        if "grey" not in layers:
            raise ValueError("there is no scan of this name")
        grey, el = stack(layers.pop("grey"))
        if missing := [n for n in CALIBRATION if values.get(n) is None]:
            raise ValueError(f"the scan's log has no calibration ({', '.join(missing)}); give calibration values")
        own = replace(p, calibration=Calibration(*(values[n] for n in CALIBRATION)))
        others = {n: _aligned(*stack(s), grey, el, n) for n, s in layers.items()}
        if not redo:
            if "contour" not in others:
                raise ValueError("there is no contour of this name")
            found = find_masks(grey, others["contour"], own)
        else:
            empty = np.zeros(grey.shape, bool)
            before = Masks(*(others.get(n, empty) for n in ("periosteal", "cort", "trab")))
            check_masks(before)
            found = apply_edits(grey, before, own, **{n.removeprefix("new "): m for n, m in others.items() if n.startswith("new ")})
        check_masks(found)
        result, made = measure(grey, el, found, own)
        metrics = result.metrics | {"calibration": values.get("source")} | ({"edited": " ".join(found.edited)} if found.edited else {})
        drawn = {n: grey.with_on(m, 1) for n, m in (("periosteal", found.periosteal), ("cort", found.cort), ("trab", found.trab))}
        drawn |= {n: Raster(m.astype(np.int16), grey.origin) for n, m in made.items()} | result.maps
        out = [row for n, r in drawn.items() for row in _layer_rows(vol_id, n, r, el)]
    except Exception as e:  # one scan's failure is a result
        metrics, out = {"error": _reason(e)}, []
    none = (None,) * 9
    return out + [(vol_id, n, None if isinstance(v, str) else float(v), v if isinstance(v, str) else None, *none) for n, v in sorted(metrics.items())]


def evaluate_scans(scans: DataFrame, contours: DataFrame, params: Evaluation | None = None, overrides: dict[str, float] | None = None, edits: dict[str, DataFrame] | None = None, masks: DataFrame | None = None) -> DataFrame:
    """RESULT rows of each scan: its metrics, masks (``periosteal, cort, trab``), segmentation, maps and pores.

    ``scans`` and ``contours`` are slices as the readers give them, with ``vol_id`` in place of the
    path.  Every scan keeps its grid and voxel size, and is measured with the calibration of its
    own log; ``overrides`` put single values in its place, and a scan without either is an error.
    With ``edits`` (slices of edited masks by kind: periosteal, trab or cort) and ``masks`` (the
    layers of an earlier result) a scan is measured anew with the masks that follow from its edits;
    scans without an edit are left out.  One shuffle of slices by ``vol_id``, as binary planes.
    """
    p, redo = params or Evaluation(), edits is not None
    fields = ["vol_id", "layer", *SLICE]
    part = lambda df, name: df.withColumn("layer", F.lit(name)).select(*fields)
    rows = part(scans, "grey")
    if not redo:
        rows = rows.unionByName(part(contours, "contour"))
    else:
        whole = masks.where(F.col("name").isin("periosteal", "cort", "trab")).withColumns({"dtype": F.lit("i2"), "layer": F.col("name")}).select(*fields)
        changed = None
        for kind, df in edits.items():
            some = part(df, f"new {kind}")
            changed = some if changed is None else changed.unionByName(some)
        ids = changed.select("vol_id").distinct()
        rows = rows.unionByName(whole).join(ids, "vol_id", "left_semi").select(*fields).unionByName(changed)

    def run(key, slices, header):
        vol_id = key[0].as_py()
        kinds = [pa.string(), pa.string(), pa.float64(), pa.string(), *[pa.int32()] * 5, *[pa.float64()] * 3, pa.binary()]
        names = [f.split()[0] for f in RESULT.split(", ")]
        if not slices.num_rows:  # a header without an edit
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
        layers: dict[str, list[dict]] = {}
        for r in slices.to_pylist():
            layers.setdefault(r["layer"], []).append(r)
        out = scan_rows(vol_id, layers, header.to_pylist()[0] if header.num_rows else {}, p, redo)
        return pa.table({n: pa.array(list(c), k) for n, k, c in zip(names, kinds, zip(*out, strict=True), strict=True)})

    return rows.groupBy("vol_id").cogroup(headers(scans, overrides).groupBy("vol_id")).applyInArrow(run, RESULT)


def metrics_of(results: DataFrame) -> DataFrame:
    """``vol_id, parameter, value, note`` of RESULT rows."""
    return results.where("data IS NULL").select("vol_id", F.col("name").alias("parameter"), "value", "note")


def layers_of(results: DataFrame, *names: str) -> DataFrame:
    """The slices of some layers (all, if none is named)."""
    out = results.where("data IS NOT NULL")
    return out.where(F.col("name").isin(*names)) if names else out
