"""Segmentation by frequency and the metrics and maps of a separated scan."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..operators import frequency, sphere
from ..operators import raster as R
from ..operators.contour import render
from ..operators.raster import Raster


@dataclass(frozen=True)
class Segmentation:
    border: str = "duplicate"
    low: int = frequency.LOW
    high: int = frequency.HIGH
    rounding: str = "ceil"
    double: bool = False
    least_cort: int = 35
    least_trab: int = 70
    order: str = "periosteal_first"
    trab_masked: bool = True
    overlap: str = "trab"
    peel_periosteal: int = 0
    peel_cort: int = 0
    peel_trab: int = 0


@dataclass(frozen=True)
class Maps:
    epsilon: float = 0.9
    assign: float = 0.5
    peel: int = -1
    version: int = 3
    which: tuple[str, ...] = ("TRAB_TH", "TRAB_SP", "TRAB_1N", "CORT_TH")
    cort_object: str = "cort_mask"
    thickness_object: str = "seg"
    fraction_object: str = "seg"

    def how(self) -> dict:
        return {"epsilon": self.epsilon, "assign": self.assign, "peel": self.peel, "version": self.version}


def segment(grey: Raster, el_zyx, periosteal: np.ndarray, cort: np.ndarray, trab: np.ndarray, p: Segmentation | None = None):
    """``(labels, cortical, trabecular)`` on the scan's grid; contours are rendered already."""
    p = p or Segmentation()
    wide = p.order == "gobj_first"
    on = frequency.frequency_threshold(grey.data, el_zyx, p.border, p.low, p.high, wide, rounding=p.rounding, kind=np.float64 if p.double else np.float32)
    inner = on[1:-1, 1:-1, 1:-1] if wide else on
    parts = frequency.assemble(inner, R.peeled(periosteal, p.peel_periosteal), R.peeled(cort, p.peel_cort), R.peeled(trab, p.peel_trab), p.least_cort, p.least_trab, p.order, p.trab_masked, on if wide else None)
    return frequency.labelled(*parts, winner=p.overlap), *parts


def map_report(values: np.ndarray, objects: int, voxel_mm: float, prefix: str) -> dict[str, float]:
    """Moments of a map's positive values in mm, and the share of the object they reach."""
    v = values[values > 0].astype(np.float64) * voxel_mm
    n = len(v)
    d = v - v.mean() if n else v
    m2 = float((d * d).mean()) if n else 0.0
    moment = lambda k, p: float((d**k).mean() / m2**p) if n > 2 and m2 > 0 else 0.0
    return {
        f"{prefix}_mm": float(v.mean()) if n else 0.0, f"{prefix}_sd_mm": m2**0.5, f"{prefix}_max_mm": float(v.max()) if n else 0.0, f"{prefix}_n": n,
        f"{prefix}_skew": moment(3, 1.5), f"{prefix}_kurtosis": moment(4, 2) - (3.0 if n > 2 and m2 > 0 else 0.0), f"{prefix}_valid": n / max(objects, 1),
    }


@dataclass
class Result:
    maps: dict[str, Raster] = field(default_factory=dict)
    metrics: dict[str, float] = field(default_factory=dict)


def boxed(on: np.ndarray, origin) -> tuple[tuple[slice, ...], tuple[int, ...]]:
    box = R.tight_box(on)
    if box is None:
        raise ValueError("the volume is empty")
    return box, tuple(o + s.start for o, s in zip(origin, box, strict=True))


def morphometry(seg: np.ndarray, trab_contour: np.ndarray, cort: np.ndarray, cort_contour: np.ndarray, origin, voxel_mm: float, p: Maps | None = None, trab_seg: np.ndarray | None = None, periosteal: np.ndarray | None = None) -> Result:
    """Maps and metrics.  The trabecular maps run on the segmentation's box, the cortical one
    on its own: outside of the box counts as object."""
    p = p or Maps()
    out = Result()
    for name, kind in (("thickness_object", p.thickness_object), ("fraction_object", p.fraction_object)):
        if kind not in ("seg", "trab_seg") or (kind == "trab_seg" and trab_seg is None):
            raise ValueError(f"{name}: {kind!r} is not there")
    box, at = boxed(seg, origin)
    s, g = seg[box], trab_contour[box]
    pick = lambda kind: s if kind == "seg" else trab_seg[box]
    bone, total = int((pick(p.fraction_object) & g).sum()), int(g.sum())
    out.metrics |= {"BV_voxels": bone, "TV_voxels": total, "BV_TV": bone / total if total else 0.0, "BV_mm3": bone * voxel_mm**3, "TV_mm3": total * voxel_mm**3}
    runs = {"TRAB_TH": (sphere.thickness, pick(p.thickness_object), "Tb_Th"), "TRAB_SP": (sphere.spacing, s, "Tb_Sp"), "TRAB_1N": (sphere.number, s, "Tb_1N")}
    if trab_seg is not None:
        runs["TRAB_TH_old"] = (sphere.thickness, trab_seg[box], "Tb_Th_old")
    for name, (draw, obj, prefix) in runs.items():
        if name in p.which:
            values, _ = draw(obj, g, **p.how())
            out.maps[name] = Raster(values, at)
            target = obj & g if draw is sphere.thickness else ~obj & g if draw is sphere.spacing else g
            out.metrics |= map_report(values, int(target.sum()), voxel_mm, prefix)
    if "TRAB_1N" in p.which:
        mean = out.metrics["Tb_1N_mm"]
        out.metrics["Tb_N_per_mm"] = 1 / mean if mean > 0 else 0.0
    if "CORT_TH" in p.which:
        if p.cort_object == "periosteal_minus_trab":
            if periosteal is None:
                raise ValueError("the cortical object needs the periosteal contour")
            cort = periosteal & ~trab_contour
            own, _ = boxed(cort, origin)
            cort_contour = np.zeros_like(cort)
            cort_contour[own] = render(cort[own])
        elif p.cort_object != "cort_mask":
            raise ValueError(f"cort_object is cort_mask or periosteal_minus_trab, not {p.cort_object!r}")
        box, at = boxed(cort, origin)
        values, _ = sphere.thickness(cort[box], cort_contour[box], **p.how())
        out.maps["CORT_TH"] = Raster(values, at)
        out.metrics |= map_report(values, int((cort[box] & cort_contour[box]).sum()), voxel_mm, "Ct_Th")
        out.metrics |= {"Ct_V_voxels": int(cort_contour[box].sum()), "Ct_V_mm3": int(cort_contour[box].sum()) * voxel_mm**3}
    return out


def density(grey: Raster, inside: np.ndarray, slope: float, intercept: float, scaling: float) -> tuple[float, float]:
    """Mean and population SD in mg inside a mask; not a number if it is empty."""
    v = grey.data[inside].astype(np.float64) / scaling * slope + intercept
    return (float(v.mean()), float(v.std())) if len(v) else (float("nan"), float("nan"))
