"""Scans on grids of their own with calibrations of their own: run, redo and export, against single evaluations."""

import dataclasses
import json

import numpy as np
import pytest

from voxelweave import cli
from voxelweave.operators import raster as R
from voxelweave.operators import voxel as V
from voxelweave.operators.grid import Grid
from voxelweave.operators.raster import Raster
from voxelweave.plans import workflow as W
from voxelweave.plans.compartments import Calibration, Compartments
from voxelweave.sources import images as I

from . import plain

SETS = [x for s in ("compartments.corner_least=200", "compartments.close_last=15", 'maps.which=["TRAB_TH"]') for x in ("--set", s)]
P0 = W.Evaluation(compartments=Compartments(corner_least=200, close_last=15), maps=W.Maps(which=("TRAB_TH",)))
#: Voxel size in mm, origin, and calibration of each scan; the second one's values are scaled to it.
SCANS = {"a/one": (0.0607, (300, 200, 100), (1619.07703, -394.095001, 8192.0)), "b/one": (0.082, (5, -7, 30), (1700.5, -400.25, 4096.0))}


def scan_of(name):
    values, r2 = plain.cylinder()
    el, origin, (slope, intercept, scaling) = SCANS[name]
    mg = values / 8192 * 1619.07703 - 394.095001
    own = np.rint((mg - intercept) / slope * scaling).astype(np.int16)
    return Raster(own, origin), r2 <= 6400, (el,) * 3, Calibration(slope, intercept, scaling)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("scans")
    for name in SCANS:
        grey, periosteal, el, c = scan_of(name)
        grid = Grid(grey.shape, grey.origin, el)
        log = f"Mu_Scaling   {c.mu_scaling}\nDensity: slope {c.slope}\nDensity: intercept {c.intercept}\n"
        for kind, raw in (("in", I.encode_volume_030(grey.data, grid, log)), ("contour", I.encode_volume_030(np.where(periosteal, 127, 0).astype(np.uint8), grid))):
            (out / kind / name).parent.mkdir(parents=True, exist_ok=True)
            (out / kind / f"{name}.aim").write_bytes(raw)
    bad = np.ones((3, 4, 5), np.int16)
    (out / "in" / "nolog.aim").write_bytes(I.encode_volume_030(bad, Grid(bad.shape)))
    return out


def metrics(path, spark):
    out = {}
    for r in W.metrics_of(spark.read.parquet(f"{path}/results")).collect():
        out.setdefault(r.vol_id, {})[r.parameter] = r.note if r.value is None else r.value
    return out


def test_run_redo_and_export(spark, folder):
    assert cli.main(["run", str(folder / "in"), str(folder / "contour"), str(folder / "out"), *SETS]) == 1  # one scan has no log
    got = metrics(folder / "out", spark)
    assert set(got) == {"a/one", "b/one", "nolog"} and "no calibration" in got["nolog"]["error"]
    for name in SCANS:
        grey, periosteal, el, c = scan_of(name)
        p = dataclasses.replace(P0, calibration=c)
        masks = W.find_masks(grey, periosteal, p)
        el = tuple(round(e * 1e6) / 1e6 for e in el)
        want = W.measure(grey, el, masks, p)[0].metrics
        assert {k: v for k, v in got[name].items() if k != "calibration"} == pytest.approx(want) and got[name]["calibration"] == "log"
    assert got["a/one"]["Tb_Th_mm"] < got["b/one"]["Tb_Th_mm"] and got["a/one"]["Tb_BMD"] == pytest.approx(got["b/one"]["Tb_BMD"], abs=0.5)
    assert json.loads((next((folder / "out" / "json").glob("part-*.json"))).read_text().splitlines()[0])["vol_id"]
    # The trabecular mask as it is, read back as an edit, gives what it gave.
    file = folder / "edit" / "b" / "one.nrrd"
    file.parent.mkdir(parents=True)
    assert cli.main(["export", str(folder / "out"), "b/one", str(file), "--layer", "trab"]) == 0
    assert cli.main(["redo", str(folder / "in"), str(folder / "out"), str(folder / "again"), "--trab", str(folder / "edit"), *SETS]) == 0
    again = metrics(folder / "again", spark)
    assert set(again) == {"b/one"} and again["b/one"].pop("edited") == "trab" and again["b/one"] == pytest.approx(got["b/one"])
    assert cli.main(["export", str(folder / "out"), "b/one", str(folder / "b.seg.nrrd")]) == 0
    data, fields = I.decode_nrrd((folder / "b.seg.nrrd").read_bytes())
    assert set(np.unique(data)) == {0, 1, 2} and I.segments(fields)[1]["Name"] == "trab" and (data == 2).sum() == I.decode_nrrd(file.read_bytes())[0].astype(bool).sum()
    assert cli.main(["export", str(folder / "out"), "c/none", str(folder / "x.nrrd")]) == 2
    assert cli.main(["redo", str(folder / "in"), str(folder / "out"), str(folder / "none")]) == 2


def test_morphology_of_many_steps(spark):
    """Beyond three steps the relational forms hand over to the array kernels."""
    rng = np.random.default_rng(4)
    on = np.zeros((14, 16, 18), bool)
    on[2:12, 3:14, 2:16] = rng.random((10, 11, 14)) < 0.98
    at = np.argwhere(on)
    table = spark.createDataFrame([("a", *map(int, p), 127) for p in at], "vol_id string, z int, y int, x int, v int")
    grid, r = Grid(on.shape), Raster(np.where(on, 127, 0).astype(np.int16))
    rows = lambda df: {(x.z, x.y, x.x) for x in df.collect()}
    places = lambda q: {tuple(int(c) for c in p + q.origin) for p in np.argwhere(q.on)}
    assert rows(V.erode(table, grid, 4)) == places(R.erode(r, 4)) and rows(V.dilate(table, 5)) == places(R.dilate(r, 5))
    assert rows(V.close(table, grid, 4)) == places(R.close(r, 4))


def test_thresholds_are_whole():
    with pytest.raises(ValueError, match="no whole native number"):
        R.gauss_band(Raster(np.zeros((9, 9, 9), np.int16)), 2.0, 3, 4523.83, 17173)
    assert R.whole_number(4524.0, "x") == 4524
