import json

import numpy as np
import pytest

from voxelweave.operators import raster as R
from voxelweave.operators.raster import Raster
from voxelweave.plans import params as P
from voxelweave.plans import pores as O
from voxelweave.plans import workflow as W
from voxelweave.plans.compartments import Calibration, Compartments, separate

from . import plain

SMALL = Compartments(corner_least=200, close_last=15)
P0 = W.Evaluation(compartments=SMALL, maps=W.Maps(which=("TRAB_TH",)))


@pytest.fixture(scope="module")
def scan():
    values, r2 = plain.cylinder()
    grey = Raster(values, (300, 200, 100))
    return grey, r2 <= 6400, W.find_masks(grey, r2 <= 6400, P0)


def test_calibration():
    c = Calibration(1619.07703, -394.095001)
    assert (c.native(500), c.native(3000)) == (4524, 17173)


def test_compartments_fill_the_contour(scan):
    grey, periosteal, m = scan
    W.check_masks(m)
    assert (m.periosteal == periosteal).all() and 0 < m.cort.sum() < m.trab.sum()
    steps, *_ = separate(grey, grey.with_on(periosteal), SMALL, P0.calibration)
    assert len(steps) == 30 and list(steps)[0] == "00_all" and list(steps)[-1] == "29_trabfinal"
    with pytest.raises(ValueError, match="selects no voxel"):
        separate(grey, Raster(np.ones((2, 2, 2), np.int16)), SMALL, P0.calibration)


def test_edits(scan):
    grey, _, m = scan
    again = W.apply_edits(grey, m, P0, periosteal=m.periosteal)
    assert (again.cort == m.cort).all() and (again.trab == m.trab).all() and again.edited == ("periosteal",)
    same = W.apply_edits(grey, m, P0, trab=m.trab)
    assert (same.trab == m.trab).all() and (same.cort == m.cort).all()
    for bad in ({}, {"trab": m.trab, "cort": m.cort}, {"trab": np.ones_like(m.trab)}, {"cort": np.zeros_like(m.cort)}):
        with pytest.raises(ValueError):
            W.apply_edits(grey, m, P0, **bad)
    with pytest.raises(ValueError, match="both"):
        W.check_masks(W.Masks(m.periosteal, m.cort | m.trab, m.trab))


def test_measurement(scan):
    grey, _, m = scan
    result, layers = W.measure(grey, (0.0607,) * 3, m, P0)
    assert 0.2 < result.metrics["BV_TV"] < 0.3 and "notes" not in result.metrics
    assert result.metrics["Ct_Po"] == 0.0 and set(np.unique(layers["seg"])) == {0, 126, 127}
    assert result.metrics["Ct_BMD"] > result.metrics["Tb_BMD"]


def test_pores_do_not_depend_on_the_grid():
    z, y, x = np.indices((12, 40, 40))
    r2 = (2 * y - 39) ** 2 + (2 * x - 39) ** 2
    ring = (r2 <= 1300) & (r2 >= 500)
    bone = ring & ~((x > 33) & (x < 36) & (y > 18) & (y < 21) & (z > 2) & (z < 9))
    a, b = (Raster(np.where(m, 127, 0).astype(np.int16), (5, 6, 7)) for m in (ring, bone))
    want = O.cascade_on_own_grid(a, b, O.Pores(least=2))
    assert want.count() == 2 * 2 * 6
    wide = [Raster(np.pad(r.data, 7), tuple(o - 7 for o in r.origin)) for r in (a, b)]
    got = O.cascade_on_own_grid(*wide, O.Pores(least=2))
    assert (got.like(want) == want.data).all() and got.count() == want.count()
    with pytest.raises(ValueError):
        O.cascade_on_own_grid(Raster(np.zeros((3, 3, 3), np.int16)), b)


def test_hysteresis_axes():
    a = np.full((3, 1, 4), 9, np.int16)
    a[0, 0] = [0, 3, 9, 3]
    a[1, 0] = [3, 9, 9, 3]
    along_z = R.hysteresis(Raster(a), 1, 3)
    assert along_z.on.sum() == 2
    assert R.hysteresis(Raster(a), 1, 3, axes=(1, 0, 1)).on.sum() == 3
    with pytest.raises(ValueError):
        R.hysteresis(Raster(a), 3, 1)


def test_parameters():
    r = P.resolve("radius", {"compartments": {"sigma": "1.5"}}, {"compartments.close2": 20, "maps.which": "TRAB_TH CORT_TH"})
    assert r.values.compartments.sigma == 1.5 and r.values.compartments.close_last == 20 and r.values.maps.which == ("TRAB_TH", "CORT_TH")
    assert set(r.non_default()) == {"compartments.sigma", "compartments.close_last", "maps.which"} and r.sources["compartments.sigma"] == "file"
    assert "sigma = 1.5 (file)" in r.statement() and P.resolve().statement().endswith("as in the preset")
    assert r.in_context(separation=False).values.compartments == P.PRESETS["radius"].compartments and "compartments.sigma" in r.in_context(separation=False).not_applied
    again = P.resolve(file=json.loads(r.to_json()))
    assert again.values == r.values and again.preset == "radius"
    for bad in ({"compartments.sigm": 1}, {"compartments.support": 0}, {"compartments.support": 1.5}, {"maps.version": 4}, {"compartments": {"lower_mgha": 5000}}, {"segmentation.double": "maybe"}, {"compartments.sigma": 2, "compartments": {"sigma": 3}}):
        with pytest.raises(P.ParameterError):
            P.apply(P.PRESETS["tibia"], bad)
    with pytest.raises(P.ParameterError, match="did you mean compartments.sigma"):
        P.coerce("compartments.sigm", 1)
    assert P.coerce("pores.clip_low", "none") is None and P.coerce("compartments.mirror", "1") == (1, 1, 1)
    assert P.parse_setting("a.b=[1, 2]") == ("a.b", [1, 2]) and P.parse_setting("a=word") == ("a", "word")


def test_table_of_parameters(spark):
    rows = {r.name: r for r in P.describe(spark).collect()}
    assert rows["compartments.sigma"].value == "2.0" and len(rows) == len(P.kinds())
