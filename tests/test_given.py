"""Maps from given masks and plane-wise comparison against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import sphere
from voxelweave.operators.contour import render
from voxelweave.operators.grid import Grid
from voxelweave.plans import given as G
from voxelweave.sources import volumes as S

EL = (0.06, 0.06, 0.06)


def rows(name, a, origin, vol="s", dtype="i2"):
    return [(vol, name, origin[0] + k, *origin[1:], *p.shape, *EL, dtype, p.astype("<" + dtype).tobytes() if p.any() else None) for k, p in enumerate(a)]


SCHEMA = "vol_id string, name string, z int, oy int, ox int, ny int, nx int, ez double, ey double, ex double, dtype string, data binary"


def slices(spark, found):
    return spark.createDataFrame(found, SCHEMA)


@pytest.mark.parametrize("union", [False, True])
def test_joint_planes_like_a_loop(spark, union):
    rng = np.random.default_rng(4)
    one, two = rng.integers(-2, 3, (4, 5, 6)), rng.integers(-2, 3, (5, 4, 7)) * 40000
    ours, ref = rows("M", one, (0, 0, 0)), rows("M", two, (1, 2, -3), dtype="i4") + rows("X", two, (0, 0, 0), dtype="i4")
    cells = {}
    for z, y, x in np.ndindex(7, 8, 12):
        z, y, x = z, y, x - 4
        inside = [all(0 <= c - o < n for c, o, n in zip((z, y, x), at, a.shape)) for at, a in (((0, 0, 0), one), ((1, 2, -3), two))]
        box = 0 <= z < 6 and 0 <= y < 6 and -3 <= x < 6 if union else inside[0]
        if box:
            p, q = (int(a[z - at[0], y - at[1], x - at[2]]) if i else 0 for i, (at, a) in zip(inside, (((0, 0, 0), one), ((1, 2, -3), two))))
            cells[p, q] = cells.get((p, q), 0) + 1
    planes = G.joint_planes(slices(spark, ours), slices(spark, ref), union)
    got = {(r.ours, r.ref): r.n for r in planes.where("name = 'M'").groupBy("ours", "ref").agg(F.sum("n").alias("n")).collect()}
    assert got == cells
    assert planes.where("name = 'X'").count() == 0 or union
    report = G.comparison(planes).where("name = 'M'").first()
    assert report.voxels == sum(cells.values()) and report.mismatches == sum(n for (p, q), n in cells.items() if p != q)
    assert report.differences == {d: sum(n for (p, q), n in cells.items() if p - q == d) for d in {p - q for p, q in cells if p != q}}
    assert report.slices == list(range(6 if union else 4))


def test_report_of_equal_and_many_slices(spark):
    a = np.zeros((70, 2, 2), int)
    a[:, 0, 0] = 3
    b = a.copy()
    b[5:, 0, 0] = 4
    both = rows("M", a, (10, 0, 0)) + rows("M", np.zeros((1, 1, 1), int), (0, 0, 0), "e")
    report = {r.vol_id: r for r in G.comparison(G.joint_planes(slices(spark, both), slices(spark, rows("M", b, (10, 0, 0))))).collect()}
    assert report["s"].slices == list(range(15, 65)) and report["s"].differences == {-1: 65} and report["s"].ref_mean == pytest.approx((5 * 3 + 65 * 4) / 70)
    assert (report["e"].voxels, report["e"].mismatches, report["e"].slices, report["e"].differences, report["e"].ours_mean) == (1, 0, [], {}, 0.0)


def test_pairs_of_a_wide_range():
    a, b = np.array([[0, 30000, -30000, 5]]), np.array([[0, 9, 30000, 0]])
    assert sorted(zip(*(x.tolist() for x in G.plane_pairs(a, b)))) == [(-30000, 30000, 1), (5, 0, 1), (30000, 9, 1)]


def phantom():
    rng = np.random.default_rng(6)
    trab = np.zeros((8, 14, 14), bool)
    trab[1:-1, 2:12, 2:12] = True
    seg = trab & (rng.random(trab.shape) < 0.6)
    cort = np.zeros(trab.shape, bool)
    cort[:, 1:13, 1:13] = True
    return seg, trab, cort & ~trab


def test_maps_of_given_masks(spark, tmp_path):
    seg, trab, cort = phantom()
    grid = Grid(seg.shape, (2, -3, 4), EL)
    region = render(trab)
    want = {"TRAB_TH": sphere.thickness(seg, region)[0], "TRAB_SP": sphere.spacing(seg, region)[0], "TRAB_1N": sphere.number(seg, region)[0], "CORT_TH": sphere.thickness(cort, render(cort))[0]}
    off = want["TRAB_TH"].copy()
    at = tuple(np.argwhere(off)[0])
    off[at] += 2
    layers = {"SEG": seg, "TRAB_MASK": trab, "CORT_MASK": cort, "TRAB_TH": off, "TRAB_1N": want["TRAB_1N"]}
    voxels = spark.createDataFrame([(f"one_{n}_decompressed" if n == "SEG" else f"one_{n}", *(int(c + o) for c, o in zip(p, grid.origin)), int(a[tuple(p)])) for n, a in layers.items() for p in np.argwhere(a)] + [("two_CORT_MASK", 3, 2, 8, 127), ("three_SEG", 3, 2, 8, 127), ("other_name", 3, 0, 8, 1)], "vol_id string, z int, y int, x int, v int")
    S.write_volumes(S.planes(voxels, grid), str(tmp_path / "run"))
    found = G.scan_files(spark, str(tmp_path / "run"))
    assert {(r.vol_id, r.layer) for r in found.select("vol_id", "layer").distinct().collect()} == {("one", n) for n in layers} | {("two", "CORT_MASK"), ("three", "SEG")}
    results = G.measure_given(found).persist()
    got = {}
    for r in results.where("vol_id = 'one' AND data IS NOT NULL").collect():
        plane = np.frombuffer(r.data, "<i2").reshape(r.ny, r.nx) if r.data else np.zeros((r.ny, r.nx))
        got.setdefault(r.name, {})[r.z] = plane
    assert got.keys() == want.keys()
    for name, a in want.items():
        assert sorted(got[name]) == list(range(2, 10)) and all((got[name][2 + k] == a[k]).all() for k in range(8))
    notes = {(r.vol_id, r.note) for r in results.where("name = 'error'").collect()}
    assert {v for v, _ in notes} == {"three"} and any("no TRAB_MASK" in n for _, n in notes)
    value = {r.name: r.value for r in results.where("vol_id = 'one' AND data IS NULL").collect()}
    assert value["BV_TV"] == pytest.approx((seg & region).sum() / region.sum()) and value["Ct_V_voxels"] == render(cort).sum()
    report = {r.name: r for r in G.compare_maps(results, found).collect()}
    assert report.keys() == {"TRAB_TH", "TRAB_1N"} and report["TRAB_1N"].mismatches == 0
    th = report["TRAB_TH"]
    assert (th.mismatches, th.ours_only, th.ref_only, th.differences, th.slices) == (1, 0, 0, {-2: 1}, [int(at[0]) + 2]) and th.voxels == seg.size


def test_the_same_layer_twice_is_an_error(spark):
    a = np.ones((2, 4, 4), int)
    both = [r for n in ("SEG", "SEG", "TRAB_MASK") for r in rows(n, a, (0, 0, 0))]
    results = G.measure_given(slices(spark, both).withColumnRenamed("name", "layer"), which=("TRAB_TH",))
    assert [r.note for r in results.collect()] == ["TRAB_TH: several files hold the SEG"]


def test_maps_apart_like_one_task(spark):
    """Every metric of the whole evaluation, with the maps drawn in tasks of their own."""
    from voxelweave.plans import catalog
    from voxelweave.plans.morphometry import Maps
    from voxelweave.plans.workflow import Evaluation, evaluate

    scan, contour, grid = catalog.cylinder(spark, "/root/testdata/sf0.001")
    small = Grid((14, 90, 90), grid.origin, grid.el)
    scan, contour = (df.where("z < 314").persist() for df in (scan, contour))
    none = spark.createDataFrame([("empty", 300, 200, 100, 1)], "vol_id string, z int, y int, x int, v int")
    p = Evaluation(compartments=catalog._SMALL, maps=Maps(which=("TRAB_TH", "CORT_TH", "TRAB_TH_old")))
    got, want = (sorted((r.vol_id, r.parameter, r.value, r.note) for r in f(scan.unionByName(none), contour, small, p).collect()) for f in (G.evaluate_apart, evaluate))
    assert [r[:2] for r in got] == [r[:2] for r in want] and ("empty", "error") in [r[:2] for r in got]
    assert all(a == b or a[2] == pytest.approx(b[2], rel=1e-12) for a, b in zip(got, want))
