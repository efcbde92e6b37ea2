import struct

import numpy as np
import pytest

from voxelweave import cli
from voxelweave.operators import contour
from voxelweave.operators.grid import Grid
from voxelweave.sources import images as I
from voxelweave.sources import records

RNG = np.random.default_rng(3)
GRID = Grid((3, 4, 5), (7, -2, 9), (0.0607, 0.06, 0.05))


def test_volume_round_trip():
    data = RNG.integers(0, 128, GRID.shape).astype(np.uint8)
    raw = I.encode_volume(data, I.new_header(GRID, "Mu_Scaling 8192"))
    image = I.decode_volume(raw)
    assert len(raw) % 512 == 0 and (image.data == data).all() and image.origin == GRID.origin and image.log == "Mu_Scaling 8192"
    assert np.allclose(image.el, GRID.el, atol=1e-8)


def test_run_lengths():
    values = np.repeat(np.array([0, 127, 0, 127], np.uint8), [300, 255, 10, 35])
    body = np.array([127, 0] + [0, 1], np.uint8)
    assert I.run_bits(np.array([0, 127, 255, 46, 255, 1, 10, 35], np.uint8), 600).tolist() == values.tolist()
    assert I.run_char(np.array([5, 3, 9, 2], np.uint8), 5).tolist() == [5, 5, 5, 9, 9]
    for bad in (lambda: I.run_char(body, 7), lambda: I.run_bits(body, 99)):
        with pytest.raises(ValueError):
            bad()


def test_vax():
    for v in (0.0, 1.0, -2.5, 0.0607, 8192.0, 1e-3):
        assert I.vax(I.to_vax(v)) == pytest.approx(v, rel=1e-7)


def test_version_030():
    data = RNG.integers(-500, 500, GRID.shape).astype(np.int16)
    fields = [0, 0, *GRID.origin[::-1], *GRID.shape[::-1], *[0] * 15, *[int(e * 1e6) for e in GRID.el[::-1]]]
    head = struct.pack(f"<{len(fields)}q", *fields)
    raw = I.VERSION_030.ljust(16, b"\0") + struct.pack("<5q", 40, len(head), 3, data.nbytes, 0) + head + b"log" + data.tobytes()
    image = I.decode_volume(raw)
    assert (image.data == data).all() and image.origin == GRID.origin and image.log == "log"
    bad = raw[:-data.nbytes] + data.tobytes()[:7]
    with pytest.raises(ValueError):
        I.decode_volume(bad)


@pytest.mark.parametrize("compress", [True, False])
def test_nrrd_and_nifti(compress):
    data = RNG.integers(-5, 5, GRID.shape).astype(np.int16)
    back, fields = I.decode_nrrd(I.encode_nrrd(data, GRID, {"Segment0_Name": "cort", "Segment0_LabelValue": "1"}, compress))
    assert (back == data).all() and I.nrrd_grid(back.shape, fields, GRID.el).origin == GRID.origin
    assert I.segments(fields) == {0: {"Name": "cort", "LabelValue": "1"}}
    back, grid = I.decode_nifti(I.encode_nifti(data, GRID, compress))
    assert (back == data).all() and grid.origin == GRID.origin and np.allclose(grid.el, GRID.el)


@pytest.mark.parametrize("change", [(b"little", b"big"), (b"gzip", b"bzip2"), (b"int16", b"quux"), (b"dimension: 3", b"data file: x"), (b"sizes: 5 4 3", b"sizes: 5 4"), (b"sizes: 5 4 3", b"sizes: 5 4 9")])
def test_nrrd_refusals(change):
    raw = I.encode_nrrd(np.zeros(GRID.shape, np.int16), GRID)
    raw = raw.replace(b"type: short", b"type: int16").replace(*change)
    with pytest.raises(ValueError):
        I.decode_nrrd(raw)


def test_nrrd_grids_refused():
    good = {"space": "left-posterior-superior", "space directions": "(1,0,0) (0,1,0) (0,0,1)", "space origin": "(0,0,0)"}
    for bad in ({"space": "scanner"}, {"space directions": "(1,0,0) (0,1,0)"}, {"space directions": "(0,1,0) (1,0,0) (0,0,1)"}, {"space origin": "(0.4,0,0)"}):
        with pytest.raises(ValueError):
            I.nrrd_grid((1, 1, 1), good | bad)
    with pytest.raises(ValueError):
        I.nrrd_grid((1, 1, 1), good, (2.0, 1.0, 1.0))


def test_contour_file():
    y, x = np.indices((30, 30))
    chain = contour.outlines((y - 15) ** 2 + (x - 15) ** 2 < 80)[0][0][1]
    codes = contour.chain_codes(chain)
    packed = I.pack_codes(codes)
    own = [0] * 17
    own[1], own[2], own[13], own[14], own[15], own[16] = 10, 20, chain[0][0], chain[0][1], len(codes) + 1, len(packed)
    raw = b"\0" * 512 + struct.pack("<14i", 1, 0, 0, 4, *[0] * 9, 1) + struct.pack("<17i", *own) + packed + b"\0" * 60
    (got,) = I.decode_contours(raw)
    assert got == {"z": 4, "contour": 0, "x0": 10 + chain[0][0], "y0": 20 + chain[0][1], "codes": codes}


def test_spark_readers(spark, tmp_path):
    data = np.zeros(GRID.shape, np.uint8)
    data[1, 2, 3] = 127
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.aim").write_bytes(I.encode_volume(data, I.new_header(GRID)))
    (folder / "b.nrrd").write_bytes(I.encode_nrrd(data, GRID))
    (folder / "c.nii.gz").write_bytes(I.encode_nifti(data, GRID))
    rows = I.voxels(I.read_volumes(spark, str(folder))).collect()
    assert sorted((r.z, r.y, r.x, r.v) for r in rows) == [(8, 0, 12, 127)] * 3
    files = records.inventory(spark, str(folder))
    assert files.count() == 3 and files.where("twins = 1").count() == 3
    states = records.compare_inventories(files.selectExpr("'x' as name", "sha256").limit(1), files.selectExpr("'y' as name", "sha256").limit(1))
    assert {r.state for r in states.collect()} == {"first only", "second only"}


def test_records_and_reports(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"id": "s1",\n "A": {"n": 3}}')
    (tmp_path / "r" / "b.json").write_text('{"id": "s2"}')
    got = records.read_records(spark, str(tmp_path / "r"), "id string, A struct<n: int>", ["s2"])
    assert [(r.id, r.A.n) for r in got.collect()] == [("s1", 3)]
    (tmp_path / "k.csv").write_text("id,v\na,1.5\nb,n/a\n")
    assert [(r.id, r.v) for r in records.read_keyed(spark, str(tmp_path / "k.csv"), "id", ["v"]).orderBy("id").collect()] == [("a", 1.5), ("b", None)]
    long = spark.createDataFrame([("s", "BV_TV", 0.25, None), ("s", "notes", None, "x")], "vol_id string, parameter string, value double, note string")
    records.write_report(long, str(tmp_path / "out"))
    assert '"BV_TV":"0.25"' in next((tmp_path / "out" / "json").glob("part-*")).read_text()
    assert "| BV_TV | 0.25 |" in records.markdown({"BV_TV": 0.25}, "s")
    v = spark.createDataFrame([("a", 3, 1), ("a", 3, 1), ("a", 2, 1), ("a", 2, 5)], "vol_id string, z int, v int")
    assert tuple(records.best_slice(v).first()) == ("a", 2, 2)


def test_exit_codes(capsys, tmp_path):
    assert cli.main(["version"]) == 0 and cli.main(["params", "--set", "compartments.sigma=1"]) == 0
    assert '"compartments.sigma": 1.0' in capsys.readouterr().out
    assert cli.main(["params", "--set", "compartments.sigm=1"]) == 2 and cli.main(["nonsense"]) == 2 and cli.main(["params", "--params", str(tmp_path / "no.json")]) == 2


def test_masks_onto_a_grid():
    at = np.array([[7, -2, 9], [50, 0, 10]])
    own = Grid((60, 9, 9), (0, -5, 5), GRID.el)
    inside, lost = I.onto_grid(at, own, GRID)
    assert inside.tolist() == [[7, -2, 9]] and lost == 1
    with pytest.raises(ValueError, match="do not meet"):
        I.onto_grid(at, Grid((1, 1, 1), (99, 0, 0), GRID.el), GRID)
    with pytest.raises(ValueError, match="do not match"):
        I.onto_grid(at, Grid((60, 9, 9), (0, 0, 0), (1.0, 1.0, 1.0)), GRID)


def test_segments():
    data = np.array([[[0, 1, 2]]])
    two = {"Segment0_Name": "cort", "Segment0_LabelValue": "1", "Segment1_Name": "trab", "Segment1_LabelValue": "2"}
    assert I.select_segment(data, two, "TRAB").ravel().tolist() == [False, False, True]
    assert I.select_segment(data, {}, label=1).sum() == 1 and I.select_segment(data, {}).sum() == 2
    assert I.select_segment(data, {"Segment0_Name": "x", "Segment0_LabelValue": "2"}).sum() == 1
    for bad in ({"fields": two}, {"fields": two, "name": "none"}):
        with pytest.raises(ValueError):
            I.select_segment(data, **bad)
    for name in ("a.nrrd", "a.nii.gz", "a.aim"):
        image = I.decode_any(name, I.encode_any(name, np.ones(GRID.shape, np.uint8), GRID))
        assert image.data.all() and image.origin == GRID.origin
