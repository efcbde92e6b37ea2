"""Volumes and contours as data sources: splits, pushed filters, files written by tasks."""

import numpy as np
import pytest

from voxelweave.operators.grid import Grid
from voxelweave.sources import images as I
from voxelweave.sources import volumes as S

GRID = Grid((7, 5, 6), (3, -2, 10), (0.06069973, 0.06069973, 0.06069973))


def data(seed=0, kind=np.int16):
    rng = np.random.default_rng(seed)
    return (rng.integers(-50, 50, GRID.shape) * (rng.random(GRID.shape) < 0.5)).astype(kind)


def encode(ending, a):
    if ending == "aim":
        return I.encode_volume_030(a, GRID, "log of it")
    return I.encode_nrrd(a, GRID, compress=False) if ending == "nrrd" else I.encode_nrrd(a, GRID) if ending == "seg.nrrd" else I.encode_nifti(a, GRID, ending.endswith("gz"))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("volumes")
    (top / "sub").mkdir()
    for k, ending in enumerate(("aim", "nrrd", "seg.nrrd", "nii", "nii.gz")):
        (top / ("sub" if k == 3 else "") / f"v{k}.{ending}").write_bytes(encode(ending, data(k)))
    (top / "old.aim").write_bytes(I.encode_volume(data(9, np.uint8), I.new_header(GRID, "old")))
    (top / "_hidden.aim").write_bytes(b"no volume")
    (top / "notes.txt").write_text("no volume")
    return str(top)


def load(spark, folder, **options):
    return S.register(spark).read.format("volume").options(recursiveFileLookup="true", **options).load(folder)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vol_id, {})[r.z] = np.frombuffer(r.data, "<" + r.dtype if r.dtype != "u1" else r.dtype).reshape(r.ny, r.nx)
    return out


@pytest.mark.parametrize("split", [1 << 20, 100, 33])
def test_every_slice_once_at_any_split(spark, folder, split):
    rows = load(spark, folder, splitBytes=str(split))
    got = found(rows)
    want = {f"{'sub/' if k == 3 else ''}v{k}": data(k) for k in range(5)} | {"old": data(9, np.uint8)}
    assert rows.count() == 6 * GRID.shape[0] and got.keys() == want.keys()
    for name, a in want.items():
        assert [z for z in sorted(got[name])] == list(range(3, 10))
        assert all((got[name][3 + k] == a[k]).all() for k in range(7))
    head = rows.where("vol_id = 'v0' and z = 3").first()
    assert (head.oy, head.ox, head.ny, head.nx, head.log) == (-2, 10, 5, 6, "log of it") and abs(head.ez - GRID.el[0]) < 1e-6


def test_filters_are_pushed(spark, folder, capsys):
    rows = load(spark, folder, splitBytes="60").where("z >= 4 and z < 7 and vol_id in ('v0', 'v1', 'nothing') and ny > 0")
    rows.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(z,4)" in plan.replace(" ", "") or "z >= 4" in plan or "PushedFilters" in plan
    got = found(rows)
    assert {n: sorted(s) for n, s in got.items()} == {"v0": [4, 5, 6], "v1": [4, 5, 6]}
    assert load(spark, folder).where("vol_id = 'none'").count() == 0


def test_reader_reads_only_what_is_asked(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThan

    class Counted(S.VolumeReader):
        pass

    reader = Counted({"path": folder, "splitbytes": "1000000"})
    other = EqualTo(("ny",), 3)
    left = list(reader.pushFilters([EqualTo(("vol_id",), "v0"), In(("vol_id",), ("v0", "v1")), GreaterThan(("z",), 4), LessThan(("z",), 7), IsNotNull(("z",)), other]))
    assert left == [other] and (reader.low, reader.high, reader.names) == (5, 6, {"v0"})
    splits = reader.partitions()
    assert [s.vol_id for s in splits] == ["v0"]
    assert [z for b in reader.read(splits[0]) for z in b.column("z").to_pylist()] == [5, 6]
    nothing = Counted({"path": folder})
    list(nothing.pushFilters([EqualTo(("vol_id",), "x")]))
    assert list(nothing.read(nothing.partitions()[0])) == []


@pytest.mark.parametrize("ending", ["aim", "nii", "nii.gz", "nrrd", "seg.nrrd"])
@pytest.mark.parametrize("kind", ["u1", "i2"])
def test_written_and_read_back(spark, tmp_path, ending, kind):
    rows = [(f"scan{n}", 3 + int(z), int(y) - 2, int(x) + 10, int(a[z, y, x])) for n in range(3) for a in [np.abs(data(n))] for z, y, x in np.argwhere(a)]
    voxels = spark.createDataFrame(rows, "vol_id string, z int, y int, x int, v int")
    out = str(tmp_path / "out")
    S.write_volumes(S.planes(voxels, GRID, kind, "a log"), out, ending, ("cort", "trab") if ending == "seg.nrrd" else ())
    back = S.register(spark).read.format("volume").load(out)
    assert sorted(map(tuple, I.voxels(back, "vol_id").collect())) == sorted(rows)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"scan{n}.{ending}" for n in range(3)]
    if ending == "seg.nrrd":
        fields = I.decode_nrrd((tmp_path / "out" / "scan0.seg.nrrd").read_bytes())[1]
        assert fields["Segment1_Name"] == "trab"
    if ending == "aim":
        assert back.where("z = 3").first().log == "a log"


def slices(n=2, z=(0, 1, 2)):
    return [(f"v{k}", None, i, 0, 0, 2, 2, 1.0, 1.0, 1.0, "u1", "", bytes([k, i, 0, 1])) for k in range(n) for i in z]


def test_overwrite_keeps_other_files_and_failed_writes_leave_none(spark, tmp_path):
    out = tmp_path / "out"
    S.write_volumes(spark.createDataFrame(slices(), S.SLICES), str(out))
    (out / "keep.txt").write_text("x")
    with pytest.raises(Exception, match="does not follow"):
        S.write_volumes(spark.createDataFrame(slices(3, (0, 2)), S.SLICES), str(out), mode="overwrite")
    assert sorted(p.name for p in out.iterdir()) == ["keep.txt", "v0.aim", "v1.aim"]
    S.write_volumes(spark.createDataFrame(slices(1), S.SLICES), str(out), mode="overwrite")
    assert sorted(p.name for p in out.iterdir()) == ["keep.txt", "v0.aim"]
    S.write_volumes(spark.createDataFrame([], S.SLICES), str(tmp_path / "none"))


def test_a_lost_task_is_never_seen(tmp_path):
    """The first attempt of a task dies half way: only what a committed attempt wrote gets to its place."""
    import pyarrow as pa

    out = tmp_path / "out"
    writer = S.VolumeWriter({"path": str(out), "ending": "aim"}, False)
    names = [c.split()[0] for c in S.SLICES.split(", ")]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in slices()])

    def dies():
        yield batch
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(dies())
    done = writer.write(iter([batch]))
    assert all("_temporary-" in temp for temp, _ in done.files)
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit([done, done])
    assert not any(p.suffix == ".aim" for p in out.rglob("*"))
    writer.commit([writer.write(iter([batch])), None])
    assert sorted(p.name for p in out.iterdir()) == ["v0.aim", "v1.aim"]


def test_contours(spark, tmp_path):
    chains = [{"z": z, "x0": 3, "y0": 4, "codes": [0, 6, 4, 2]} for z in range(5)]
    (tmp_path / "a.gobj").write_bytes(I.encode_contours(chains))
    rows = S.register(spark).read.format("contours").load(str(tmp_path)).where("z between 1 and 2 and vol_id = 'a'")
    assert sorted((r.vol_id, r.z, r.x0, r.y0, r.codes[:4]) for r in rows.collect()) == [("a", z, 3, 4, [0, 6, 4, 2]) for z in (1, 2)]


def test_paths():
    assert S.store("file:/a/b")[1] == S.store("file:///a/b")[1] == S.store("/a/b")[1] == "/a/b"
    assert [S.stem(n) for n in ("a.seg.nrrd", "b.nii.gz", "C.AIM", "d.txt")] == ["a", "b", "C", "d.txt"]
