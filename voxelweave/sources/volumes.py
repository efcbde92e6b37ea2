"""Volumes and contours as Spark data sources: ``spark.read.format("volume")`` and ``df.write.format("volume")``.

Reading, a file whose voxels lie uncompressed is dealt into byte ranges like any splittable
file; each task reads the header and then only the slices that start in its range.  Filters on
``vol_id`` (the file's path below the folder, without its ending) leave files out before any is
opened, and filters on ``z`` leave slices out before they are read.  Coded files are one task.

Writing, the slices of a volume, which must be in one task in the order of ``z`` (``write_volumes``
sees to that), become one file.  Tasks write into a folder of their own attempt and hand their names to
the driver, which moves the files of all tasks to their places once every task is done; what
a lost or failed task has written is removed and never seen.

Both go through Arrow's file systems (local or shared folders, HDFS, object stores).  For stores
that only Spark reaches there is ``images.read_volumes``, which loads whole files.
"""

from __future__ import annotations

import fnmatch
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from ..operators.grid import AXES, KEYS, Grid
from . import images as I

SLICES = "vol_id string, path string, z int, oy int, ox int, ny int, nx int, ez double, ey double, ex double, dtype string, log string, data binary"
CONTOURS = "vol_id string, path string, z int, contour int, x0 int, y0 int, codes array<int>"
#: Bytes of a file that one task reads, and of slices that go to Spark at a time.
SPLIT_BYTES, SEND_BYTES = 64 << 20, 4 << 20
#: Bytes in which the header of a text-headed file is looked for.
HEAD_BYTES = 1 << 16
ENDINGS = (".seg.nrrd", ".nii.gz", ".nrrd", ".nii", ".aim", ".gobj")


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = path[5:] if not path.startswith("file://") else path[7:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def stem(name: str) -> str:
    """A file's name without the ending of its format."""
    for ending in ENDINGS:
        if name.lower().endswith(ending):
            return name[: -len(ending)]
    return name


# ---- where the slices of a file are


@dataclass(frozen=True)
class Layout:
    """The header of a file whose voxels lie one after the other from ``start`` on."""

    dtype: np.dtype
    shape: tuple[int, int, int]
    origin: tuple[int, int, int]
    el: tuple[float, float, float]
    log: str
    start: int

    @property
    def plane(self) -> int:
        return self.dtype.itemsize * self.shape[1] * self.shape[2]


def layout(name: str, read, size: int) -> Layout | None:
    """Where the voxels of a file are (``read(offset, bytes)``); None if they are coded and it must be read whole."""
    lower = name.lower()
    if lower.endswith(".nii.gz"):
        return None
    if lower.endswith(".nrrd"):
        head, found, _ = read(0, min(size, HEAD_BYTES)).partition(b"\n\n")
        lines = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").splitlines() if ": " in line and ":=" not in line)
        if not found or lines.get("encoding") != "raw" or len(lines.get("sizes", "").split()) != 3:
            return None
        # The checks of the whole-file reader hold: it is asked with a body that is as long as needed but never read.
        shape = tuple(int(s) for s in lines["sizes"].split())[::-1]
        if lines.get("type") not in I._TYPES or lines.get("endian", "little") != "little" or any(lines.get(k, "0") != "0" for k in ("data file", "datafile", "line skip", "byte skip")):
            return None
        kind = np.dtype("<" + I._TYPES[lines["type"]])
        if size - len(head) - 2 < int(np.prod(shape)) * kind.itemsize:
            raise ValueError("NRRD: the body is too short")
        grid = I.nrrd_grid(shape, lines)
        return Layout(kind, shape, grid.origin, grid.el, "", len(head) + 2)
    if lower.endswith(".nii"):
        data, grid = I.decode_nifti_head(read(0, min(size, 352)))
        return Layout(data[0], grid.shape, grid.origin, grid.el, "", data[1])
    first = read(0, min(size, 56))
    wide = first[:12] == I.VERSION_030
    sizes = struct.unpack_from("<5q" if wide else "<5i", first, 16 if wide else 0)
    head = (16 if wide else 20) + (sizes[0] if wide else 0) + sizes[1] + sizes[2]
    raw = read(0, head)
    kind, shape, origin, el, log = I.volume_head(raw, size - head)
    return None if kind is None else Layout(kind, shape, origin, el, log, head)


# ---- reading


@dataclass
class Split(InputPartition):
    path: str
    vol_id: str
    low: int
    high: int

    def __init__(self, path: str, vol_id: str, low: int, high: int):
        self.path, self.vol_id, self.low, self.high = path, vol_id, low, high


class _FileReader(DataSourceReader):
    """Files under a folder; filters on ``vol_id`` and ``z``."""

    endings: tuple[str, ...] = ENDINGS[:-1]

    def __init__(self, options: dict[str, str]):
        self.path, self.glob = options["path"], options.get("pathglobfilter", "*")
        self.deep = options.get("recursivefilelookup", "false").lower() == "true"
        self.bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.names: set[str] | None = None
        self.low, self.high = -(1 << 31), (1 << 31) - 1

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("vol_id",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            elif isinstance(f, EqualTo) and f.attribute == ("z",):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("z",):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual) and f.attribute == ("z",):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            elif not (isinstance(f, IsNotNull) and f.attribute in (("vol_id",), ("z",))):
                yield f

    def partitions(self) -> list[Split]:
        fs, top = store(self.path)
        kind = fs.get_file_info(top).type
        found = fs.get_file_info(pafs.FileSelector(top, recursive=self.deep)) if kind == pafs.FileType.Directory else [fs.get_file_info(top)]
        if kind == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        out = []
        for f in sorted(found, key=lambda f: f.path):
            below = f.path[len(top) :].lstrip("/") or f.base_name
            hidden = any(part.startswith(("_", ".")) for part in below.split("/"))
            if f.type != pafs.FileType.File or hidden or not fnmatch.fnmatch(f.base_name, self.glob) or not f.base_name.lower().endswith(self.endings):
                continue
            if self.names is None or stem(below) in self.names:
                out += [Split(f.path, stem(below), k, min(k + self.bytes, f.size)) for k in range(0, max(1, f.size), self.bytes)]
        return out or [Split("", "", 0, 0)]  # Spark wants a task even where no file is left


class VolumeReader(_FileReader):
    def _rows(self, split: Split, head, ks: list[int], planes) -> pa.RecordBatch:
        (oz, oy, ox), (ez, ey, ex), n = head.origin, head.el, len(ks)
        same = lambda v, kind: pa.array([v] * n, kind)
        i32, f64 = pa.int32(), pa.float64()
        return pa.RecordBatch.from_arrays(
            [same(split.vol_id, pa.string()), same(split.path, pa.string()), pa.array([oz + k for k in ks], i32), same(oy, i32), same(ox, i32), same(head.shape[1], i32), same(head.shape[2], i32),
             same(ez, f64), same(ey, f64), same(ex, f64), same(head.dtype.str.lstrip("<|="), pa.string()), pa.array([head.log if k == 0 else "" for k in ks]), pa.array(planes, pa.binary())],
            [c.split()[0] for c in SLICES.split(", ")],
        )

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = store(self.path)
        with fs.open_input_file(partition.path) as file:
            size = file.size()
            head = layout(partition.path, lambda at, n: file.read_at(n, at), size)
            whole = None
            if head is None:
                if partition.low:  # the first task of a coded file reads all of it
                    return
                image = I.decode_any(partition.path, file.read_at(size, 0))
                whole = image.data
                head = Layout(whole.dtype, whole.shape, image.origin, image.el, image.log, 0)
            first, last = max(0, self.low - head.origin[0]), min(head.shape[0], self.high - head.origin[0] + 1)
            if whole is None and head.plane:
                first = max(first, -(-(partition.low - head.start) // head.plane))
                last = min(last, -(-(partition.high - head.start) // head.plane))
            step = max(1, SEND_BYTES // max(1, head.plane))
            for k in range(first, last, step):
                ks = list(range(k, min(k + step, last)))
                if whole is not None:
                    planes = [np.ascontiguousarray(whole[i]).tobytes() for i in ks]
                else:
                    raw = file.read_at(head.plane * len(ks), head.start + k * head.plane)
                    planes = [raw[i * head.plane : (i + 1) * head.plane] for i in range(len(ks))]
                yield self._rows(partition, head, ks, planes)


class ContourReader(_FileReader):
    endings = (".gobj",)

    def partitions(self) -> list[Split]:
        return [s for s in super().partitions() if not s.low]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = store(self.path)
        with fs.open_input_file(partition.path) as file:
            rows = [r for r in I.decode_contours(file.read_at(file.size(), 0)) if self.low <= r["z"] <= self.high]
        for at in range(0, len(rows), 1000):
            some = rows[at : at + 1000]
            columns = [pa.array([v] * len(some), pa.string()) for v in (partition.vol_id, partition.path)]
            columns += [pa.array([r[c] for r in some], pa.int32()) for c in ("z", "contour", "x0", "y0")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r["codes"] for r in some], pa.list_(pa.int32()))], [c.split()[0] for c in CONTOURS.split(", ")])


# ---- writing


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # the file as it was written, and its name


class VolumeWriter(DataSourceArrowWriter):
    """One file a volume; the names are those of ``vol_id`` with the ending."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.ending = options["path"], options.get("ending", "aim")
        self.overwrite = overwrite
        self.names = [n for n in options.get("segments", "").split(",") if n]
        self.job = uuid.uuid4().hex
        if f".{self.ending}" not in ENDINGS[:-1]:
            raise ValueError(f"unknown ending {self.ending!r}")

    @property
    def _own(self) -> str:
        return f"{store(self.path)[1].rstrip('/')}/_temporary-{self.job}"

    def _encoded(self, rows: list[dict]) -> bytes:
        first = rows[0]
        box = [first[c] for c in ("oy", "ox", "ny", "nx")]
        for k, r in enumerate(rows):
            if r["z"] != first["z"] + k or [r[c] for c in ("oy", "ox", "ny", "nx")] != box or r["dtype"] != first["dtype"]:
                raise ValueError(f"{r['vol_id']}: slice {r['z']} does not follow, or is of another box or type")
        shape, kind = (len(rows), first["ny"], first["nx"]), np.dtype("<" + first["dtype"])
        data = np.zeros(shape, kind)
        for k, r in enumerate(rows):
            if r["data"] is not None:  # no data: all zero
                data[k] = np.frombuffer(r["data"], kind).reshape(shape[1:])
        grid = Grid(shape, (first["z"], first["oy"], first["ox"]), (first["ez"], first["ey"], first["ex"]))
        if self.ending.endswith("nrrd"):
            extra = {f"Segment{k}_{f}": str(v) for k, n in enumerate(self.names) for f, v in (("ID", n), ("Name", n), ("LabelValue", k + 1))}
            return I.encode_nrrd(data, grid, extra)
        if self.ending != "aim":
            return I.encode_nifti(data, grid, self.ending.endswith("gz"))
        log = first["log"] or ""
        return I.encode_volume(data, I.new_header(grid, log)) if kind.itemsize == 1 else I.encode_volume_030(data, grid, log)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, _ = store(self.path)
        folder = f"{self._own}/{uuid.uuid4().hex}"  # of this attempt
        files: list[tuple[str, str]] = []
        held: list[dict] = []
        done: set[str] = set()

        def close() -> None:
            name = held[0]["vol_id"]
            if name in done or any(p in ("", ".", "..") for p in name.split("/")):
                raise ValueError(f"the slices of {name!r} are not together, or it cannot be a file's name")
            done.add(name)
            temp = f"{folder}/{len(files)}"
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(temp) as out:
                out.write(self._encoded(held))
            files.append((temp, f"{name}.{self.ending}"))
            held.clear()

        for batch in iterator:
            for r in batch.to_pylist():
                if held and held[0]["vol_id"] != r["vol_id"]:
                    close()
                held.append(r)
        if held:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = store(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("slices of one volume are in several tasks: deal them out by vol_id")
        if self.overwrite and fs.get_file_info(top).type == pafs.FileType.Directory:
            for f in fs.get_file_info(pafs.FileSelector(top, recursive=True)):
                if f.type == pafs.FileType.File and not f.path.startswith(self._own) and f.base_name.lower().endswith(ENDINGS):
                    fs.delete_file(f.path)
        for temp, name in files:
            target = f"{top.rstrip('/')}/{name}"
            fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
            fs.move(temp, target)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = store(self.path)
        if fs.get_file_info(self._own).type == pafs.FileType.Directory:
            fs.delete_dir(self._own)


# ---- registration


class VolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return SLICES

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(self.options)

    def writer(self, schema, overwrite: bool) -> VolumeWriter:
        return VolumeWriter(self.options, overwrite)


class ContourSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "contours"

    def schema(self) -> str:
        return CONTOURS

    def reader(self, schema) -> ContourReader:
        return ContourReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    """The session, with the formats ``volume`` and ``contours`` and filters handed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VolumeSource)
    spark.dataSource.register(ContourSource)
    return spark


def planes(voxels: DataFrame, grid: Grid, dtype: str = "i2", log: str = "") -> DataFrame:
    """Slice rows of every volume of a voxel table on one grid; slices that hold nothing have no data.

    Voxels outside the grid are left out, like those of value zero.
    """
    (oz, oy, ox), (nz, ny, nx) = grid.origin, grid.shape
    inside = voxels.where(" AND ".join(f"{a} >= {o} AND {a} < {o + n}" for a, o, n in zip(AXES, grid.origin, grid.shape, strict=True)))

    def run(key, table):
        data = np.zeros((ny, nx), "<" + dtype)
        data[np.asarray(table.column("y")) - oy, np.asarray(table.column("x")) - ox] = np.asarray(table.column("v"))
        return pa.table({"vol_id": [key[0].as_py()], "z": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([data.tobytes()], pa.binary())})

    held = inside.select(*KEYS, F.col("v").cast("int").alias("v")).groupBy("vol_id", "z").applyInArrow(run, "vol_id string, z int, data binary")
    every = voxels.select("vol_id").distinct().withColumn("z", F.explode(F.sequence(F.lit(oz), F.lit(oz + nz - 1))))
    fixed = {"path": F.lit(None).cast("string"), **{c: F.lit(v).cast("int") for c, v in (("oy", oy), ("ox", ox), ("ny", ny), ("nx", nx))}, **{c: F.lit(float(v)) for c, v in zip(("ez", "ey", "ex"), grid.el)}, "dtype": F.lit(dtype), "log": F.when(F.col("z") == oz, F.lit(log)).otherwise(F.lit(""))}
    return every.join(held, ["vol_id", "z"], "left").withColumns(fixed).select(*[c.split()[0] for c in SLICES.split(", ")])


def write_volumes(slices: DataFrame, path: str, ending: str = "aim", segments: tuple[str, ...] = (), mode: str = "append") -> None:
    """A file for each volume of slice rows (``SLICES``), written by the executors.

    The slices of a volume must follow each other without a gap and have one box and type; a task
    holds one volume at a time.  An empty table writes nothing.
    """
    register(slices.sparkSession)
    dealt = slices.select(*[c.split()[0] for c in SLICES.split(", ")]).repartition("vol_id").sortWithinPartitions("vol_id", "z")
    dealt.write.format("volume").option("ending", ending).option("segments", ",".join(segments)).mode(mode).save(path)
