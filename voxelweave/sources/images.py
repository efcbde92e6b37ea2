"""Image files: scanner volumes, contour files, NRRD and NIfTI, from and to bytes.

Files are read with Spark's ``binaryFile`` source (so from any store) and decoded in
Arrow functions, one row for each slice or contour.
"""

from __future__ import annotations

import gzip
import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.grid import Grid

#: Fixed values of the scanner's volume format: value types, and the nominal voxel in mm (x, y, z).
CHAR, SHORT, RUN_CHAR, RUN_BITS = 0x00010001, 0x00020002, 0x00080002, 0x00150001
NOMINAL = (139852.0 / 2304.0 / 1000.0, 139852.0 / 2304.0 / 1000.0, 30592.0 / 504.0 / 1000.0)
VERSION_030 = b"AIMDATA_V030"


@dataclass
class Image:
    data: np.ndarray  # (z, y, x)
    origin: tuple[int, int, int]  # z, y, x
    el: tuple[float, float, float]  # z, y, x in mm
    log: str = ""
    header: bytes = b""

    @property
    def grid(self) -> Grid:
        return Grid(self.data.shape, self.origin, self.el)


def run_char(body: np.ndarray, voxels: int) -> np.ndarray:
    """Pairs of value and count."""
    n = len(body) // 2
    counts = body[1 : 2 * n : 2].astype(np.int64)
    if counts.sum() != voxels:
        raise ValueError("run lengths do not match the number of voxels")
    return np.repeat(body[0 : 2 * n : 2], counts)


def run_bits(body: np.ndarray, voxels: int) -> np.ndarray:
    """Two values, then lengths of runs in turn; 255 stands for 254 without a change."""
    lengths = body[2:].astype(np.int64)
    long_ = lengths == 255
    changes = np.cumsum(~long_) - ~long_
    counts = np.where(long_, 254, lengths)
    if counts.sum() != voxels:
        raise ValueError("run lengths do not match the number of voxels")
    return np.repeat(body[:2][changes & 1], counts)


def vax(u: int) -> float:
    low, high = u & 0xFFFF, (u >> 16) & 0xFFFF
    power = low >> 7 & 0xFF
    value = (0.5 + ((low & 0x7F) << 16 | high) / 2.0**24) * 2.0 ** (power - 128)
    return 0.0 if power == 0 else -value if low >> 15 else value


def to_vax(value: float) -> int:
    """The nearest representable field."""
    if value == 0:
        return 0
    part, power = np.frexp(abs(value))
    bits = int(round((float(part) - 0.5) * 2**24))
    return (int(value < 0) << 15 | (int(power) + 128) << 7 | bits >> 16) | (bits & 0xFFFF) << 16


def _sizes(el) -> tuple[float, float, float]:
    good = all(0.001 < e < 10.0 for e in el)
    return tuple((el if good else NOMINAL)[::-1])


def volume_head(raw: bytes, body: int):
    """``(type, shape, origin, voxel size, log)`` of a scanner volume of either version, axes z, y, x.

    ``raw`` is everything before the body of ``body`` bytes.  The type is None if voxels are run-length coded.
    """
    if raw[:12] == VERSION_030:
        sizes = struct.unpack_from("<5q", raw, 16)
        head = 16 + sizes[0]
        fields = struct.unpack_from(f"<{sizes[1] // 8}q", raw, head)
        pos, dim, el = fields[2:5], fields[5:8], [f / 1e6 for f in fields[23:26]]
        body, voxels = min(body, sizes[3]), dim[0] * dim[1] * dim[2]
        kinds = {4: "<f4", 2: "<i2", 1: "u1"}
        if voxels == 0 or body % voxels or body // voxels not in kinds:
            raise ValueError(f"{body} bytes for {voxels} voxels: unknown value type")
        kind = kinds[body // voxels]
    else:
        head, sizes = 20, struct.unpack_from("<5i", raw)
        fields = struct.unpack_from(f"<{sizes[1] // 4}i", raw, head)
        code, pos, dim, el = fields[5], fields[6:9], fields[9:12], [vax(f) for f in fields[27:30]]
        body, voxels = min(body, sizes[3]), dim[0] * dim[1] * dim[2]
        kind = {CHAR: "u1", SHORT: "<i2", RUN_CHAR: None, RUN_BITS: None}.get(code, "")
        if kind == "" and body != 4 * voxels:
            raise ValueError(f"unknown value type 0x{code & 0xFFFFFFFF:08x}")
        kind = "<f4" if kind == "" else kind
    log = raw[head + sizes[1] : head + sizes[1] + sizes[2]].decode("latin-1")
    return kind and np.dtype(kind), tuple(dim[::-1]), tuple(pos[::-1]), _sizes(el), log


def decode_volume(raw: bytes) -> Image:
    """A scanner volume of either version."""
    wide = raw[:12] == VERSION_030
    sizes = struct.unpack_from("<5q" if wide else "<5i", raw, 16 if wide else 0)
    start = (16 + sizes[0] if wide else 20) + sizes[1] + sizes[2]
    kind, shape, origin, el, log = volume_head(raw[:start], len(raw) - start)
    body, voxels = np.frombuffer(raw[start : start + sizes[3]], np.uint8), shape[0] * shape[1] * shape[2]
    if kind is not None:
        values = body[: voxels * kind.itemsize].view(kind)
    else:
        values = (run_char if struct.unpack_from("<i", raw, 40)[0] == RUN_CHAR else run_bits)(body, voxels)
    return Image(values.reshape(shape), origin, el, log, raw[:start])


def encode_volume(data: np.ndarray, template: bytes, pad: bool = True) -> bytes:
    """One byte for each voxel behind the header of another file of the older version."""
    head = bytearray(template)
    body = np.ascontiguousarray(data, np.uint8).tobytes()
    struct.pack_into("<i", head, 20 + 4 * 5, CHAR)
    struct.pack_into("<i", head, 12, len(body))
    return bytes(head) + body + (b"\0" * (-(len(head) + len(body)) % 512) if pad else b"")


def new_header(grid: Grid, log: str = "") -> bytes:
    """A header of the older version for a grid."""
    text = log.encode("latin-1")
    fields = [0] * 35
    fields[5], fields[6:9], fields[9:12] = CHAR, grid.origin[::-1], grid.shape[::-1]
    fields[27:30] = [v - (1 << 32) if (v := to_vax(e)) >= 1 << 31 else v for e in grid.el[::-1]]
    return struct.pack("<5i", 20, 4 * len(fields), len(text), 0, 0) + struct.pack(f"<{len(fields)}i", *fields) + text


def encode_volume_030(data: np.ndarray, grid: Grid, log: str = "") -> bytes:
    """A volume of the newer version: one, two or four bytes a voxel; sizes in millionths of a mm."""
    fields = [0, 0, *grid.origin[::-1], *grid.shape[::-1], *[0] * 15, *[round(e * 1e6) for e in grid.el[::-1]]]
    head, text, body = struct.pack(f"<{len(fields)}q", *fields), log.encode("latin-1"), np.ascontiguousarray(data).tobytes()
    return VERSION_030.ljust(16, b"\0") + struct.pack("<5q", 40, len(head), len(text), len(body), 0) + head + text + body


# ---- contour files


def decode_contours(raw: bytes) -> list[dict]:
    """``z, contour, x0, y0, codes`` of every contour of a contour file."""
    out, at = [], 512
    while at + 56 <= len(raw):
        head = struct.unpack_from("<14i", raw, at)
        at += 56
        for k in range(head[13]):
            own = struct.unpack_from("<17i", raw, at)
            at += 68
            bits = np.unpackbits(np.frombuffer(raw, np.uint8, own[16], at), bitorder="little")
            at += own[16]
            n = own[15] - 1
            codes = bits[: 3 * n].reshape(n, 3) @ np.array([1, 2, 4])
            out.append({"z": head[3], "contour": k, "x0": own[1] + own[13], "y0": own[2] + own[14], "codes": codes.tolist()})
    return out


def encode_contours(contours: list[dict]) -> bytes:
    """A contour file of ``z, x0, y0, codes``, slices in order."""
    out = [b"\0" * 512]
    for z in sorted({c["z"] for c in contours}):
        own = [c for c in contours if c["z"] == z]
        out.append(struct.pack("<14i", 1, 0, 0, z, *[0] * 9, len(own)))
        for c in own:
            packed = pack_codes(c["codes"])
            fields = [0] * 17
            fields[13], fields[14], fields[15], fields[16] = c["x0"], c["y0"], len(c["codes"]) + 1, len(packed)
            out += [struct.pack("<17i", *fields), packed]
    return b"".join(out)


def pack_codes(codes: list[int]) -> bytes:
    """Three bits for each code, least bit first."""
    bits = np.array([[c & 1, c >> 1 & 1, c >> 2 & 1] for c in codes], np.uint8).ravel()
    return np.packbits(bits, bitorder="little").tobytes()


# ---- NRRD


#: NRRD type names and element types.
_TYPES = {"uchar": "u1", "unsigned char": "u1", "uint8": "u1", "signed char": "i1", "int8": "i1", "short": "i2", "int16": "i2", "ushort": "u2", "unsigned short": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "double": "f8"}


def decode_nrrd(raw: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """``(data, fields)``: (z, y, x), or (z, y, x, list) with one list axis; attached and little-endian."""
    if not raw.startswith(b"NRRD"):
        raise ValueError("not an NRRD file")
    head, _, body = raw.partition(b"\n\n")
    fields = {}
    for line in head.decode("utf-8", "replace").splitlines()[1:]:
        if line and not line.startswith("#"):
            m = re.match(r"([^:]+):=(.*)|([^:]+):\s*(.*)", line)
            if m:
                fields[(m[1] or m[3]).strip()] = (m[2] if m[1] else m[4]).strip()
    for name in ("data file", "datafile", "line skip", "byte skip"):
        if name in fields and fields[name] != "0":
            raise ValueError(f"NRRD: {name} is not supported")
    if fields.get("endian", "little") != "little":
        raise ValueError("NRRD: big endian is not supported")
    coding = fields.get("encoding", "")
    if coding not in ("raw", "gzip", "gz"):
        raise ValueError(f"NRRD: encoding {coding!r} is not supported")
    if fields.get("type") not in _TYPES:
        raise ValueError(f"NRRD: unknown type {fields.get('type')!r}")
    sizes = [int(s) for s in fields.get("sizes", "").split()]
    if len(sizes) not in (3, 4):
        raise ValueError(f"NRRD: {len(sizes)} dimensions are not supported")
    if coding != "raw":
        body = gzip.decompress(body)
    kind = np.dtype("<" + _TYPES[fields["type"]])
    need = int(np.prod(sizes)) * kind.itemsize
    if len(body) < need:
        raise ValueError("NRRD: the body is too short")
    data = np.frombuffer(body[:need], kind).reshape(sizes[::-1])
    if len(sizes) == 4:
        lists = [k for k, word in enumerate(fields.get("kinds", "").split()) if word not in ("domain", "space")]
        if len(lists) != 1:
            raise ValueError("NRRD: four dimensions need one list axis")
        data = np.moveaxis(data, 3 - lists[0], -1)
    return data, fields


def encode_nrrd(data: np.ndarray, grid: Grid, extra: dict[str, str] | None = None, compress: bool = True) -> bytes:
    """A volume in left-posterior-superior space with its segment fields."""
    name = {v: k for k, v in reversed(_TYPES.items())}[data.dtype.str.lstrip("<|=")]
    for key, value in (extra or {}).items():
        if not re.fullmatch(r"[^:\n]+", key) or "\n" in value:
            raise ValueError(f"NRRD: bad key {key!r}")
    ez, ey, ex = grid.el
    lines = ["NRRD0004", f"type: {name}", "dimension: 3", "space: left-posterior-superior", "sizes: " + " ".join(map(str, data.shape[::-1])), f"space directions: ({ex!r},0,0) (0,{ey!r},0) (0,0,{ez!r})", "kinds: domain domain domain", "endian: little", f"encoding: {'gzip' if compress else 'raw'}", "space origin: (" + ",".join(repr(o * e) for o, e in zip(grid.origin[::-1], grid.el[::-1], strict=True)) + ")"]
    lines += [f"{k}:={v}" for k, v in (extra or {}).items()]
    body = np.ascontiguousarray(data).tobytes()
    return "\n".join(lines).encode() + b"\n\n" + (gzip.compress(body, mtime=0) if compress else body)


def nrrd_grid(shape, fields: dict[str, str], el: tuple[float, float, float] | None = None) -> Grid:
    """The grid in left-posterior-superior voxels; directions must be along the axes."""
    space = fields.get("space", "").lower()
    flips = {"left-posterior-superior": (1, 1, 1), "lps": (1, 1, 1), "right-anterior-superior": (-1, -1, 1), "ras": (-1, -1, 1), "left-anterior-superior": (1, -1, 1), "las": (1, -1, 1)}
    if space not in flips:
        raise ValueError(f"NRRD: space {space!r} is not anatomical")
    vectors = [tuple(float(c) for c in v.split(",")) for v in re.findall(r"\(([^)]*)\)", fields.get("space directions", ""))]
    origin = [float(c) for c in re.findall(r"\(([^)]*)\)", fields.get("space origin", "(0,0,0)"))[0].split(",")]
    if len(vectors) != 3:
        raise ValueError("NRRD: three directions are needed")
    sizes = []
    for k, v in enumerate(vectors):
        v = [c * f for c, f in zip(v, flips[space], strict=True)]
        if v[k] <= 0 or any(abs(c) > 1e-5 * abs(v[k]) for i, c in enumerate(v) if i != k):
            raise ValueError("NRRD: directions are not along the axes")
        sizes.append(v[k])
    if el is not None and any(abs(s - e) > 1e-5 * e for s, e in zip(sizes, el[::-1], strict=True)):
        raise ValueError(f"voxels of {sizes} mm do not match the scan's {el[::-1]}")
    at = [o * f / s for o, f, s in zip(origin, flips[space], sizes, strict=True)]
    if any(abs(a - round(a)) > 1e-3 for a in at):
        raise ValueError("the origin does not lie on the scan's voxels")
    return Grid(tuple(shape), tuple(round(a) for a in at[::-1]), tuple(sizes[::-1]))


def segments(fields: dict[str, str]) -> dict[int, dict[str, str]]:
    """Fields of each segment by its number."""
    out: dict[int, dict[str, str]] = {}
    for key, value in fields.items():
        if m := re.fullmatch(r"Segment(\d+)_(.*)", key):
            out.setdefault(int(m[1]), {})[m[2]] = value
    return out


# ---- NIfTI


#: NIfTI data type codes.
_CODES = {"u1": 2, "i2": 4, "i4": 8, "f4": 16, "f8": 64, "i1": 256, "u2": 512, "u4": 768}


def encode_nifti(data: np.ndarray, grid: Grid, compress: bool = True) -> bytes:
    """A single-file volume; its affine maps voxels to right-anterior-superior mm."""
    kind = data.dtype.str.lstrip("<|=")
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *data.shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, _CODES[kind], data.dtype.itemsize * 8)
    ez, ey, ex = grid.el
    struct.pack_into("<8f", head, 76, 1, ex, ey, ez, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[123] = 2
    struct.pack_into("<2h", head, 252, 0, 1)
    oz, oy, ox = (o * e for o, e in zip(grid.origin, grid.el, strict=True))
    struct.pack_into("<12f", head, 280, -ex, 0, 0, -ox, 0, -ey, 0, -oy, 0, 0, ez, oz)
    head[344:348] = b"n+1\0"
    raw = bytes(head) + np.ascontiguousarray(data).tobytes()
    return gzip.compress(raw, mtime=0) if compress else raw


def decode_nifti_head(raw: bytes) -> tuple[tuple[np.dtype, int], Grid]:
    """Type and place of the voxels, and their grid, from a header of 348 bytes."""
    if struct.unpack_from("<i", raw)[0] != 348:
        raise ValueError("not a little-endian NIfTI file")
    n, *dim = struct.unpack_from("<8h", raw, 40)
    kinds = {v: k for k, v in _CODES.items()}
    code = struct.unpack_from("<h", raw, 70)[0]
    if n != 3 or code not in kinds:
        raise ValueError(f"NIfTI: {n} dimensions of type {code} are not supported")
    start = int(struct.unpack_from("<f", raw, 108)[0])
    rows = np.array(struct.unpack_from("<12f", raw, 280)).reshape(3, 4)
    el = np.abs(rows[[0, 1, 2], [0, 1, 2]])
    at = [int(round(float(r) / e)) for r, e in zip((-rows[0, 3], -rows[1, 3], rows[2, 3]), el, strict=True)]
    return (np.dtype("<" + kinds[code]), start), Grid(tuple(dim[:3][::-1]), tuple(at[::-1]), tuple(float(e) for e in el[::-1]))


def decode_nifti(raw: bytes) -> tuple[np.ndarray, Grid]:
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    (kind, start), grid = decode_nifti_head(raw)
    return np.frombuffer(raw, kind, int(np.prod(grid.shape)), start).reshape(grid.shape), grid


# ---- Spark


VOLUME_ROWS = "path string, z int, oy int, ox int, ny int, nx int, ez double, ey double, ex double, dtype string, log string, data binary"


def put(spark: SparkSession, path: str, raw: bytes) -> None:
    """Write one file, through Hadoop, so to any store."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def read_volumes(spark: SparkSession, path: str, glob: str = "*", deep: bool = False) -> DataFrame:
    """One row for each slice of each scanner, NRRD or NIfTI volume under ``path`` (``deep``: and its subfolders)."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                image = decode_any(name, content)
                kind = image.data.dtype.str.lstrip("<|=")
                (oz, oy, ox), (ez, ey, ex) = image.origin, image.el
                rows = [(name, oz + k, oy, ox, *plane.shape, ez, ey, ex, kind, image.log if k == 0 else "", np.ascontiguousarray(plane).tobytes()) for k, plane in enumerate(image.data)]
                yield _slice_batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(deep).lower()).load(path)
    return files.select("path", "content").mapInArrow(run, VOLUME_ROWS)


def read_segments(spark: SparkSession, path: str, name: str | None = None, label: int | None = None, glob: str = "*") -> DataFrame:
    """Slices (1 where set) of one segment of each NRRD file under ``path``, chosen as by ``select_segment``."""

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                data, fields = decode_nrrd(content)
                grid = nrrd_grid(data.shape[:3], fields)
                on = select_segment(data, fields, name, label).astype(np.uint8)
                (oz, oy, ox), (ez, ey, ex) = grid.origin, grid.el
                rows = [(file, oz + k, oy, ox, *plane.shape, ez, ey, ex, "u1", "", np.ascontiguousarray(plane).tobytes()) for k, plane in enumerate(on)]
                yield _slice_batch(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInArrow(run, VOLUME_ROWS)


def _slice_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int32()] * 5, *[pa.float64()] * 3, pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in VOLUME_ROWS.split(", ")])


def decode_any(name: str, content: bytes) -> Image:
    lower = name.lower()
    if lower.endswith(".nrrd"):
        data, fields = decode_nrrd(content)
        grid = nrrd_grid(data.shape[:3], fields)
        return Image(data, grid.origin, grid.el)
    if lower.endswith((".nii", ".nii.gz")):
        data, grid = decode_nifti(content)
        return Image(data, grid.origin, grid.el)
    return decode_volume(content)


def voxels(slices: DataFrame, vol_id: str = "path") -> DataFrame:
    """The voxel table of slice rows: every value that is not zero."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                plane = np.frombuffer(r["data"], r["dtype"]).reshape(r["ny"], r["nx"])
                y, x = np.nonzero(plane)
                n = len(y)
                yield pa.RecordBatch.from_arrays([pa.array([str(r[vol_id])] * n, pa.string()), pa.array([r["z"]] * n, pa.int32()), pa.array((y + r["oy"]).astype(np.int32)), pa.array((x + r["ox"]).astype(np.int32)), pa.array(plane[y, x].astype(np.int32))], ["vol_id", "z", "y", "x", "v"])

    return slices.mapInArrow(run, "vol_id string, z int, y int, x int, v int")


def read_contours(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, z, contour, x0, y0, codes`` of all contour files under ``path``."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = decode_contours(content)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *[pa.array([r[c] for r in rows], pa.int32()) for c in ("z", "contour", "x0", "y0")], pa.array([r["codes"] for r in rows], pa.list_(pa.int32()))], ["path", "z", "contour", "x0", "y0", "codes"])

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInArrow(run, "path string, z int, contour int, x0 int, y0 int, codes array<int>")


def onto_grid(at: np.ndarray, own: Grid, onto: Grid) -> tuple[np.ndarray, int]:
    """Set positions (n, 3) of a mask on its own grid, those on the scan's, and how many are lost.

    Grids of other voxel sizes, and grids that do not meet, are refused.
    """
    if any(abs(a - b) > 1e-5 * b for a, b in zip(own.el, onto.el, strict=True)):
        raise ValueError(f"voxels of {own.el} mm do not match the scan's {onto.el}")
    if any(a >= d or b <= c for a, b, c, d in zip(own.origin, own.end, onto.origin, onto.end, strict=True)):
        raise ValueError("the mask's grid and the scan's do not meet")
    inside = ((at >= onto.origin) & (at < onto.end)).all(axis=1)
    return at[inside], int((~inside).sum())


def select_segment(data: np.ndarray, fields: dict[str, str], name: str | None = None, label: int | None = None) -> np.ndarray:
    """A mask from a label volume: by the start of a segment's name, by label, the only
    segment, the two labels of a compartment map, or else what is not zero."""
    if label is not None:
        return data == label
    known = segments(fields)
    if name is not None:
        hits = [s for s in known.values() if s.get("Name", "").lower().startswith(name.lower())]
        if len(hits) != 1:
            raise ValueError(f"{len(hits)} segments are named {name!r}")
        return data == int(hits[0].get("LabelValue", 1))
    if len(known) == 1:
        return data == int(next(iter(known.values())).get("LabelValue", 1))
    if len(known) > 1:
        raise ValueError("several segments: give a name or a label")
    return data != 0


def encode_any(name: str, data: np.ndarray, grid: Grid, template: bytes | None = None) -> bytes:
    """A volume in the format that the name's ending asks for."""
    lower = name.lower()
    if lower.endswith(".nrrd"):
        return encode_nrrd(data, grid)
    if lower.endswith((".nii", ".nii.gz")):
        return encode_nifti(data, grid, lower.endswith("gz"))
    return encode_volume(data, template or new_header(grid))
