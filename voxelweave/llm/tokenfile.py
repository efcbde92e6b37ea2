"""Token-ID output (operator 7): independent zstandard frames with a trailing seek table.

A file is, in this order,

* one zstandard frame for each document, with content size and checksum, that holds its
  ids as little-endian unsigned 32-bit integers;
* a skippable frame with the seek table: for each document its id, the length of its
  frame, its number of ids and their crc32, then the number of documents, the length of
  the table and a crc32 of the table;
* after each of these an empty skippable frame of eight bytes.

So a file is a row of valid zstandard frames, which any decoder can read from the start,
and a reader that wants some documents reads the end, then only their frames.  Files are
written through Spark's own text writer (its line separator is the empty frame), so they
reach every store that Spark reaches, under its commit protocol: a task that is lost and
run again leaves one file.  Files hold ascending ranges of ids; ``index_files`` writes which,
and a reader that wants some documents then opens only the files that can hold them.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec, larger, vocabulary_path
from .common import cut, drop_cut, prepare, public_id, row_id, shared_dir, small, tidied

#: Fixed values of the format: magic numbers and fields.
SKIP_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
EMPTY_FRAME = struct.pack("<II", SKIP_MAGIC, 0)
ENTRY = np.dtype([("did", "<i8"), ("size", "<u4"), ("n_tokens", "<u4"), ("crc32", "<u4")])
TAIL = struct.Struct("<QQI")
#: Bytes of text a file holds on average, at least and at most (from some 20,000 files on it
#: grows with the input), which bounds what a task keeps.
FILE_BYTES, MOST_FILE_BYTES, FILES = 24_000_000, 128_000_000, 20_000
#: Files whose sums one task adds up.
FILE_GROUP = 1024


def pack(documents: Iterable[tuple[int, bytes]], level: int = 1) -> Iterator[bytes]:
    """Frames of ``(id, ids as bytes)`` in the given order, then the seek table."""
    press = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    entries = []
    for did, ids in documents:
        frame = press.compress(ids)
        entries.append((did, len(frame), len(ids) // 4, zlib.crc32(ids)))
        yield frame
    table = np.array(entries, ENTRY).tobytes()
    body = table + TAIL.pack(len(entries), len(table), zlib.crc32(table))
    yield struct.pack("<II", TABLE_MAGIC, len(body)) + body


class Reader:
    """Random access to a file of the format through any seekable binary file object."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, io.SEEK_END)
        back = TAIL.size + len(EMPTY_FRAME)
        if end < back:
            raise ValueError("not a token file: too short")
        file.seek(end - back)
        last = file.read(back)
        if last[TAIL.size :] != EMPTY_FRAME:
            raise ValueError("not a token file: no end mark")
        count, size, crc = TAIL.unpack(last[: TAIL.size])
        if size != count * ENTRY.itemsize or size > end - back:
            raise ValueError("token file: the seek table is damaged")
        file.seek(end - back - size)
        table = file.read(size)
        if zlib.crc32(table) != crc:
            raise ValueError("token file: the seek table is damaged")
        self.table = np.frombuffer(table, ENTRY)
        sizes = self.table["size"].astype(np.int64) + len(EMPTY_FRAME)
        self.offsets = np.cumsum(sizes) - sizes
        self._open = zstandard.ZstdDecompressor()

    def ids(self, place: int) -> np.ndarray:
        """Ids of the document in that place of the table; checksums are verified."""
        entry = self.table[place]
        self.file.seek(int(self.offsets[place]))
        raw = self._open.decompress(self.file.read(int(entry["size"])))
        if len(raw) != 4 * int(entry["n_tokens"]) or zlib.crc32(raw) != int(entry["crc32"]):
            raise ValueError(f"token file: document {entry['did']} is damaged")
        return np.frombuffer(raw, "<u4")

    def checksums(self) -> np.ndarray:
        """crc32 of the ids of every document, each decompressed and verified."""
        self.file.seek(0)
        whole, out = memoryview(self.file.read()), np.empty(len(self.table), np.int64)
        rows = zip(self.offsets.tolist(), *(self.table[c].tolist() for c in ("size", "n_tokens", "crc32", "did")), strict=True)
        for k, (at, size, n, crc, did) in enumerate(rows):
            raw = self._open.decompress(whole[at : at + size])
            out[k] = zlib.crc32(raw)
            if len(raw) != 4 * n or out[k] != crc:
                raise ValueError(f"token file: document {did} is damaged")
        return out

    def find(self, wanted) -> np.ndarray:
        """Places of the wanted ids."""
        return np.flatnonzero(np.isin(self.table["did"], np.asarray(list(wanted), np.int64)))


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, files: int | None = None) -> str:
    """Encode every whole text (null: empty), append ``end_id`` and write token files.

    Documents come in ascending id order, over all files in the order of their numbers;
    documents of equal ids in the order of a hash of their texts, so they need not share a
    task; a null id is last.  An empty table gives no document.  Other columns are not read.
    """
    prepare(docs.sparkSession)
    path = path or vocabulary_path()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(row_id(docs, id_col).alias("did"), F.xxhash64(text).alias("h"), text.alias("text"))
    if files is None:
        total = docs.select(F.sum(F.octet_length(docs[text_col].cast("string")).cast("long"))).first()[0] or 0
        files = 1 + total // max(FILE_BYTES, min(MOST_FILE_BYTES, total // FILES))

    def run(batches):
        own, mark = codec(path, False), struct.pack("<I", end_id)
        documents = ((d, t + mark) for b in larger(batches) for d, t in zip(b.column("did").to_pylist(), own.encode_all(b.column("text").to_pylist())))
        held, size = [], 0
        for part in pack(documents):
            held.append(part)
            size += len(part)
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["part"])
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["part"])

    out = rows.repartitionByRange(files, "did", "h").sortWithinPartitions("did", "h").select("did", "text").mapInArrow(tidied(run), "part binary")
    out.select(F.col("part").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME.decode("latin-1")).option("encoding", "UTF-8").text(folder)
    return folder


def _contents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(paths).select("path", "content").where("length(content) > 0")


def _number() -> Column:
    """A file's number, by which its documents stand among all files'."""
    return F.regexp_extract("file", r"part-(\d+)[^/]*$", 1).cast("long")


def index_files(spark: SparkSession, folder: str) -> DataFrame:
    """Write and return ``(file, first, last, documents, n_tokens)`` of each file with documents, from its seek table."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                table = Reader(io.BytesIO(content.as_buffer())).table
                if len(table):
                    values = [name, int(table["did"].min()), int(table["did"].max()), len(table), int(table["n_tokens"].sum(dtype=np.int64))]
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["file", "first", "last", "documents", "n_tokens"])

    _contents(spark, folder).mapInArrow(tidied(run), "file string, first long, last long, documents long, n_tokens long").write.mode("overwrite").parquet(f"{folder}/_index")
    return spark.read.parquet(f"{folder}/_index")


def _indexed(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_index/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_tokens(spark: SparkSession, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """``(did, file, place, n_tokens, ids)`` of all documents, or of the wanted ids only.

    Only the frames that are asked for are decompressed, and after ``index_files`` only files
    whose range holds a wanted id are opened; a damaged frame raises.  A null id is read
    as the largest long.
    """
    prepare(spark)
    paths: str | list[str] = folder
    if wanted is not None and _indexed(spark, folder):
        ids = spark.createDataFrame([(int(i),) for i in wanted], "did long")  # the caller's own list
        ranges = spark.read.parquet(f"{folder}/_index")
        paths = [r.file for r in ranges.join(F.broadcast(ids), ids["did"].between(ranges["first"], ranges["last"]), "left_semi").select("file").collect()]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                reader = Reader(io.BytesIO(content.as_buffer()))
                places = range(len(reader.table)) if wanted is None else reader.find(wanted).tolist()
                for k in range(0, len(places), 256):
                    some = list(places[k : k + 256])
                    ids = [reader.ids(p).astype(np.int64) for p in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.table["did"][some]), pa.array([name] * len(some)), pa.array(some, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int64()))],
                        ["did", "file", "place", "n_tokens", "ids"],
                    )

    kind = "did long, file string, place long, n_tokens long, ids array<long>"
    return _contents(spark, paths).mapInArrow(tidied(run), kind) if paths else spark.createDataFrame([], kind)


def index_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``(did, start, n_tokens, ids_crc32)`` of each document, from the files alone.

    Every frame is read and verified.  ``start`` is the number of ids before it over all
    files: a running sum inside each file, and the sums of the files before it, which are
    added up in groups of files and then over these.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                reader = Reader(io.BytesIO(content.as_buffer()))
                n = len(reader.table)
                crcs = reader.checksums()
                counts = reader.table["n_tokens"].astype(np.int64)
                for k in range(0, n, 50_000):
                    s = slice(k, k + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(reader.table["did"][s]), pa.array([name] * len(counts[s])), pa.array((np.cumsum(counts) - counts)[s]), pa.array(counts[s]), pa.array(crcs[s])], ["did", "file", "before", "n_tokens", "ids_crc32"])

    rows = cut(_contents(spark, folder).mapInArrow(tidied(run), "did long, file string, before long, n_tokens long, ids_crc32 long").withColumn("number", _number()).drop("file"))
    sums = cut(rows.groupBy("number").agg(F.sum("n_tokens").alias("n")).withColumn("part", F.floor(F.col("number") / FILE_GROUP)))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.groupBy("part").agg(F.sum("n").alias("n")).select("part", ahead(Window.orderBy("part")).alias("base"))  # a row for each 1,024 files
    starts = cut(sums.withColumn("own", ahead(Window.partitionBy("part").orderBy("number"))).join(F.broadcast(parts), "part").select("number", (F.col("base") + F.col("own")).alias("base")))
    out = rows.join(small(starts), "number").select("did", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    drop_cut(sums)
    return out


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns of the files that are written and read back: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    spark = docs.sparkSession
    folder = write_tokens(docs, f"{shared_dir(spark)}/voxelweave/tokens-{uuid.uuid4().hex}")
    return index_tokens(spark, folder).select(public_id().alias("doc_id"), "start", "n_tokens", "ids_crc32")
