"""What the training-data operators share: tables, row keys, cut lineage, bounded joins."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators: null sorts after every id.
NO_ID = (1 << 63) - 1
#: Rows of a narrow side (ids, hashes) that may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of long texts must fit beside the executor's heap.

    The session keeps these two settings, as what the operators return runs later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "160")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def tidied(run):
    """``run`` over Arrow batches, then what its task no longer needs goes back to the system: Python
    workers serve later stages too, beside the executor's heap."""

    def tidy_run(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return tidy_run


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and all tasks run here."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "voxelweave-shared")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/voxelweave/{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the files behind a table made by ``cut`` once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(conf).delete(path, True)


def row_id(docs: DataFrame, id_col: str = "doc_id") -> Column:
    return F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``did`` (null: last), ``rk`` (tells texts of one id apart) and ``text`` (null: empty)."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(row_id(docs, id_col).alias("did"), F.xxhash64(text).alias("rk"), text.alias("text"))


def public_id(name: str = "did") -> Column:
    """The id as it came in."""
    return F.when(F.col(name) != NO_ID, F.col(name))


def fits(side: DataFrame, rows: int | None = None) -> bool:
    """Whether ``side`` (a table on disk: counting it is cheap) has at most ``rows`` (BROADCAST_ROWS) rows."""
    rows = BROADCAST_ROWS if rows is None else rows
    return side.limit(rows + 1).count() <= rows


def small(side: DataFrame, rows: int | None = None) -> DataFrame:
    """``side`` with a broadcast hint if it has at most ``rows`` (BROADCAST_ROWS) rows, else as it is."""
    return F.broadcast(side) if fits(side, rows) else side


def with_side(docs: DataFrame, side: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """``docs`` LEFT JOIN ``side``, shuffling only the rows of ``docs`` that have a match.

    ``side`` is a table on disk with unique keys.  If it has at most ``rows`` rows its
    keys are broadcast, which splits ``docs`` without a shuffle; else one left join does.
    """
    if not fits(side, rows):
        return docs.join(side, keys, "left")
    ids = F.broadcast(side.select(*keys))
    new = [c for c in side.columns if c not in keys]
    hit = docs.join(ids, keys, "left_semi").join(side.hint("shuffle_hash"), keys)
    miss = docs.join(ids, keys, "left_anti").select("*", *[F.lit(None).cast(side.schema[c].dataType).alias(c) for c in new])
    return hit.select(*docs.columns, *new).unionByName(miss)
