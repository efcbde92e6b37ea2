"""Records, keyed tables, inventories and report sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_records(spark: SparkSession, path: str, schema: str | T.StructType, excluded: list[str] | None = None, key: str = "id") -> DataFrame:
    """Nested JSON documents, one a file, with a set schema; excluded ids are left out."""
    out = spark.read.schema(schema).json(path, multiLine=True).withColumn("source_file", F.input_file_name())
    return out.where(~F.col(key).isin(excluded)) if excluded else out


def pooled_records(spark: SparkSession, folders: dict[str, str], schema: str | T.StructType, needed: str | None = None, excluded: list[str] | None = None, key: str = "id") -> DataFrame:
    """Records of several folders with the ``pool`` each is from; those without the ``needed`` part are left out.

    Of an id that several folders hold the one of the first folder stays.
    """
    found = None
    for place, (pool, path) in enumerate(folders.items()):
        own = read_records(spark, path, schema, excluded, key).withColumns({"pool": F.lit(pool), "__place": F.lit(place)})
        found = own if found is None else found.unionByName(own)
    if needed:
        found = found.where(F.col(needed).isNotNull())
    first = Window.partitionBy(key).orderBy("__place", "source_file")
    return found.withColumn("__first", F.row_number().over(first)).where("__first = 1").drop("__place", "__first")


def read_keyed(spark: SparkSession, path: str, key: str, numbers: list[str]) -> DataFrame:
    """A CSV table by key; what is no number becomes null."""
    raw = spark.read.csv(path, header=True)
    return raw.select(key, *[F.col(n).try_cast("double").alias(n) for n in numbers], *[c for c in raw.columns if c != key and c not in numbers])


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, length, sha256, twins``: every file, and how many share its size and content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    sums = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    twins = sums.groupBy("length", "sha256").agg(F.count("*").alias("twins"))
    return sums.join(twins, ["length", "sha256"]).select("path", "length", "sha256", "twins")


def compare_inventories(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    """Files by name: identical, different, or in one only."""
    both = a.select(name, F.col("sha256").alias("p")).join(b.select(name, F.col("sha256").alias("q")), name, "full")
    state = F.when(F.col("p").isNull(), "second only").when(F.col("q").isNull(), "first only").when(F.col("p") == F.col("q"), "identical").otherwise("different")
    return both.select(name, state.alias("state"))


def write_report(report: DataFrame, folder: str, key: str = "vol_id") -> None:
    """Long-form metrics as JSON documents and as a wide CSV."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("parameter", F.coalesce(F.col("value").cast("string"), F.col("note"))))))
    report.groupBy(key).agg(pairs.alias("metrics")).write.json(f"{folder}/json")
    report.groupBy(key).pivot("parameter").agg(F.first("value")).write.option("header", "true").csv(f"{folder}/csv")


def markdown(metrics: dict[str, object], title: str) -> str:
    """A table of parameters and values."""
    line = lambda v: f"{v:.6g}" if isinstance(v, float) else json.dumps(v) if isinstance(v, (list, dict)) else str(v)
    return "\n".join([f"# {title}", "", "| Parameter | Value |", "| --- | --- |", *[f"| {k} | {line(v)} |" for k, v in metrics.items()], ""])


def best_slice(voxels: DataFrame) -> DataFrame:
    """The slice of each volume with most set voxels; the lowest of equals."""
    counts = voxels.where("v <> 0").groupBy("vol_id", "z").agg(F.count("*").alias("n"))
    return counts.groupBy("vol_id").agg(F.max_by("z", F.struct("n", -F.col("z"))).alias("z"), F.max("n").alias("n"))
