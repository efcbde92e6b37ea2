"""A training corpus from ``documents``: classify, dedup lines and documents, mix, encode.

Each stage works on the whole table its predecessor kept.  All but the last return the
columns of documents; the last adds the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.llm import bpe, lines, mixing, quality, simhash
from voxelweave.llm.common import cut, table

#: Sources are repeated up to so many times, and every document is used at least once.
MAX_EPOCHS = 1.5


def _with_text(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of documents, with ``n_chars`` of the text as it is now."""
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out.select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; a null text is judged as an empty one."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).where("predicted = 1").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document that loses all stays, empty."""
    return _with_text(docs, lines.drop_repeated_lines(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest id.

    SimHash sketches of five-word shingles find the candidates, and whole sets of a similarity
    of 0.8 or more are linked.
    """
    return simhash.keep_first(docs, words=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Smaller sources are repeated, up to the limit; no document is lost.  Tokens are words here."""
    return mixing.schedule(docs, max_epochs=MAX_EPOCHS, whole=True)[0].select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text (null: none), and whether they decode to the text again (all do)."""
    out = bpe.encode(docs, decoded_col="decoded")
    back = F.coalesce("text", F.lit("")) == F.col("decoded")
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", back.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", token_stage),
]

#: Classifier, fingerprints and merges are not SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again.  No document gives no row."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
