"""Quality classifier (operator 9) by compression.

Two zstandard dictionaries are built from labelled text, one from good and one from bad
documents.  A text is compressed in independent chunks with either, and the difference of
the two sizes tells which kind it resembles.  It is normalised twice, by the text's length and
by the larger of the sizes; both are smoothed, so that a text of a few bytes, which says
nothing, has the mean difference.  A logistic calibration of the normalised difference, and of
nothing else, on labelled documents that are in neither dictionary gives the score.

The classifier is fitted on a bounded sample of labelled rows (``sample_rows`` of either
label, the first in the order of a hash of their id); every text of the training half is
in its dictionary, with an even share of its ``dict_bytes`` from the middle of what is left of the
whole text: a line that several texts of one label hold stays once, in the first of them, so
boilerplate is in the dictionary without filling it, and a line of both labels, which tells
nothing, is left out.  Everything is scored whole.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, prepare, tidied

#: Labelled rows of either label that are used at most.
SAMPLE_ROWS = 3000
#: Bytes of a dictionary, bytes of a chunk, and zstandard's level.
DICT_BYTES, CHUNK, LEVEL = 128 << 10, 1024, 6
#: Bytes that the mean difference counts for beside a text's own.
SMOOTH = 64


@dataclass(frozen=True)
class Model:
    bad: bytes
    good: bytes
    weights: tuple[float, ...]
    mean: tuple[float, float] = (0.0, 0.0)
    level: int = LEVEL
    chunk: int = CHUNK

    def compressors(self):
        out = []
        for content in (self.bad, self.good):
            known = zstandard.ZstdCompressionDict(content or b"\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=known, write_content_size=False, write_checksum=False))
        return out


def sizes(text: str, compressors, chunk: int = CHUNK) -> tuple[int, int, int]:
    """Compressed sizes with the bad and the good dictionary, and the text's own; frames' fixed heads left out."""
    raw = text.encode()
    parts = [raw[i : i + chunk] for i in range(0, len(raw), chunk)]
    a, b = (sum(len(c.compress(p)) for p in parts) - 6 * len(parts) for c in compressors)
    return a, b, len(raw)


def batch_sizes(texts: list[str | None], model: Model, compressors) -> np.ndarray:
    return np.array([sizes(t or "", compressors, model.chunk) for t in texts], np.float64).reshape(-1, 3)


def differences(found: np.ndarray, mean: tuple[float, float], smooth: int = SMOOTH) -> np.ndarray:
    """The size difference by the text's length and by the larger size, smoothed towards the means."""
    apart, most = found[:, 0] - found[:, 1], np.maximum(found[:, :2].max(axis=1, initial=0), 0)
    return np.column_stack([(apart + smooth * m) / np.maximum(base + smooth, 1) for m, base in zip(mean, (found[:, 2], most), strict=True)])


def calibrate(rows: np.ndarray, good: np.ndarray, ridge: float = 1e-3, weight: np.ndarray | None = None) -> tuple[float, ...]:
    """Weights of a logistic regression, the constant first, by Newton steps."""
    x = np.column_stack((np.ones(len(rows)), rows * 10))
    w, each = np.zeros(x.shape[1]), np.ones(len(rows)) if weight is None else weight
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (each * (p - good)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def score(model: Model, rows: np.ndarray) -> np.ndarray:
    w = np.asarray(model.weights)
    return 1 / (1 + np.exp(-np.clip(w[0] + (rows * 10) @ w[1:], -30, 30)))


def middle(raw: bytes, size: int) -> bytes:
    start = max(0, (len(raw) - size) // 2)
    return raw[start : start + size]


def even_share(sizes: list[int], total: int) -> int:
    """The largest equal limit under which all sizes, cut to it, fit the total; short ones leave theirs to the rest."""
    left, most = total, 0
    for k, n in enumerate(sorted(sizes)):
        most = max(0, left) // (len(sizes) - k)
        if n > most:
            return most
        left -= n
    return max(most, *sizes) if sizes else 0


def dictionary(pieces: list[bytes], dict_bytes: int = DICT_BYTES) -> bytes:
    """The middle of every piece, each with the same share of the dictionary's bytes."""
    pieces = [p for p in pieces if p]
    share = even_share([len(p) + 1 for p in pieces], dict_bytes + 1) - 1
    return b"\n".join(middle(p, share) for p in pieces)[:dict_bytes] if share > 0 else b""


def telling_lines(texts: DataFrame) -> DataFrame:
    """``__id, q, h, text``: the lines of ``texts`` that are in the dictionaries, those of a text put together again.

    Of equal lines of one label the first stays (by hash and id of the text, then by position), and
    of both labels none.  Texts without such a line are left out.
    """
    lines = texts.select("__id", "q", "h", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("key", F.xxhash64("line"))
    place = F.struct("h", "__id", "pos")
    rule = lines.groupBy("key").agg(F.min(place).alias("first"), F.min("q").alias("low"), F.max("q").alias("high")).where("low = high").select("key", "first")
    kept = lines.join(rule, "key").where(place == F.col("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return kept.groupBy("__id", "q", "h").agg(F.array_join(ordered, "\n").alias("text"))


def dictionaries(texts: DataFrame, dict_bytes: int) -> tuple[bytes, bytes]:
    """The dictionaries of bad and good ``texts(__id, q, h, text)``, by hash: from the middle of every text the same
    share, or all of it where it is shorter.

    The driver gets the texts' lengths, which are as many as labelled rows are sampled, and the shares.
    """
    own = cut(telling_lines(texts))
    lengths = own.select("q", F.octet_length("text").alias("n")).toArrow()
    label, n = (np.asarray(lengths.column(c)) for c in ("q", "n"))
    share = {q: even_share((n[(label == q) & (n > 0)] + 1).tolist(), dict_bytes + 1) - 1 for q in (0, 1)}

    def run(batches):
        for batch in batches:
            pieces = [middle(t.encode(), share[q]) for t, q in zip(batch.column("text").to_pylist(), batch.column("q").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("__id", "q", "h")), pa.array(pieces, pa.binary())], ["__id", "q", "h", "piece"])

    # With a dictionary of fewer bytes than texts no text has a share, and the dictionary is empty.
    pieces = own.where(F.octet_length("text") > 0).where(F.col("q").isin([q for q in (0, 1) if share[q] > 0])).select(F.col("__id").cast("long").alias("__id"), F.col("q").cast("int").alias("q"), "h", "text").mapInArrow(tidied(run), "__id long, q int, h long, piece binary")
    rows = pieces.toArrow().sort_by([("h", "ascending"), ("__id", "ascending")]).to_pylist()
    drop_cut(own)
    return tuple(dictionary([r["piece"] for r in rows if r["q"] == q], dict_bytes) for q in (0, 1))


def held_out(id_: Column) -> Column:
    """Rows whose labels are never looked at: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, dict_bytes: int = DICT_BYTES) -> Model:
    """Fit a model on labelled rows that are not held out, at most ``sample_rows`` of either label.

    About half of them are in the dictionaries of ``dict_bytes`` each, every text with an even
    share (see ``dictionaries``); the others calibrate.  Labels other than 0 and 1, null ids, ids with both labels and labels without a
    document are left out.  With no label of one kind the score is the constant share of
    good labels (one added to either count).
    """
    spark = docs.sparkSession
    prepare(spark)
    known = labels.where(~held_out(labels[id_col]) & labels[label_col].isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("q"), F.max(label_col).alias("__q")).where("q = __q").drop("__q")
    known = known.withColumn("h", F.xxhash64("__id"))
    picked = known.where("q = 0").orderBy("h", "__id").limit(sample_rows).unionByName(known.where("q = 1").orderBy("h", "__id").limit(sample_rows))
    picked = cut(picked)
    labelled = {r["q"]: r["count"] for r in known.groupBy("q").count().collect()}  # two rows
    sample = cut(docs.select(docs[id_col].alias("__id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "__id"))  # at most twice sample_rows
    half = (F.shiftrightunsigned("h", 7) % 2) == 0
    taken = {r["q"]: r["count"] for r in sample.where(half).groupBy("q").count().collect()}  # two rows
    bad, good = dictionaries(sample.where(half), dict_bytes)
    model = Model(bad, good, ())

    def run(batches):
        own = model.compressors()
        for batch in batches:
            x = batch_sizes(batch.column("text").to_pylist(), model, own)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("q"), *(pa.array(x[:, k]) for k in range(3))], ["__id", "q", "bad", "good", "own"])

    rows = sample.where(~half).select(F.col("__id").cast("long").alias("__id"), F.col("q").cast("int").alias("q"), "text").mapInArrow(tidied(run), "__id long, q int, bad double, good double, own double").toArrow().sort_by([(c, "ascending") for c in ("__id", "bad", "good", "own")])
    for t in (picked, sample):
        drop_cut(t)
    q = np.asarray(rows.column("q")).astype(float)
    if len(set(q.tolist())) < 2 or not bad or not good:
        share = (taken.get(1, 0) + q.sum() + 1) / (sum(taken.values()) + len(q) + 2)
        return Model(bad, good, (float(np.log(share / (1 - share))), 0.0, 0.0))
    found = np.column_stack([np.asarray(rows.column(c)) for c in ("bad", "good", "own")])
    # Either label counts as much as among all labelled rows, not as in the sample.
    weight = np.where(q == 1, labelled[1] / q.sum(), labelled[0] / (1 - q).sum())
    weight *= len(q) / weight.sum()
    mean = tuple(np.average(differences(found, (0.0, 0.0)), axis=0, weights=weight).tolist())
    return Model(bad, good, calibrate(differences(found, mean), q, weight=weight), mean)


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher is better) and ``predicted`` (1 from 0.5 on).

    A null text is scored as an empty one, which has the mean difference.  Columns of these
    names are replaced; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    kind = docs.select(*rest).withColumns({"score": F.lit(None).cast("double"), "predicted": F.lit(None).cast("int")}).schema

    def run(batches):
        own = model.compressors()
        for batch in batches:
            s = score(model, differences(batch_sizes(batch.column(rest.index(text_col)).to_pylist(), model, own), model.mean))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*rest, "score", "predicted"])

    return docs.select(*rest).mapInArrow(tidied(run), kind)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns: ``doc_id``, whether its label is ``held_out``, ``score`` and ``predicted``."""
    out = classify(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def crc_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3
