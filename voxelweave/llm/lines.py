"""Line dedup (operator 6): lines that several documents share stay in the first one only.

All of it is DataFrame functions.  Lines are exploded and their normalised keys hashed to
128 bits; one aggregation finds the keys that enough documents hold and the first of
them; the lines to drop come back as positions for each document, which is put together
again around them.  Only hashes, ids and positions are dealt out, and only the texts that
lose a line meet a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, prepare, row_id, small, with_side

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space around it and with A-Z lower-cased."""
    bare = F.btrim(line, F.lit(_SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.withColumns({"__did": row_id(docs, id_col), "__rk": F.xxhash64(text), "__text": text})


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``(__did, __rk, drops)``: the sorted positions of the lines each text loses."""
    lines = _with_keys(docs, id_col, text_col).select("__did", "__rk", F.posexplode(F.split("__text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    lines = lines.select("__did", "__rk", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    if min_docs <= 2:
        held = lines.groupBy("h1", "h2").agg(F.min("__did").alias("first"), F.max("__did").alias("last"))
        held = held.where("first < last" if min_docs == 2 else "true").drop("last")
    else:
        held = lines.select("h1", "h2", "__did").distinct().groupBy("h1", "h2").agg(F.min("__did").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs).drop("n")
    held = cut(held)
    lost = lines.join(small(held), ["h1", "h2"]).where("__did > first")
    out = cut(lost.groupBy("__did", "__rk").agg(F.array_sort(F.collect_set("pos")).alias("drops")))
    drop_cut(held)
    return out


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` without the lines that an earlier document holds; adds ``n_lines``, ``n_dropped``.

    A line's key counts from ``min_chars`` code points; a key found in ``min_docs``
    documents stays only in the smallest id that holds it (there, all its lines).  Lines
    are split at ``\\n`` alone.  A null or empty text is one empty line, and comes out
    empty if null.  A null id is larger than any other, and rows with one id are one
    document.  Columns named ``n_lines`` or ``n_dropped`` are replaced, others stay.
    """
    prepare(docs.sparkSession)
    side = repeated_lines(docs, id_col, text_col, min_chars, min_docs)
    out = with_side(_with_keys(docs, id_col, text_col), side, ["__did", "__rk"])
    lines, bounds = F.split("__text", "\n", -1), F.col("__bounds")
    parts = F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), lambda k: F.slice(lines, F.get(bounds, k) + 2, F.get(bounds, k + 1) - F.get(bounds, k) - 1))
    out = out.withColumn("n_lines", F.size(lines).cast("long"))
    out = out.withColumn("n_dropped", F.when(F.col("drops").isNull(), F.lit(0)).otherwise(F.size("drops")).cast("long"))
    out = out.withColumn("__bounds", F.concat(F.array(F.lit(-1)), F.col("drops"), F.array(F.col("n_lines").cast("int"))))
    out = out.withColumn(text_col, F.when(F.col("drops").isNull(), F.col("__text")).otherwise(F.array_join(F.flatten(parts), "\n")))
    return out.select(*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: ``doc_id``, ``n_lines``, ``n_dropped`` and the hash of the kept lines."""
    out = drop_repeated_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '%s', '%s') AS key FROM l),
held AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id > held.first, false) AS dropped FROM k LEFT JOIN held USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
""" % (_UPPER, _LOWER)
