"""The thin queries of the training-data operators, by name, and their DuckDB twins."""

from __future__ import annotations

from . import bpe, divergence, filters, lines, mixing, nndescent, pqdedup, quality, sharding, simhash, substring, tokenfile, topk
from .common import table


def op1_mixing(spark, sf_dir):
    """Sources mixed by bisected temperature, as scheduled rows.  Whole tables; nulls and ties as the operator's ``digest`` says."""
    return mixing.digest(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark, sf_dir):
    """Words of documents without what an earlier document repeats.  Whole tables; nulls and ties as the operator's ``digest`` says."""
    return substring.digest(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark, sf_dir):
    """Links and components of near-equal vectors.  Whole tables; nulls and ties as the operator's ``digest`` says."""
    return pqdedup.digest(table(spark, sf_dir, "embeddings"))


def op4_sharding(spark, sf_dir):
    """The shard of every document.  Whole tables; nulls and ties as the operator's ``digest`` says."""
    return sharding.digest(table(spark, sf_dir, "documents"))


def op5_bpe(spark, sf_dir):
    """Ids and decoded texts of every document, as hashes.  Whole tables; nulls and ties as the operator's ``digest`` says."""
    return bpe.digest(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    """Lines of documents without what an earlier document holds.  Whole tables; nulls and ties as the operator's ``digest`` says."""
    return lines.digest(table(spark, sf_dir, "documents"))


def op7_token_files(spark, sf_dir):
    """Spans of token files as they are read back.  Whole tables; nulls and ties as the operator's ``digest`` says."""
    return tokenfile.digest(table(spark, sf_dir, "documents"))


def op8_top_k(spark, sf_dir):
    """The ten highest scores of each query vector.  Whole tables; nulls and ties as the operator's ``digest`` says."""
    return topk.digest(table(spark, sf_dir, "embeddings"))


def op9_quality(spark, sf_dir):
    """The quality score of every document.  Whole tables; nulls and ties as the operator's ``digest`` says."""
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark, sf_dir):
    """Fingerprints and their groups.  Whole tables; nulls and ties as the operator's ``digest`` says."""
    return simhash.digest(table(spark, sf_dir, "documents"))


def op11_neighbours(spark, sf_dir):
    """Twenty near neighbours of each query vector.  Whole tables; nulls and ties as the operator's ``digest`` says."""
    return nndescent.digest(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark, sf_dir):
    """How the sources of each language differ.  Whole tables; nulls and ties as the operator's ``digest`` says."""
    return divergence.digest(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark, sf_dir):
    """What five filters remove in every order.  Whole tables; nulls and ties as the operator's ``digest`` says."""
    return filters.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries():
    """Every query of this module by name."""
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql():
    """The DuckDB form of the queries that SQL can say."""
    return {"op2_substring_dedup": substring.SQL, "op3_embedding_dedup": pqdedup.SQL, "op6_line_dedup": lines.SQL, "op8_top_k": topk.SQL, "op12_source_divergence": divergence.SQL, "op13_filter_audit": filters.SQL}
