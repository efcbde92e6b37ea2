"""Which variant of the segmentation made a scan's files, read from logs, with the lines that say so.

A segmentation's own processing log decides where there is one.  Otherwise the transcripts of its
evaluation runs are read command by command, the run is chosen by what the delivered files' logs and
time stamps say for and against each, and what that run does not decide keeps its default.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import run_scores


@dataclass(frozen=True)
class Commands:
    """The commands of a transcript, and the end of the trabecular contour's file name."""

    filter: str = "fft_laplace_hamming"
    fill: str = "fill_offset_duplicate"
    mask: str = "gobj_maskaimpeel_ow"
    extract: str = "cl_nr_extract"
    trabecular: str = "_trab_mask.gobj"


@dataclass(frozen=True)
class Entries:
    """The same steps as entries of a processing log, and its labelling."""

    fill: str = "D3P_FillOffsetDuplicate"
    mask: str = "D3P_GobjOrAimMaskAimPeel_OW"
    extract: str = "D3P_Cl_ExtractNumber_CPP"
    label: str = "D3P_Cl_Label_CPP"


FACTS = {"border": "duplicate", "order": "periosteal_first", "trab_mask": "gobj"}


def transcript_variants(blocks: DataFrame, *keys: str, commands: Commands | None = None) -> DataFrame:
    """``keys, log, run, border, order, trab_mask`` and the lines behind them, for each log of ``blocks``.

    ``blocks(keys, log, run, line, name, ok, input, gobj)``: the commands of transcripts.  The last filter command of a
    log says which run is meant, and only commands of that run count.  ``border``: ``duplicate`` if the last
    fill before the filter took effect on what the filter read, else ``none``.  ``order``: ``periosteal_first`` if the first
    mask that took effect stands before the first extraction, else ``gobj_first``; null without one of them.
    ``trab_mask``: ``gobj`` if the first mask with the trabecular contour behind the extraction took effect,
    ``none`` if it did not; null without one.  A log without the filter has no row.
    """
    c = commands or Commands()
    own = Window.partitionBy(*keys, "log")
    name, line = F.col("name"), F.col("line")
    last = F.max(F.when(name == c.filter, F.struct("line", "run", "input"))).over(own)
    sub = blocks.withColumn("f", last).where(F.col("run") == F.col("f.run"))
    sub = sub.withColumn("first_extract", F.min(F.when(name == c.extract, line)).over(own))
    step = F.struct("line", F.coalesce("ok", F.lit(False)).alias("ok"), "input")
    behind = (name == c.mask) & (line > F.coalesce("first_extract", F.lit(-1))) & F.lower("gobj").endswith(c.trabecular)
    out = sub.groupBy(*keys, "log").agg(
        F.first("f").alias("f"), F.first("first_extract").alias("extract_line"),
        F.max(F.when((name == c.fill) & (line < F.col("f.line")), step)).alias("fill"),
        F.min(F.when((name == c.mask) & F.col("ok"), line)).alias("mask_line"), F.min(F.when(behind, step)).alias("trab"),
    )
    border = F.when(F.col("fill.ok") & F.col("fill.input").eqNullSafe(F.col("f.input")), "duplicate").otherwise("none")
    order = F.when(F.col("mask_line") < F.col("extract_line"), "periosteal_first").when(F.col("mask_line").isNotNull() & F.col("extract_line").isNotNull(), "gobj_first")
    trab = F.when(F.col("trab.ok"), "gobj").when(F.col("trab").isNotNull(), "none")
    return out.select(*keys, "log", F.col("f.run").alias("run"), border.alias("border"), order.alias("order"), trab.alias("trab_mask"), F.col("f.line").alias("filter_line"), F.col("fill.line").alias("fill_line"), "mask_line", "extract_line", F.col("trab.line").alias("trab_line"))


def entry_variants(log: Column, entries: Entries | None = None) -> dict[str, Column]:
    """The three facts as a processing log states them by the order of its entries, and where its mask stands (0: nowhere)."""
    e = entries or Entries()
    at = lambda what, start=None: F.locate(what, log) if start is None else F.when(start > 0, F.call_function("locate", F.lit(what), log, start)).otherwise(0)
    mask, label, extract = at(e.mask), at(e.label), at(e.extract)
    return {
        "border": F.when(at(e.fill) > 0, "duplicate").otherwise("none"),
        "order": F.when((mask > 0) & (label > 0) & (mask < label), "periosteal_first").otherwise("gobj_first"),
        "trab_mask": F.when(at(e.mask, extract) > 0, "gobj").otherwise("none"),
        "mask_at": mask,
    }


def chosen_logs(facts: DataFrame, runs: DataFrame, products: DataFrame, *keys: str) -> DataFrame:
    """The log of each key whose run made the delivered files: ``facts`` of one log a key, with the ranking's numbers.

    ``runs(keys, log, start, end)`` in seconds; ``products(keys, fill, mask, ts)``: whether a file's own log has the fill and a
    mask behind the extraction (null: it is no segmentation's log), and its last time stamp.  A stamp after a
    run's end refutes it.  Ranked by no refutation, agreements less disagreements, stamps inside,
    and start.  Votes are counted for each key first, so files and logs are never paired.
    """
    k = list(keys)
    votes = products.where("fill IS NOT NULL AND mask IS NOT NULL").groupBy(*k).agg(F.count_if("fill").alias("fills"), F.count_if("mask").alias("masks"), F.count("*").alias("files"))
    scores = run_scores(runs.withColumnRenamed("log", "run"), products, *keys).withColumnRenamed("run", "log")
    count = lambda c: F.coalesce(c, F.lit(0))
    files = count("files")
    agree = F.when(F.col("border") == "duplicate", count("fills")).otherwise(files - count("fills")) + F.when(F.col("trab_mask").eqNullSafe("gobj"), count("masks")).otherwise(files - count("masks"))
    ranked = facts.join(scores, [*k, "log"], "left").join(votes, k, "left").withColumns({"agreements": agree, "disagreements": 2 * files - agree, "inside": count("inside"), "after": count("after")})
    w = Window.partitionBy(*k).orderBy((F.col("after") > 0).cast("int"), F.desc(F.col("agreements") - F.col("disagreements")), F.desc("inside"), F.desc("start"), "log")
    return ranked.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place", "fills", "masks", "files")


def variants(scans: DataFrame, chosen: DataFrame, *keys: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """``keys, border, order, trab_mask, source, log`` of every scan of ``scans(keys, has_seg, seg_log)``.

    The segmentation's processing log decides if there is one; a segmentation without a log keeps the defaults; without a
    segmentation the chosen transcript decides, fact by fact; with neither the defaults stay.  ``source`` says which.
    """
    known = FACTS | (defaults or {})
    text = F.nullif("seg_log", F.lit(""))
    stated = entry_variants(text)
    from_log = F.coalesce("has_seg", F.lit(False)) & text.isNotNull()
    from_run = ~F.coalesce("has_seg", F.lit(False)) & F.col("log").isNotNull()
    out = scans.join(chosen.select(*keys, "log", *[F.col(f).alias(f"__{f}") for f in FACTS]), list(keys), "left")
    values = [F.when(from_log, stated[f]).when(from_run, F.coalesce(f"__{f}", F.lit(known[f]))).otherwise(F.lit(known[f])).alias(f) for f in FACTS]
    source = F.when(from_log, "processing log").when(from_run, "evaluation log").otherwise("default")
    return out.select(*keys, *values, source.alias("source"), F.when(from_run, F.col("log")).alias("log"))
