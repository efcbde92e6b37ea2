"""Decisions over comparison rows: which rule, preset or reading a scan's evidence speaks for.

Each is a CASE or a ranked choice over a small table of counts, so any number of scans is
decided in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def choose_preset(scores: DataFrame, key: str = "vol_id", first: str = "first") -> DataFrame:
    """``key, preset, score`` from ``key, preset, score, first``.

    The first preset stays unless another one's score is below half of its own.
    """
    own = Window.partitionBy(key)
    base = F.max(F.when(F.col(first), F.col("score"))).over(own)
    allowed = F.col(first) | (F.col("score") < F.lit(0.5) * base)
    order = own.orderBy(F.when(allowed, F.col("score")).asc_nulls_last(), F.col(first).cast("int").desc(), "preset")
    return scores.withColumn("base", base).withColumn("place", F.row_number().over(order)).where("place = 1").select(key, "preset", "score")


def cortical_rule(derived_exact: Column, raw: Column, derived: Column) -> Column:
    """Derived from the other compartment if its rendering is exact; else what differs less, derived on a tie."""
    return F.when(derived_exact, "derived").when(raw < derived, "raw").otherwise("derived")


def grid_rule(same_as_segmentation: Column) -> Column:
    return F.when(same_as_segmentation, "seg").otherwise("tight")


def contour_verdict(mismatch_automatic: Column, mismatch_corrected: Column, outside: Column) -> Column:
    """Whether masks follow the automatic contour or a corrected one."""
    return F.when((mismatch_automatic == 0) & (outside == 0), "automatic").when((mismatch_corrected == 0) | (outside > 0), "corrected").otherwise("undecided")


def best_of(rows: DataFrame, key: str, choice: str, mismatch: str) -> DataFrame:
    """``key, choice, mismatch``: the choice with the fewest mismatches; ties by name."""
    least = F.struct(F.col(mismatch), F.col(choice))
    return rows.groupBy(key).agg(F.min(least).alias("m")).select(key, F.col(f"m.{choice}").alias(choice), F.col(f"m.{mismatch}").alias(mismatch))


def votes(facts: DataFrame, products: DataFrame, *keys: str) -> DataFrame:
    """Of the facts a log states, how many the products agree with, and how many not."""
    k = list(keys)
    both = facts.select(*k, "fact", F.col("value").alias("said")).join(products.select(*k, "fact", F.col("value").alias("seen")), [*k, "fact"])
    return both.groupBy(*k).agg(F.count_if(F.col("said") == F.col("seen")).alias("agree"), F.count_if(F.col("said") != F.col("seen")).alias("disagree"))


def stand_in(*sources: Column) -> Column:
    """The first source that is there."""
    return F.coalesce(*sources)


def trabecular_object(seg: DataFrame, contour: DataFrame, cropped: DataFrame) -> DataFrame:
    """Stands in for a trabecular segmentation that is missing: the segmentation inside the contour, or its
    whole support in volumes where the crop never ran (``cropped``: ``vol_id, cropped``)."""
    on = seg.where("v <> 0").join(cropped, "vol_id")
    inside = on.where("cropped").join(contour.where("v <> 0").select("vol_id", "z", "y", "x"), ["vol_id", "z", "y", "x"], "left_semi")
    return inside.unionByName(on.where("NOT cropped")).select("vol_id", "z", "y", "x", F.lit(126).alias("v"))


#: Where each configuration of a comparison takes its masks and its segmentation from.
CONFIGURATIONS = {"A": ("reference", "reference"), "A2": ("reference, uncorrected contour", "reference"), "B": ("own, from the outer contour", "own"), "C": ("reference", "own")}


def configurations(scans: DataFrame, corrected: Column, equal: Column) -> DataFrame:
    """``…, config, masks, segmentation, same_as``: the runs to make of each scan.

    A2 only for scans with a corrected contour; C is the same as B where the renderings are equal.
    """
    table = F.array(*[F.struct(F.lit(n).alias("config"), F.lit(m).alias("masks"), F.lit(s).alias("segmentation")) for n, (m, s) in CONFIGURATIONS.items()])
    out = scans.withColumns({"__corrected": corrected, "__equal": equal}).withColumn("__c", F.explode(table)).where("__corrected OR __c.config <> 'A2'")
    return out.select(*scans.columns, "__c.config", "__c.masks", "__c.segmentation", F.when(F.col("__equal") & (F.col("__c.config") == "C"), "B").alias("same_as"))


def plan_status(masks: Column, seg: Column, maps: Column) -> Column:
    """A scan's status from the levels ``exact, caveat, manual, inconsistent, none`` of its parts."""
    any_is = lambda level: (masks == level) | (seg == level) | (maps == level)
    return (
        F.when(masks == "none", "missing").when(any_is("inconsistent"), "inconsistent").when(masks == "manual", "manual masks")
        .when((seg == "none") | (maps == "none"), "partial").when(any_is("caveat") | any_is("manual"), "usable with a note").otherwise("complete")
    )


def interval_reading(seconds: Column, slack: int = 120) -> Column:
    """What the time from one file to the next says about how it was made."""
    return F.when(seconds.isNull(), "unknown").when(seconds < -slack, "older than its source").when(seconds <= slack, "same run").when(seconds <= 3600, "within the hour").when(seconds <= 86_400, "same day").otherwise("later")


def log_facts(lines: DataFrame, patterns: dict[str, str], *keys: str, text: str = "text", line: str = "line") -> DataFrame:
    """``keys, fact, value, at``: the last value a log states for each fact, and on which line."""
    found = [F.struct(F.lit(n).alias("fact"), F.nullif(F.regexp_extract(text, p, 1), F.lit("")).alias("value")) for n, p in patterns.items()]
    rows = lines.select(*keys, line, F.explode(F.array(*found)).alias("f")).where("f.value IS NOT NULL").select(*keys, line, "f.fact", "f.value")
    return rows.groupBy(*keys, "fact").agg(F.max_by("value", line).alias("value"), F.max(line).alias("at"))


def section_kind(commands: Column, kinds: dict[str, list[str]]) -> Column:
    """The first kind whose commands a log section holds all of."""
    out = F.lit("other")
    for kind, needed in reversed(list(kinds.items())):
        out = F.when(F.size(F.array_except(F.array(*[F.lit(c) for c in needed]), commands)) == 0, kind).otherwise(out)
    return out


def patient_fields(name: Column, typos: dict[str, str] | None = None) -> Column:
    """``(group, study, subject, region, bone)`` of ``group; XStudy CODE_nnn region bone``.

    The study without its ending and in capitals, the subject's number in three digits and its
    prefix with known misspellings put right; null where the name has fewer parts.
    """
    words = F.split(F.btrim(F.element_at(F.split(name, ";", 2), 2)), r"\s+")
    whole = F.size(words) >= 4
    word = lambda k: F.when(whole, F.get(words, F.lit(k)))
    raw = F.upper(word(1))
    prefix = F.regexp_extract(raw, r"^(.+?)[_-]?(\d+)$", 1)
    fixed = prefix
    for wrong, right in (typos or {}).items():
        fixed = F.when(prefix == wrong, right).otherwise(fixed)
    number = F.lpad(F.regexp_extract(raw, r"(\d+)$", 1).try_cast("int").cast("string"), 3, "0")
    subject = F.when(F.regexp_extract(raw, r"(\d+)$", 1) == "", raw).otherwise(F.concat_ws("_", fixed, number))
    last = F.upper(word(3))
    bone = F.when(last.contains("TIBIA"), "tibia").when(last.contains("RADIUS"), "radius")
    return F.struct(F.btrim(F.element_at(F.split(name, ";", 2), 1)).alias("group"), F.upper(F.regexp_replace(word(0), "(?i)study$", "")).alias("study"), F.when(whole, subject).alias("subject"), F.upper(word(2)).alias("region"), bone.alias("bone"))


def bone_of(name: Column, typos: dict[str, str] | None = None) -> Column:
    """The bone a scan's name speaks of, with known misspellings put right."""
    lower = F.lower(name)
    for wrong, right in (typos or {}).items():
        lower = F.replace(lower, F.lit(wrong), F.lit(right))
    side = F.when(lower.rlike(r"(^|[^a-z])(l|left)([^a-z]|$)"), "left ").when(lower.rlike(r"(^|[^a-z])(r|right)([^a-z]|$)"), "right ").otherwise("")
    bone = F.regexp_extract(lower, "(radius|tibia|patella|femur|fibula)", 1)
    return F.when(bone != "", F.concat(side, bone))
